"""The resampling kernels, for overviews of half the size.

A tap kernel weighs source pixels 2i + k of each axis for output i.  Weights are whole numbers, so sums
over whole-numbered pixels are exact in any order.
"""

from __future__ import annotations

# Names of the kernels and the pixels of a neighbour that each may read (even numbers).
HALO = {"nearest": 0, "average": 0, "mode": 0, "rms": 0, "bilinear": 2, "cubic": 4, "cubicspline": 4, "lanczos": 6, "gauss": 2}

#: The first tap and the weights from there on.  Triangle, Keys (1981) with a = -1/2, cubic B-spline, Lanczos with
#: three lobes in units of 2**-16, and the binomial 1-2-1 centred on the pixel 2i.
TAPS: dict[str, tuple[int, tuple[int, ...]]] = {
    "bilinear": (-1, (1, 3, 3, 1)),
    "cubic": (-3, (-3, -9, 29, 111, 111, 29, -9, -3)),
    "cubicspline": (-3, (1, 27, 121, 235, 235, 121, 27, 1)),
    "lanczos": (-5, (482, 1967, -4443, -8708, 17707, 58331, 58331, 17707, -8708, -4443, 1967, 482)),
    "gauss": (-1, (1, 2, 1)),
}


def taps(kernel: str) -> list[tuple[int, int]]:
    """(k, weight) of a tap kernel."""
    first, weights = TAPS[kernel]
    return [(first + i, w) for i, w in enumerate(weights)]
