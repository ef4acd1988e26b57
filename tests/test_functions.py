"""Options and the arithmetic of grids, on single rasters."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessella.functions import options
from tessella.functions.grid import halved, overview_levels, tile_count
from tessella.functions.kernels import HALO, TAPS, taps


@given(st.integers(1, 10**6), st.integers(1, 10**6), st.sampled_from([16, 256, 512]))
def test_smallest_overview_fits(width, height, minsize):
    n = overview_levels(width, height, minsize)
    assert max(width >> n, height >> n) <= minsize
    assert n == 0 or max(width >> (n - 1), height >> (n - 1)) > minsize


@given(st.integers(1, 10**4), st.integers(1, 10**4), st.integers(0, 20))
def test_count_caps_levels(width, height, count):
    n = overview_levels(width, height, 512, count)
    assert n <= count
    assert n == count or max(width >> n, height >> n) <= 1


def test_levels_by_hand():
    assert overview_levels(1025, 3, 512) == 1  # 1025 halves to 512, which is small enough
    assert overview_levels(512, 512, 512) == 0
    assert overview_levels(514, 1, 256) == 2
    assert overview_levels(1, 1, 512, 5) == 0


@given(st.integers(1, 10**6), st.integers(0, 25))
def test_halving_is_repeated_floor(n, times):
    x = n
    for _ in range(times):
        x = max(1, x // 2)
    assert halved(n, times) == x


def test_tile_count():
    assert [tile_count(n, 16) for n in (1, 15, 16, 17, 32, 33)] == [1, 1, 1, 2, 2, 3]


def test_taps_stay_in_the_halo():
    for kernel in TAPS:
        reach = [k for k, _ in taps(kernel)]
        assert -min(reach) <= HALO[kernel]
        assert max(reach) - 1 <= HALO[kernel]
        assert HALO[kernel] % 2 == 0


def test_symmetric_kernels():
    for kernel in ("bilinear", "cubic", "cubicspline", "lanczos", "gauss"):
        weights = TAPS[kernel][1]
        assert weights == weights[::-1]


def test_defaults():
    o = options.CogOptions.of({"OVERVIEW_RESAMPLING": "Average"})
    assert (o.kernel, o.blocksize, o.compress, o.sparse_ok, o.statistics, o.ghost, o.predictor) == ("average", 512, "deflate", True, False, True, 1)


@pytest.mark.parametrize("name", [*options.REFUSED, *options.REQUIRED])
def test_refused(name):
    with pytest.raises(options.OptionError, match=name):
        options.checked({"overview_resampling": "mode", name.upper(): "x"})


@pytest.mark.parametrize(
    "wrong",
    [{}, {"overview_resampling": "sinc"}, {"resampling": "mode", "blocksize": 20}, {"resampling": "mode", "blocksize": 0}, {"resampling": "mode", "compress": "jpeg"}, {"resampling": "mode", "compress": "rle"}, {"resampling": "mode", "predictor": 4}],
)
def test_wrong_options(wrong):
    with pytest.raises(options.OptionError):
        options.checked(wrong)


@pytest.mark.parametrize(("word", "on"), [("NO", False), ("false", False), ("Off", False), ("0", False), ("YES", True), ("true", True), ("on", True), ("1", True), (0, False), (True, True)])
def test_words_for_switches(word, on):
    o = options.CogOptions.of({"resampling": "mode", "sparse_ok": word, "statistics": word, "cog_ghost_data": word})
    assert (o.sparse_ok, o.statistics, o.ghost) == (on, on, on)


def test_other_words_are_no_switches():
    with pytest.raises(options.OptionError, match="statistics"):
        options.CogOptions.of({"resampling": "mode", "statistics": "maybe"})


def test_resampling_is_an_alias():
    assert options.checked({"Resampling": "MODE"}) == {"overview_resampling": "mode"}
    both = options.checked({"resampling": "mode", "overview_resampling": "rms"})
    assert both["overview_resampling"] == "rms"


def test_user_wins_over_source_over_defaults():
    o = options.CogOptions.of({"resampling": "rms", "nodata": 5}, {"nodata": 1, "crs": "EPSG:4326", "transform": (1, 0, 0, 0, -1, 0)})
    assert (o.nodata, o.crs, o.transform) == (5, "EPSG:4326", (1.0, 0.0, 0.0, 0.0, -1.0, 0.0))


def test_text_values_keep_their_case():
    assert options.CogOptions.of({"resampling": "rms", "CRS": "LOCAL_CS[Mine]"}).crs == "LOCAL_CS[Mine]"


def test_overview_profile():
    base = {"compress": "deflate", "quality": 9, "predictor": "standard"}
    assert options.for_overviews(base) == base
    other = options.for_overviews({**base, "overview_compress": "zstd"})
    assert other["compress"] == "zstd" and "quality" not in other and "predictor" not in other
    own = options.for_overviews({**base, "overview_compress": "zstd", "overview_quality": 3})
    assert own["quality"] == 3
    same = options.for_overviews({**base, "overview_compress": "deflate"})
    assert same["quality"] == 9 and same["predictor"] == "standard"


def test_unknown_options_are_kept_aside():
    assert options.CogOptions.of({"resampling": "mode", "num_threads": 4}).extra == {"num_threads": 4}
