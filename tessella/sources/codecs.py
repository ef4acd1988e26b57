"""Compression and predictors of TIFF blocks."""

from __future__ import annotations

import lzma
import zlib

import numpy as np

# The numbers of codecs in TIFF files.
CODES = {"none": 1, "lzw": 5, "deflate": 8, "lzma": 34925, "zstd": 50000}
NAMES = {v: k for k, v in CODES.items()} | {32946: "deflate"}


CLEAR, END = 256, 257


def _lzw_encode(data: bytes) -> bytes:
    """LZW as in TIFF 6.0: most significant bit first, codes from 9 to 12 bits, one code early."""
    codes, widths = [CLEAR], [9]
    # A longer word by the code of the word before it and its last byte.
    table: dict[int, int] = {}
    free, width, word = 258, 9, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = table.get(key := word << 8 | byte)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        widths.append(width)
        table[key] = free
        free += 1
        if free == 4095:
            codes.append(CLEAR)
            widths.append(width)
            table, free, width = {}, 258, 9
        elif free == 1 << width:
            width += 1
        word = byte
    if word >= 0:
        codes.append(word)
        widths.append(width)
        free += 1
        if free == 1 << width and width < 12:
            width += 1
    codes.append(END)
    widths.append(width)
    # All bits at once: those of each code, highest first.
    size = np.array(widths)
    ends = np.cumsum(size)
    bits = np.repeat(np.array(codes), size) >> (np.repeat(ends, size) - 1 - np.arange(ends[-1])) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


#: Codes that are read at once after a clear code, and their widths: the table grows by one a code.
_AHEAD = 4096
_WIDTHS = np.array([9 if j < 254 else 10 if j < 766 else 11 if j < 1790 else 12 for j in range(_AHEAD)])


def _codes(data: np.ndarray, at: int, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the given widths from a bit on, and the bits after which they end."""
    ends = at + np.cumsum(widths)
    start = ends - widths
    first = np.minimum(start >> 3, len(data) - 3)
    three = data[first].astype(np.int64) << 16 | data[first + 1].astype(np.int64) << 8 | data[first + 2]
    return three >> (24 - (start & 7) - widths) & (1 << widths) - 1, ends


def _lzw_decode(data: bytes) -> bytes:
    bits = 8 * len(data)
    padded = np.frombuffer(data + bytes(4), np.uint8)
    out: list[bytes] = []
    singles = [*(bytes([i]) for i in range(256)), b"", b""]
    at, table, before, widths = 0, list(singles), b"", _WIDTHS
    while at + 9 <= bits:
        codes, ends = _codes(padded, at, widths)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END) | (ends > bits))
        stop = int(marks[0]) if len(marks) else len(codes)
        for code in codes[:stop].tolist():
            if not before:
                word = table[code]
            else:
                if code > len(table):
                    raise ValueError("broken LZW data")
                word = table[code] if code < len(table) else before + before[:1]
                table.append(before + word[:1])
            out.append(word)
            before = word
        if stop == len(codes):  # a table that is full goes on with its widest codes
            at, widths = int(ends[-1]), np.full(_AHEAD, 12)
        elif ends[stop] <= bits and codes[stop] == CLEAR:
            at, table, before, widths = int(ends[stop]), list(singles), b"", _WIDTHS
        else:
            break
    return b"".join(out)


def encoded(data: bytes, codec: str, level: int | None = None) -> bytes:
    if codec == "none":
        return data
    if codec == "deflate":
        return zlib.compress(data, 6 if level is None else level)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=9 if level is None else level).compress(data)
    if codec == "lzma":
        return lzma.compress(data, preset=6 if level is None else min(9, level))
    if codec == "lzw":
        return _lzw_encode(data)
    raise ValueError(f"no codec {codec}")


def decoded(data: bytes, codec: str, size: int) -> bytes:
    if codec == "none":
        return data
    if codec == "deflate":
        return zlib.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if codec == "lzma":
        return lzma.decompress(data)
    if codec == "lzw":
        return _lzw_decode(data)
    raise ValueError(f"no codec {codec}")


def differenced(block: np.ndarray, predictor: int) -> bytes:
    """A block (height x width x bands) after the predictor: 1 none, 2 differences along a row, 3 differences
    of the bytes of floats, most significant bytes first."""
    if predictor == 1:
        return block.tobytes()
    if predictor == 2:
        x = block.view(f"<u{block.itemsize}")
        out = x.copy()
        out[:, 1:] -= x[:, :-1]
        return out.tobytes()
    if predictor == 3 and block.dtype.kind == "f":
        h, w, n = block.shape
        rows = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, w * n, block.itemsize)
        planes = np.ascontiguousarray(rows.transpose(0, 2, 1)).reshape(h, -1)
        out = planes.copy()
        out[:, n:] -= planes[:, :-n]
        return out.tobytes()
    raise ValueError(f"predictor {predictor} does not fit {block.dtype}")


def summed(data: bytes, predictor: int, shape: tuple[int, int, int], dtype: np.dtype) -> np.ndarray:
    """The block of a predictor's output."""
    h, w, n = shape
    if predictor == 1:
        return np.frombuffer(data, dtype).reshape(shape)
    if predictor == 2:
        x = np.frombuffer(data, f"<u{dtype.itemsize}").reshape(shape)
        return np.add.accumulate(x, axis=1, dtype=x.dtype).view(dtype)
    planes = np.frombuffer(data, np.uint8).reshape(h, w * dtype.itemsize, n)
    planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(h, dtype.itemsize, w * n)
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1))
    return rows.view(dtype.newbyteorder(">")).reshape(shape).astype(dtype)
