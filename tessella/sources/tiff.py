"""The structure of TIFF files: headers with all directories in front, and their parsing.

A header is made from the sizes of the levels alone.  The arrays of tile offsets and byte counts are
the last part of it; their positions are known before their contents, so the contents can be made by
tasks and no process ever holds them all.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from xml.sax.saxutils import escape

from ..functions.grid import tile_count
from .codecs import CODES, NAMES

# Fixed values of TIFF, BigTIFF and GeoTIFF: field types with their sizes and struct codes, and tags.
BYTE, ASCII, SHORT, LONG, RATIONAL, DOUBLE, LONG8 = 1, 2, 3, 4, 5, 12, 16
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR, COLORMAP = 254, 256, 257, 258, 259, 262, 277, 284, 317, 320
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, EXTRA_SAMPLES, SAMPLE_FORMAT = 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIEPOINTS, TRANSFORMATION, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, RPC, METADATA, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 50844, 42112, 42113
MASK_FLAG, REDUCED_FLAG = 4, 1
FORMATS = {"u": 1, "i": 2, "f": 3}
#: Order of the ten scalars and four polynomials of the rational polynomial tag.
RPC_SCALARS = ("err_bias", "err_rand", "line_off", "samp_off", "lat_off", "long_off", "height_off", "line_scale", "samp_scale", "lat_scale", "long_scale", "height_scale")
RPC_POLYNOMIALS = ("line_num_coeff", "line_den_coeff", "samp_num_coeff", "samp_den_coeff")

GHOST = (
    "LAYOUT=IFDS_BEFORE_DATA\nBLOCK_ORDER=ROW_MAJOR\nBLOCK_LEADER=SIZE_AS_UINT4\n"
    "BLOCK_TRAILER=LAST_4_BYTES_REPEATED\nKNOWN_INCOMPATIBLE_EDITION=NO\n "
)
GHOST_MASK = "MASK_INTERLEAVED_WITH_IMAGERY=YES\n"


@dataclass(frozen=True)
class Spec:
    """What a file's header depends on."""

    dims: tuple[tuple[int, int], ...]
    bands: int
    dtype: str
    blocksize: int
    has_mask: bool = False
    compress: str = "deflate"
    predictor: int = 1
    overview_compress: str = "deflate"
    overview_predictor: int = 1
    nodata: float | None = None
    transform: tuple[float, ...] | None = None
    crs: str | None = None
    geotiff_version: float = 1.1
    meta: dict[str, Any] = field(default_factory=dict)
    ghost: bool = False
    bigtiff: bool = True


@dataclass(frozen=True)
class TileArrays:
    """Where the offsets and counts of a page's tiles stand in the file, and the bytes of one of each."""

    level: int
    is_mask: bool
    tile_rows: int
    tile_cols: int
    offsets_at: int
    offset_size: int
    counts_at: int
    count_size: int


def _values(kind: int, values: Any) -> bytes:
    if kind == ASCII:
        return values.encode("utf-8") + b"\0"
    return struct.pack(f"<{len(values)}{CODE[kind]}", *values)


def _number(value: Any) -> str:
    return repr(float(value)) if isinstance(value, float) else str(value)


def metadata_xml(meta: dict[str, Any], bands: int) -> str:
    """The metadata tag: tags of the image and its bands, and what else bands are told to be."""
    items = []

    def item(name: str, value: Any, sample: int | None = None, role: str = "") -> None:
        where = "" if sample is None else f' sample="{sample}"'
        what = f' role="{role}"' if role else ""
        quoted = escape(str(name), {'"': "&quot;"})
        items.append(f'  <Item name="{quoted}"{where}{what}>{escape(_number(value))}</Item>\n')

    for band, tags in sorted(meta.get("update_tags", {}).items()):
        if not 0 <= int(band) <= bands:
            raise ValueError(f"tags of band {band}, of {bands}")
        for name, value in tags.items():
            item(name, value, int(band) - 1 if int(band) else None)
    for key, name in (("descriptions", "DESCRIPTION"), ("offsets", "OFFSET"), ("scales", "SCALE"), ("units", "UNITTYPE"), ("colorinterp", "COLORINTERP")):
        values = meta.get(key)
        if values is None:
            continue
        if len(values) != bands:
            raise ValueError(f"{key} has {len(values)} values for {bands} bands")
        for sample, value in enumerate(values):
            if value is not None:
                item(name, getattr(value, "name", value), sample, name.lower())
    return f"<GDALMetadata>\n{''.join(items)}</GDALMetadata>\n" if items else ""


def geo_keys(crs: str | None, version: float) -> list[tuple[int, int, Any]]:
    """The entries of a coordinate system: an EPSG code, or any text as a citation."""
    if not crs:
        return []
    keys, text = [], ""
    code = crs[5:] if crs.upper().startswith("EPSG:") else ""
    if code.isdigit():
        number = int(code)
        # Codes of geographic systems are 4000 to 4999 (EPSG's own ranges).
        geographic = 4000 <= number < 5000
        keys = [(1024, 0, 1, 2 if geographic else 1), (1025, 0, 1, 1), (2048 if geographic else 3072, 0, 1, number)]
    else:
        text = f"{crs}|"
        keys = [(1024, 0, 1, 32767), (1025, 0, 1, 1), (1026, GEO_ASCII, len(text), 0)]
    head = (1, 1, 1 if version >= 1.1 else 0, len(keys))
    out: list[tuple[int, int, Any]] = [(GEO_KEYS, SHORT, [*head, *(x for k in keys for x in k)])]
    return [*out, (GEO_ASCII, ASCII, text)] if text else out


def georeference(spec: Spec) -> list[tuple[int, int, Any]]:
    """The entries that place the image: a transform (a, b, c, d, e, f), ground control points, a rational polynomial."""
    out: list[tuple[int, int, Any]] = []
    if spec.transform:
        a, b, c, d, e, f = spec.transform
        if b == d == 0 and a > 0 and e < 0:
            out += [(PIXEL_SCALE, DOUBLE, [a, -e, 0.0]), (TIEPOINTS, DOUBLE, [0.0, 0.0, 0.0, c, f, 0.0])]
        else:
            out.append((TRANSFORMATION, DOUBLE, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    elif points := spec.meta.get("gcps"):
        out.append((TIEPOINTS, DOUBLE, [float(x) for col, row, px, py, *z in points for x in (col, row, 0.0, px, py, z[0] if z else 0.0)]))
    if rpcs := spec.meta.get("rpcs"):
        rpcs = {k.lower(): v for k, v in rpcs.items()}
        out.append((RPC, DOUBLE, [float(rpcs.get(k, -1.0)) for k in RPC_SCALARS] + [float(x) for k in RPC_POLYNOMIALS for x in rpcs[k]]))
    return [*out, *geo_keys(spec.crs, spec.geotiff_version)]


def nodata_text(nodata: float) -> str:
    if nodata != nodata:
        return "nan"
    return str(int(nodata)) if float(nodata).is_integer() and abs(nodata) < 1e15 else repr(float(nodata))


def _page(spec: Spec, level: int, is_mask: bool) -> list[tuple[int, int, Any]]:
    """The entries of a page, but for the tile arrays."""
    height, width = spec.dims[level]
    codec, predictor = (spec.compress, spec.predictor) if level == 0 else (spec.overview_compress, spec.overview_predictor)
    side = lambda n: (SHORT if n < 65536 else LONG, [n])
    entries: list[tuple[int, int, Any]] = [(WIDTH, *side(width)), (LENGTH, *side(height)), (PLANAR, SHORT, [1]), (TILE_WIDTH, *side(spec.blocksize)), (TILE_LENGTH, *side(spec.blocksize))]
    if flags := (MASK_FLAG if is_mask else 0) | (REDUCED_FLAG if level else 0):
        entries.append((SUBFILE, LONG, [flags]))
    if is_mask:
        return [*entries, (BITS, SHORT, [1]), (COMPRESSION, SHORT, [CODES["deflate"]]), (PHOTOMETRIC, SHORT, [4]), (SAMPLES, SHORT, [1])]
    kind, bits = FORMATS[_kind(spec.dtype)], 8 * _itemsize(spec.dtype)
    colors = [str(getattr(c, "name", c)).lower() for c in spec.meta.get("colorinterp", [])]
    colormap = spec.meta.get("write_colormap")
    photometric = 3 if colormap else 2 if colors[:3] == ["red", "green", "blue"] else 1
    extra = spec.bands - (3 if photometric == 2 else 1)
    entries += [(BITS, SHORT, [bits] * spec.bands), (COMPRESSION, SHORT, [CODES[codec]]), (PHOTOMETRIC, SHORT, [photometric]), (SAMPLES, SHORT, [spec.bands]), (SAMPLE_FORMAT, SHORT, [kind] * spec.bands)]
    if predictor != 1:
        entries.append((PREDICTOR, SHORT, [predictor]))
    if extra:
        entries.append((EXTRA_SAMPLES, SHORT, [2 if c == "alpha" else 0 for c in (colors[-extra:] if len(colors) == spec.bands else [""] * extra)]))
    if colormap:
        if bits not in (8, 16) or kind != 1 or spec.bands != 1:
            raise ValueError("a colour map needs one band of 8 or 16 bits without sign")
        table = [[0] * (1 << bits) for _ in range(3)]
        for value, rgb in colormap.items():
            for plane, part in zip(table, rgb, strict=False):
                plane[int(value)] = int(part) * 257
        entries.append((COLORMAP, SHORT, [x for plane in table for x in plane]))
    if spec.nodata is not None:
        entries.append((NODATA, ASCII, nodata_text(spec.nodata)))
    if level == 0:
        entries += georeference(spec)
        if xml := metadata_xml(spec.meta, spec.bands):
            entries.append((METADATA, ASCII, xml))
    return entries


def _kind(dtype: str) -> str:
    return {"uint": "u", "int": "i", "float": "f"}[dtype.rstrip("0123456789")]


def _itemsize(dtype: str) -> int:
    return int(dtype.lstrip("uintfloa")) // 8


def header(spec: Spec) -> tuple[bytes, int, list[TileArrays]]:
    """The bytes of a file's header without the arrays that follow, the header's whole length, and where
    the arrays of each page stand.  An array that fits its entry stands there."""
    big = spec.bigtiff
    pages = [(level, is_mask) for level in range(len(spec.dims)) for is_mask in ((False, True) if spec.has_mask else (False,))]
    lead = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0)
    out = bytearray(lead)
    if spec.ghost:
        text = GHOST + (GHOST_MASK if spec.has_mask else "")
        out += f"GDAL_STRUCTURAL_METADATA_SIZE={len(text):06d} bytes\n{text}".encode()
        out += b"\0" * (-len(out) % 8)
    room, offset_type = (8, LONG8) if big else (4, LONG)
    count_format, entry_format, next_format = ("<Q", "<HHQ", "<Q") if big else ("<H", "<HHI", "<I")
    link = 8 if big else 4
    arrays: list[tuple[int, bool, int, int, dict[int, tuple[int, int, int]]]] = []
    for level, is_mask in pages:
        height, width = spec.dims[level]
        rows, cols = tile_count(height, spec.blocksize), tile_count(width, spec.blocksize)
        n = rows * cols
        entries: list[tuple[int, int, Any]] = [*_page(spec, level, is_mask), (TILE_OFFSETS, offset_type, n), (TILE_COUNTS, LONG8 if n == 1 and big else LONG, n)]
        entries.sort(key=lambda e: e[0])
        out += b"\0" * (len(out) % 2)
        struct.pack_into(next_format, out, link, len(out))
        out += struct.pack(count_format, len(entries))
        at = len(out)
        width_of = struct.calcsize(entry_format) + room
        out += b"\0" * (len(entries) * width_of)
        link = len(out)
        out += struct.pack(next_format, 0)
        tiles: dict[int, tuple[int, int, int]] = {}
        for k, (tag, kind, values) in enumerate(entries):
            place = at + k * width_of
            value_at = place + struct.calcsize(entry_format)
            if tag in (TILE_OFFSETS, TILE_COUNTS):
                struct.pack_into(entry_format, out, place, tag, kind, values)
                tiles[tag] = (kind, values, value_at)
                continue
            data = _values(kind, values)
            struct.pack_into(entry_format, out, place, tag, kind, len(data) // SIZES[kind])
            if len(data) <= room:
                out[value_at : value_at + len(data)] = data
            else:
                out += b"\0" * (len(out) % 2)
                struct.pack_into(next_format, out, value_at, len(out))
                out += data
        arrays.append((level, is_mask, rows, cols, tiles))
    end = len(out) + len(out) % 8
    out += b"\0" * (end - len(out))
    places = []
    for level, is_mask, rows, cols, tiles in arrays:
        found: dict[int, int] = {}
        for tag, (kind, n, value_at) in tiles.items():
            if n * SIZES[kind] <= room:
                found[tag] = value_at
            else:
                end += -end % 8
                struct.pack_into(next_format, out, value_at, end)
                found[tag] = end
                end += n * SIZES[kind]
        places.append(TileArrays(level, is_mask, rows, cols, found[TILE_OFFSETS], SIZES[tiles[TILE_OFFSETS][0]], found[TILE_COUNTS], SIZES[tiles[TILE_COUNTS][0]]))
    return bytes(out), end, places


# Parsing.


@dataclass(frozen=True)
class Page:
    """A page of a file: its tags, of the tile arrays only where they stand."""

    tags: dict[int, Any]
    offsets: tuple[int, int, int]
    counts: tuple[int, int, int]

    @property
    def is_mask(self) -> bool:
        return bool(self.tags.get(SUBFILE, [0])[0] & MASK_FLAG)

    @property
    def height(self) -> int:
        return self.tags[LENGTH][0]

    @property
    def width(self) -> int:
        return self.tags[WIDTH][0]

    @property
    def blocksize(self) -> int:
        return self.tags[TILE_WIDTH][0]

    @property
    def bands(self) -> int:
        return self.tags.get(SAMPLES, [1])[0]

    @property
    def dtype(self) -> str:
        kind = {1: "uint", 2: "int", 3: "float"}[self.tags.get(SAMPLE_FORMAT, [1])[0]]
        return f"{kind}{self.tags.get(BITS, [1])[0]}"

    @property
    def codec(self) -> str:
        return NAMES[self.tags.get(COMPRESSION, [1])[0]]

    @property
    def predictor(self) -> int:
        return self.tags.get(PREDICTOR, [1])[0]

    @property
    def nodata(self) -> float | None:
        text = self.tags.get(NODATA)
        return None if text is None else float(text)


def parse(fetch: Callable[[int, int], bytes]) -> list[Page]:
    """The pages of a little-endian tiled file.  fetch(offset, length) reads; nothing is read but directories and small values."""
    mark, magic = struct.unpack("<2sH", fetch(0, 4))
    if mark != b"II" or magic not in (42, 43):
        raise ValueError("not a little-endian TIFF file")
    big = magic == 43
    at = struct.unpack("<Q", fetch(8, 8))[0] if big else struct.unpack("<I", fetch(4, 4))[0]
    count_format, entry_format, next_format, room = ("<Q", "<HHQ", "<Q", 8) if big else ("<H", "<HHI", "<I", 4)
    size = struct.calcsize(entry_format) + room
    pages, seen = [], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a circle")
        seen.add(at)
        n = struct.unpack(count_format, fetch(at, struct.calcsize(count_format)))[0]
        first = at + struct.calcsize(count_format)
        data = fetch(first, n * size + struct.calcsize(next_format))
        tags: dict[int, Any] = {}
        arrays: dict[int, tuple[int, int, int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(entry_format, data, k * size)
            value_at = k * size + struct.calcsize(entry_format)
            length = count * SIZES.get(kind, 1)
            inside = length <= room
            where = first + value_at if inside else struct.unpack_from(next_format, data, value_at)[0]
            if tag in (TILE_OFFSETS, TILE_COUNTS):
                arrays[tag] = (where, SIZES[kind], count)
                continue
            raw = data[value_at : value_at + length] if inside else fetch(where, length)
            tags[tag] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == ASCII else list(struct.unpack(f"<{count}{CODE[kind]}", raw)) if kind in CODE else raw
        if TILE_OFFSETS not in arrays or TILE_COUNTS not in arrays:
            raise ValueError("a page without tiles")
        pages.append(Page(tags, arrays[TILE_OFFSETS], arrays[TILE_COUNTS]))
        at = struct.unpack_from(next_format, data, n * size)[0]
    return pages


def by_level(pages: list[Page]) -> list[tuple[Page, Page | None]]:
    """Image and mask pages of each level, by equal size."""
    masks = {(p.height, p.width): p for p in pages if p.is_mask}
    return [(p, masks.get((p.height, p.width))) for p in pages if not p.is_mask]
