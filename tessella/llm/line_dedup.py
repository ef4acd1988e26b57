"""Fuzzy line deduplication by MinHash.

Lines are compared by their sets of seven-character shingles.  A signature of 48 minhashes makes 16
bands of three: two lines of similarity 0.8 share a band with probability 0.99999.  Of pairs at 0.8
another 2e-4 are lost since their estimate is four standard deviations low.  Candidates are confirmed by their exact Jaccard similarity, and of each component of confirmed links
(distributed star contraction) the line that comes first (by document, then place) stays, once in the
whole corpus.

Equal lines are one class before anything else, so a line that millions of documents have is one row
from there on.  Bands of many classes are treated as the regions of the near-duplicate forest are:
all their pairs are compared, those already connected apart, so a band's size loses no pair.
Lines travel as digests and signatures; the text of a line moves only if a candidate pair needs it, and
the texts of documents don't move at all unless the lines that go are too many to broadcast.

Defined cases: lines are compared after trimming spaces, tabs and carriage returns; blank lines always
stay and count as lines; a null text has no line and stays null, an empty one has one blank line; a
null doc_id sorts first; rows that repeat doc_id and text are the same lines, so all of them keep what
the first keeps; rows that repeat a doc_id (or have none) with other texts lose their own lines only, and equal
lines at the same place of such rows count as one and all stay; columns of the input named n_lines or n_kept are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import pack, packed
from .common import bit_filter, bounded_batches, filter_bits, fresh, maybe_in, named, stash, steps, text_of
from .near_dedup import _A, MAX_BROADCAST_WORDS, Forest, filtered, linked_sets, roots

SHINGLE, PERCENT = 7, 80
LINES = Forest(16, 3, (3,), (1, 1))
#: Characters of different lines that a task gathers before it hashes them and counts anew.
GATHERED = 1 << 22
#: Bytes of masks that are broadcast.
MAX_BROADCAST_BYTES = 64 << 20
#: Characters whose shingles are hashed at once, so that the arrays stay in a core's cache.
STEP = 1 << 16
TRIM = " \t\r"
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _stash(df: DataFrame) -> DataFrame:
    """Digests, places and signatures hardly repeat: dictionaries of them would cost time only."""
    return stash(df, **{"parquet.enable.dictionary": "false"})


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _windows(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of SHINGLE code points, from hashes of windows of two and of four."""
    two = x[:-1] * _M1 + x[1:]
    four = two[:-2] * _M2 + two[2:]
    out = four[:-3] * _M3 + four[3:]
    out ^= out >> np.uint64(32)
    out *= _M1
    out ^= out >> np.uint64(29)
    return out


def window_hashes(text: str) -> np.ndarray:
    return _windows(_codes(text))


def signatures(lines: list[str], hashes: int = LINES.hashes) -> np.ndarray:
    """A row for each line: 16 bits of each of its minhashes.

    The windows of all lines are hashed together, then those that reach over a line's end are left out.
    A shorter line than a window is filled up with NULs, which makes it one window.
    """
    if not lines:
        return np.zeros((0, hashes), "<u2")
    whole = [line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\0") for line in lines]
    length = np.fromiter(map(len, whole), np.int64, len(whole))
    x = (window_hashes("".join(whole)) >> np.uint64(32)).astype(np.uint32)
    end = np.cumsum(length)
    own = np.ones(end[-1], bool)
    own[end[:, None] - np.arange(1, SHINGLE)] = False
    x = x[own[: len(x)]]
    start = end - length - (SHINGLE - 1) * np.arange(len(whole))
    low = np.empty((hashes, len(lines)), np.uint32)
    y = np.empty_like(x)
    for k in range(hashes):
        np.multiply(x, _A[k], out=y)
        np.minimum.reduceat(y, start, out=low[k])
    low ^= low >> 15
    low *= np.uint32(0x2C1B3C6D)
    low ^= low >> 12
    return low.T.astype("<u2", order="C")


def shingles(line: str) -> set[str]:
    """The set of a line's shingles; a shorter line is one."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


class LineSets:
    """Sets of lines, for the near-duplicate regions: 64-bit hashes of their shingles, in order."""

    def __call__(self, line: str) -> np.ndarray:
        x = _codes(line)
        if len(x) < SHINGLE:  # filled up with what is no character
            x = np.concatenate([x, np.full(SHINGLE - len(x), 0x110000, np.uint64)])
        x = _windows(x)
        x.sort()  # np.unique takes some five times as long for so few
        new = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=new[1:])
        return x[new]

    linked = staticmethod(linked_sets)


def _cut(text: str) -> tuple[list[int], list[str]]:
    """The places and trimmed texts of the lines that aren't blank."""
    lines = [line.strip(TRIM) for line in text.split("\n")]
    places = [i for i, line in enumerate(lines) if line]
    return places, [lines[i] for i in places]


#: The digest of a line, and the 128-bit number by which places (document, then line) are in order.
DIGEST = "k1 long, k2 long"
PLACE = "decimal(38,0)"


def _digests(lines: list[str]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in lines), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _numbers(values: list[int]) -> pa.Array:
    raw = b"".join(v.to_bytes(16, "little", signed=True) for v in values)
    return pa.Array.from_buffers(pa.decimal128(38), len(values), [None, pa.py_buffer(raw)])


def _first_place(doc: int | None) -> int:
    """The place of a document's line 0.  No document comes before a null one."""
    return (-(1 << 63) - 1 if doc is None else doc) << 32


def _classes(docs: DataFrame) -> DataFrame:
    """k1, k2, n, the first place and the packed signature of each different line.

    Tasks count lines before they hash them, so that a line of many documents is hashed and sent once a task;
    all that is aggregated after that has a fixed width.
    """
    sig = packed(LINES.hashes)
    names = ["k1", "k2", "n", "place", *sig]

    def made(held: dict[str, list[int]]) -> pa.RecordBatch:
        lines = list(held)
        longs = pack(np.concatenate([signatures(lines[a:b]) for a, b in steps(lines, STEP)]))
        counts, places = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([*_digests(lines), pa.array(counts, pa.int64()), _numbers(places), *(pa.array(np.ascontiguousarray(x)) for x in longs.T)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = {}, 0
        for batch in batches:
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = _first_place(doc)
                for at, line in zip(*_cut(cell.as_py()), strict=True):
                    known = held.get(line)
                    if known is None:
                        held[line] = [1, first + at]
                        chars += len(line) + 50
                        if chars > GATHERED:
                            yield made(held)
                            held, chars = {}, 0
                    else:
                        known[0] += 1
                        known[1] = min(known[1], first + at)
        if held:
            yield made(held)

    schema = f"{DIGEST}, n long, place {PLACE}, " + ", ".join(f"{c} long" for c in sig)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)
    return parts.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("place").alias("place"), *(F.max(c).alias(c) for c in sig))


def _places(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, whole (a hash of the text), at, k1 and k2 (the line's digest) of every line, with its text if asked for."""
    names = ["doc_id", "whole", "at", "k1", "k2", *(["line"] if text else [])]

    def made(ids: list, wholes: list, places: list, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(wholes, pa.int64()), pa.array(places, pa.int32()), *_digests(lines), *([pa.array(lines, pa.string())] if text else [])], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wholes, places, lines, chars = [], [], [], [], 0
            for doc, whole, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                at, own = _cut(cell.as_py())
                for i in range(0, len(own), 1000):  # a long document's lines in steps too
                    some = own[i : i + 1000]
                    ids += [doc] * len(some)
                    wholes += [whole] * len(some)
                    places += at[i : i + 1000]
                    lines += some
                    chars += sum(map(len, some))
                    if chars > 16 * STEP:
                        yield made(ids, wholes, places, lines)
                        ids, wholes, places, lines, chars = [], [], [], [], 0
            if lines:
                yield made(ids, wholes, places, lines)

    schema = f"doc_id long, whole long, at int, {DIGEST}" + ", line string" * text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _whole().alias("whole"), text_of().alias("text")).mapInArrow(run, schema)


def _whole() -> Column:
    """A hash of the text: rows that repeat an id with other texts have places of their own."""
    return F.xxhash64(text_of(), F.octet_length(text_of()))


def _filtered(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Those rows whose columns may be in keys."""
    if not MAX_BROADCAST_WORDS:
        return rows
    return filtered(rows, F.xxhash64(*columns), keys, F.xxhash64(*columns))


#: The place of a line whose document (null: before all) and number are known, and the other way round.
_PLACE = f"cast(coalesce(cast(doc_id AS decimal(20,0)), {-(1 << 63) - 1}BD) * 4294967296BD + at AS {PLACE})"
_AT = "cast(pmod(place, 4294967296BD) AS int)"
_DOC = f"CASE WHEN place >= {-(1 << 95)}BD THEN cast((place - pmod(place, 4294967296BD)) / 4294967296BD AS long) END"


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, whole (a hash of the text) and places (sorted) of the lines that go."""
    bounded_batches(docs.sparkSession)
    names = _stash(_classes(docs).withColumn("rep", F.monotonically_increasing_id()))

    def texts(wanted: DataFrame) -> DataFrame:
        keys = names.select("rep", "place", "k1", "k2")
        keys = _stash(_filtered(keys, ["rep"], wanted).join(wanted, "rep", "left_semi").select("rep", "k1", "k2", F.expr(_DOC).alias("doc_id"), F.expr(_AT).alias("at")))
        some = _filtered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], keys)
        lines = _filtered(_places(some, text=True), ["k1", "k2"], keys)
        # Of rows that repeat an id several may have the line there: one is enough.
        lines = lines.withColumnRenamed("doc_id", "d").join(keys, ["k1", "k2", "at"]).where(F.col("d").eqNullSafe(F.col("doc_id")))
        return lines.select("rep", F.col("line").alias("text")).dropDuplicates(["rep"])

    linked = roots(names, texts, LINES, LineSets, PERCENT, packed=True)
    told = _keepers(names.select("rep", "k1", "k2", "n", "place"), linked)
    lines = _filtered(_places(docs), ["k1", "k2"], told).join(told, ["k1", "k2"])
    gone = lines.where(f"{_PLACE} <> keep")
    return gone.groupBy("doc_id", "whole").agg(F.array_sort(F.collect_set("at")).alias("places"))


def _keepers(names: DataFrame, linked: DataFrame) -> DataFrame:
    """k1, k2 and keep (a place) of each class that isn't alone with one line."""
    # Only linked classes and their roots need another aggregation.
    roots_ = linked.select(F.col("root").alias("rep")).distinct().select("rep", F.col("rep").alias("root"))
    in_groups = _stash(linked.select(F.col("node").alias("rep"), "root").unionByName(roots_))
    grouped = _stash(_filtered(names, ["rep"], in_groups).join(in_groups, "rep").select("rep", "root", "k1", "k2", "place"))
    # Written, so that the join has an exchange on either side and Spark can split a large group.
    keep = _stash(grouped.groupBy("root").agg(F.min("place").alias("keep")))
    several = grouped.join(keep, "root").select("k1", "k2", "keep")
    alone = names.where("n > 1").join(in_groups, "rep", "left_anti").select("k1", "k2", F.col("place").alias("keep"))
    return _stash(several.unionByName(alone))


def _masks(gone: DataFrame) -> DataFrame:
    """gone with mask, a byte a line up to the last that goes (1: goes), and lost, their number, in place of the places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for places in batch.column(2):
                at = places.values.to_numpy()
                mask = np.zeros(at[-1] + 1, np.uint8)
                mask[at] = 1
                masks.append(mask.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.binary()), pa.array([len(p) for p in batch.column(2)], pa.int64())], ["doc_id", "whole", "mask", "lost"])

    return gone.select("doc_id", "whole", "places").mapInArrow(run, "doc_id long, whole long, mask binary, lost long")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the lines that stay as text, n_lines and n_kept.

    Masks of up to MAX_BROADCAST_BYTES in all are broadcast.  More are joined by a shuffle, but only with the
    documents that may have one: a filter lets the others pass.
    """
    own, key, hashed, mask, lost, maybe = (fresh(docs, x) for x in ("own", "key", "hashed", "mask", "lost", "maybe"))
    gone = _stash(_masks(dropped(docs.select("doc_id", "text")))).select(F.col("doc_id").alias(key), F.col("whole").alias(hashed), F.col("mask").alias(mask), F.col("lost").alias(lost))
    size = gone.agg(F.coalesce(F.sum(F.length(mask) + 32), F.lit(0))).first()[0]
    keyed = docs.withColumn(own, _whole())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(hashed))
    columns = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_kept")]
    text = F.col("text").cast("string")
    # Line ends are counted by bytes; only texts that lose lines are split.
    n_lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select(*named(columns), text.alias("text"), n_lines.alias("n_lines"), n_lines.alias("n_kept"))

    def cut(rows: DataFrame) -> DataFrame:
        left = F.filter(F.split(text, "\n"), lambda _, i: F.substring(F.col(mask), i + 1, F.lit(1)) != F.lit(b"\x01"))
        some = F.col(mask).isNotNull()
        return rows.select(*named(columns), F.when(some, F.array_join(left, "\n")).otherwise(text).alias("text"), n_lines.alias("n_lines"), (n_lines - F.coalesce(lost, F.lit(0))).alias("n_kept"))

    if size <= MAX_BROADCAST_BYTES or not MAX_BROADCAST_WORDS:
        return cut(keyed.join(F.broadcast(gone) if size <= MAX_BROADCAST_BYTES else gone, same, "left"))
    bits = filter_bits(gone.count(), most=64 * MAX_BROADCAST_WORDS)
    both = F.xxhash64(F.col("doc_id").cast("long"), own)
    marked = maybe_in(keyed, both, bit_filter(gone, F.xxhash64(key, hashed), bits), bits, maybe)
    return whole(marked.where(~F.col(maybe))).unionByName(cut(marked.where(maybe).join(gone, same, "left")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and text_sha256 (of the lines that stay) of every document."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
