"""Benchmark decontamination by Wu-Manber search over words.

A window is ten consecutive words of a benchmark item (an item of fewer words is one window).  All
windows of one length are searched at once.  The block of Wu-Manber is two words: a shift table says
how far the search may jump after the two words at the end of the current position (most pairs are in
no window, so it jumps nine words at a time); where the shift is zero, the hash of that last pair
selects a bucket of windows, and a direct comparison of all words confirms the occurrence.

The benchmark is searched in blocks of bounded size, one after the other: the driver and the tasks hold one
at a time, and its hits are written before the next is read.  With more than one block the hits of a document
meet again in one aggregation over its (bounded) word runs.

Defined cases: null and empty texts have no words and are clean; an item without words is never hit;
items with equal windows are all reported; a repeated item_id counts once; rows that repeat a doc_id
are scanned and reported each on its own.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, map_arrow, named, stash, text_of

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z and makes a space of every byte that no word has.  Bytes of code points from U+0080 on stay.
FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Searcher:
    """Tables for all windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list], length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[bytes | tuple, int] = {}
        self.bucket: dict[bytes | tuple, list[tuple[tuple[bytes, ...], list]]] = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                shift = length - end
                if shift < self.shift.get(key, self.jump):
                    self.shift[key] = shift
            self.bucket[window[-self.block :]].append((window, items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """Where windows begin, and the items that have them."""
        length, block, jump = self.length, self.block, self.jump
        get, bucket = self.shift.get, self.bucket
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            shift = get(key, jump)
            if shift:
                end += shift
                continue
            at = tuple(words[end - length : end])
            for window, items in bucket[key]:
                if window == at:
                    yield end - length, items
            end += 1


def searchers(items: list[tuple[object, str]], window: int = WINDOW) -> list[Searcher]:
    """One searcher for each length of window that the items have."""
    by_length: dict[int, dict[tuple[bytes, ...], list]] = defaultdict(dict)
    for item, text in items:
        words = words_of(text or "")
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            ids = by_length[length].setdefault(tuple(words[i : i + length]), [])
            if not ids or ids[-1] != item:
                ids.append(item)
    return [Searcher(windows, length) for length, windows in sorted(by_length.items(), reverse=True)]


def scan(tables: list[Searcher], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """The runs of hit words, as disjoint [from, to) in order, and the ids of the items."""
    spans, items = [], set()
    for table in tables:
        for start, ids in table.occurrences(words):
            spans.append((start, start + table.length))
            items.update(ids)
    return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about limit bytes of text, at least one block; the driver holds one or two."""
    rows = benchmark.select(F.col("item_id"), text_of().alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text.encode())
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


HITS = "n_words long, runs array<struct<start: int, stop: int>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, runs (hit words, as [start, stop)) and items (ids as strings, sorted).

    Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    added = T.StructType.fromDDL(HITS)
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    parts = blocks(benchmark, block_bytes)
    part, rest = next(parts), next(parts, None)
    if rest is None:
        return _scanned(docs.select(*named(kept), text_of().alias(fresh(docs, "text"))), part, window, added)
    # More than one block: each scans all texts, and its hits are written before the next comes; the first
    # counts the words too.  The hits of a document meet again by a row number.
    number = fresh(docs, "row")
    rows = stash(docs.select(*named(kept)).withColumn(number, F.monotonically_increasing_id()))
    slim = rows.select(number, text_of().alias(fresh(docs, "text")))
    first = stash(_scanned(slim, part, window, added))
    found = first.where(F.size("items") > 0).select(number, "runs", "items")
    while rest is not None:
        part, rest = rest, next(parts, None)
        found = found.unionByName(stash(_scanned(slim, part, window, added).where(F.size("items") > 0).select(number, "runs", "items")))
    joined = found.groupBy(number).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<start: int, stop: int>>")
    return rows.join(first.select(number, "n_words"), number).join(_joined_runs(joined), number, "left").select(*named(kept), "n_words", F.coalesce("runs", empty).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _joined_runs(found: DataFrame) -> DataFrame:
    """Runs that overlap or touch become one.  The first column is a number."""
    number, fields = found.columns[0], T.StructType.fromDDL(HITS)
    schema = T.StructType([found.schema[0], fields["runs"], fields["items"]])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[{"start": a, "stop": b} for a, b in merged((x["start"], x["stop"]) for x in cell)] for cell in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), batch.column(2)], schema.names)

    return map_arrow(found.select(number, "runs", "items"), run, schema)


def _scanned(source: DataFrame, items: list[tuple[object, str]], window: int, added: T.StructType) -> DataFrame:
    """source, whose last column is a text, with HITS in its place."""
    shared = source.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([*source.schema.fields[:-1], *added.fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = searchers(shared.value, window) if tables is None else tables
            counts, runs, ids = [], [], []
            for text in batch.column(batch.num_columns - 1):
                words = words_of(text.as_py())
                spans, found = scan(tables, words)
                counts.append(len(words))
                runs.append([{"start": a, "stop": b} for a, b in spans])
                ids.append(sorted(map(str, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(ids, pa.list_(pa.string()))], [f.name for f in schema])

    return map_arrow(source, run, schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = contamination(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + (x["stop"] - x["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs."""
    runs = fresh(docs, "runs")
    kept = docs.columns
    marked = docs.select(F.struct(*named(kept)).alias(runs), text_of().alias("text"))
    found = contamination(marked, benchmark, window).where(F.size("runs") == 0)
    return found.select(*(F.col(runs)[c].alias(c) for c in kept))


def digest(ids: Iterable) -> str:
    """The items digest of a set of ids."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
