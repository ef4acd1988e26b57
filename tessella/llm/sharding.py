"""Sharding by histogram sort, with shards of nearly equal bytes.

Rows have a key of two 64-bit numbers: the hash of the text, then the hash of the id.  The key order
is cut into shards at splitters that are found without sorting: a pass counts bytes and rows exactly
between candidate key boundaries (with partial aggregation, over slim rows in the shared folder), and
the driver keeps the cells of the histogram, never rows.  A cell that holds a wanted splitter farther
than the tolerance from its edges, or too many bytes for one task, gets finer boundaries in the next
pass; cells of one text alone go on with the hash of the id.  Then all rows move once, to the part of
their shard that the splitters name, and the exact counts give each part its first slot.

Equal texts are neighbours in the key order, so they share a shard unless a splitter must cut their
group to stay within ``whole`` of the wanted size.  Rows that are equal in text and id have one key, which no
splitter can cut.  Where they are too many for a part, or a splitter falls among them, they are written to the
shared folder and numbered there (by the task that wrote them, then by place), and their number takes the place of
the key's last digits: such rows are dealt out by arithmetic, without an exchange.

Parts have 128 MB, or 1/2**18 of all bytes if that is more.

Defined cases: a null text has no bytes and size 1; rows that repeat text and id share a key, and a
shard if they are TOGETHER at most; null ids are hashed like any id; an empty table gives an empty result; columns of the input
named shard or slot are replaced.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, named, stash, text_of

#: Bits of the first histogram of a hash, and of each refinement.
FIRST, MORE = 16, 12
#: Bytes that one task should sort, if the histogram's first cells can be as small.
PART_BYTES = 128 << 20
#: Rows that are equal in text and id stay together if they are no more than this.
TOGETHER = 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Cell:
    """The rows with hlo <= h <= hhi and dlo <= d <= dhi; the next histogram is over axis 0 (h) or 1 (d) of width 2**bits."""

    hlo: int
    hhi: int
    dlo: int
    dhi: int
    axis: int
    bits: int
    size: int
    rows: int
    #: Of rows with one key: the number of the first.
    first: int = 0

    @property
    def splits(self) -> bool:
        return self.bits > 0

    @property
    def order(self) -> tuple[int, int, int]:
        return self.hlo, self.dlo, self.first


def _digit(axis: str, first: str, x: str, lo: str, shift: str) -> str:
    return f"CASE WHEN {first} THEN shiftright({x}, {64 - FIRST}) ELSE shiftright({x} - {lo}, {shift}) END"


def _first(keys: DataFrame) -> list[Cell]:
    """The first histogram: h in 2**FIRST cells."""
    width = 64 - FIRST
    rows = keys.groupBy(F.expr(f"shiftright(h, {width})").alias("digit")).agg(*_measures()).collect()
    return [_cell(None, r, r.digit << width, width) for r in rows]


def _measures() -> list:
    return [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}{k}") for c in "hd" for k, f in ((0, F.min), (1, F.max)))]


def _cell(parent: Cell | None, r, lo: int, bits: int) -> Cell:
    """The cell of a histogram's row.  One text alone goes on with d, one key alone does not split."""
    if r.h0 == r.h1:
        if r.d0 == r.d1:
            return Cell(r.h0, r.h0, r.d0, r.d0, 1, 0, r.bytes, r.n)
        if parent is None or parent.axis == 0:
            return Cell(r.h0, r.h0, LOW, HIGH, 1, 64, r.bytes, r.n)
        return Cell(r.h0, r.h0, lo, lo + (1 << bits) - 1, 1, bits, r.bytes, r.n)
    return Cell(lo, lo + (1 << bits) - 1, LOW, HIGH, 0, bits, r.bytes, r.n)


def _pieces(cell: Cell, wanted: list[float], before: int) -> list[Cell]:
    """A cell of equal rows, cut by their numbers at the rows nearest to the wanted splitters.  before: bytes before the cell."""
    each = cell.size // cell.rows
    cuts = sorted({0, cell.rows, *(min(cell.rows, round((w - before) / each)) for w in wanted if before < w < before + cell.size)})
    return [Cell(cell.hlo, cell.hhi, cell.dlo, cell.dhi, 2, 0, (b - a) * each, b - a, a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _refined(keys: DataFrame, cells: list[Cell], most: float, exact: set[int]) -> list[Cell]:
    """Finer cells in place of the given ones: one pass over the keys.  Those in exact (by number) hold a splitter,
    and become as fine as a pass can make them, the others as fine as ``most`` asks for."""
    spark = keys.sparkSession
    table = []
    for number, c in enumerate(cells):
        more = MORE if number in exact else min(MORE, 1 + math.ceil(math.log2(max(2, c.size / most))))
        shift = c.bits - (FIRST if c.bits == 64 else min(more, c.bits))
        table.append((number, c.hlo >> (64 - FIRST), c.hlo, c.hhi, c.dlo, c.dhi, c.axis, c.bits == 64, shift))
    # At most one row a cell of the histogram: bounded by the number of cells, whatever the input.
    probes = spark.createDataFrame(table, "cell int, bin long, hlo long, hhi long, dlo long, dhi long, axis int, whole boolean, shift int")
    rows = keys.withColumn("bin", F.expr(f"shiftright(h, {64 - FIRST})")).join(F.broadcast(probes), "bin").where("h BETWEEN hlo AND hhi AND d BETWEEN dlo AND dhi")
    digit = F.expr(f"CASE WHEN axis = 0 THEN shiftright(h - hlo, shift) ELSE {_digit('d', 'whole', 'd', 'dlo', 'shift')} END")
    out = []
    for r in rows.groupBy("cell", digit.alias("digit")).agg(*_measures()).collect():
        c, shift = cells[r.cell], table[r.cell][-1]
        base = 0 if c.bits == 64 else c.dlo if c.axis else c.hlo
        out.append(_cell(c, r, base + (r.digit << shift), shift))
    return out


def _edges(cells: list[Cell]) -> list[int]:
    """Bytes before each cell, and all bytes."""
    out = [0]
    for c in cells:
        out.append(out[-1] + c.size)
    return out


def histogram(keys: DataFrame, shards: int, tolerance: float, whole: float, parts: int) -> tuple[list[Cell], list[int]]:
    """Cells in key order, and for each splitter the number of cells before it.

    keys: h, d and size.
    """
    cells = sorted(_first(keys), key=lambda c: c.order)
    total = sum(c.size for c in cells)
    wanted = [total * k / shards for k in range(1, shards)]
    most = _most(total, parts)
    while True:
        edges = _edges(cells)
        finer = {i for i, c in enumerate(cells) if c.splits and c.rows > 1 and c.size > most}
        equal = {i for i, c in enumerate(cells) if not c.splits and c.axis < 2 and c.rows > TOGETHER and c.size > most}
        at, exact = [], set()
        for w in wanted:
            i = bisect.bisect_right(edges, w) - 1
            nearest = i if i + 1 >= len(edges) or w - edges[i] <= edges[i + 1] - w else i + 1
            at.append(nearest)
            if i < len(cells):
                bound = (whole if cells[i].axis else tolerance) * total / shards
                if cells[i].axis < 2 and cells[i].rows > 1 and abs(w - edges[nearest]) > bound:
                    if cells[i].splits:
                        finer.add(i)
                        exact.add(i)
                    elif cells[i].rows > TOGETHER:
                        equal.add(i)
        if not finer and not equal:
            return cells, at
        made = [p for i in equal for p in _pieces(cells[i], wanted, edges[i])]
        if finer:
            coarse = sorted(finer)
            made += _refined(keys, [cells[i] for i in coarse], most, {k for k, i in enumerate(coarse) if i in exact})
        cells = sorted([*(c for i, c in enumerate(cells) if i not in finer and i not in equal), *made], key=lambda c: c.order)


def _most(total: int, parts: int) -> float:
    """The bytes of a part."""
    return max(min(PART_BYTES, total / max(1, parts)), total / (1 << 18))


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, whole: float = 0.01) -> DataFrame:
    """docs with shard (from 0) and slot (gapless from 0 in its shard, in key order)."""
    spark = docs.sparkSession
    h, d, part = (fresh(docs, x) for x in ("h", "d", "part"))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    text = text_of()
    keyed = docs.select(*named(kept), F.xxhash64(text).alias(h), F.xxhash64(F.col("doc_id"), F.lit(1)).alias(d))
    keys = stash(docs.select(F.xxhash64(text).alias("h"), F.xxhash64(F.col("doc_id"), F.lit(1)).alias("d"), (F.octet_length(text) + 1).cast("long").alias("size")))
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells, splits = histogram(keys, shards, tolerance, whole, max(tasks, shards))
    # Parts: runs of cells of one shard.  (shard, first slot, first key) by number.
    total = sum(c.size for c in cells)
    most = _most(total, max(tasks, shards))
    #: Pieces of keys whose rows go by their numbers: h, d, first number, one past the last, shard, first slot.
    dealt: list[tuple[int, int, int, int, int, int]] = []
    parts: list[tuple[int, int, int]] = []
    bins: dict[int, list] = {}
    at, size, slot, fresh_part = 0, 0.0, 0, True
    for i, c in enumerate(cells):
        before = at
        while at < len(splits) and splits[at] <= i:
            at += 1
        if at != before or not i:
            slot = 0
        if c.axis == 2:
            # No more than one a key and shard.
            dealt.append((c.hlo, c.dlo, c.first, c.first + c.rows, at, slot))
            slot += c.rows
            fresh_part = True
            continue
        if fresh_part or at != before or size + c.size > most:
            fresh_part = False
            parts.append((len(parts), at, slot))
            size = 0.0
            bins.setdefault(c.hlo >> (64 - FIRST), [len(parts) - 2, []])[1].append((c.hlo, c.dlo))
        else:
            bins.setdefault(c.hlo >> (64 - FIRST), [len(parts) - 1, []])
        size += c.size
        slot += c.rows
    # One row a part and one a cell of the first histogram: bounded as the histogram is.
    bounds = spark.createDataFrame([(b, first, starts) for b, (first, starts) in bins.items()], "bin long, first int, starts array<struct<h: long, d: long>>")
    bounds = bounds.select(*(F.col(c).alias(fresh(docs, c)) for c in bounds.columns))
    bin_, first, starts = bounds.columns
    offsets = spark.createDataFrame(parts, f"{part} int, shard int, before long")
    before = fresh(docs, "before")
    offsets = offsets.withColumnRenamed("before", before)
    if dealt:
        numbered, keyed = _numbered(keyed, h, d, dealt, kept)
    number = F.col(first) + F.size(F.filter(F.col(starts), lambda s: s <= F.struct(F.col(h).alias("h"), F.col(d).alias("d"))))
    placed = keyed.withColumn(bin_, F.expr(f"shiftright({h}, {64 - FIRST})")).join(F.broadcast(bounds), bin_).withColumn(part, number.cast("int")).drop(bin_, first, starts)
    rank = F.row_number().over(Window.partitionBy(part).orderBy(h, d, "doc_id"))
    slots = placed.withColumn("slot", rank.cast("long"))
    out = slots.join(F.broadcast(offsets), part).select(*named(kept), "shard", (F.col("slot") - 1 + F.col(before)).alias("slot"))
    return out.unionByName(numbered) if dealt else out


def _numbered(keyed: DataFrame, h: str, d: str, dealt: list[tuple[int, int, int, int, int, int]], kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of keys that are cut by number, with shard and slot; and the other rows.

    A task numbers its own rows of a key; how many the tasks before it have of that key is a sum over a row a
    task and key.
    """
    spark = keyed.sparkSession
    mark, task, at, n, start, stop, base = (fresh(keyed, x) for x in ("mark", "task", "at", "n", "start", "stop", "base"))
    # At most a row a shard for each key that is larger than a part.
    pieces = spark.createDataFrame(dealt, f"{h} long, {d} long, {start} long, {stop} long, shard int, {base} long")
    hot = pieces.select(h, d).distinct()
    rows = stash(keyed.join(F.broadcast(hot), [h, d], "left_semi").withColumn(mark, F.monotonically_increasing_id()))
    own = rows.withColumn(task, F.shiftright(mark, 33))
    local = Window.partitionBy(h, d, task).orderBy(mark)
    counts = own.groupBy(h, d, task).agg(F.count(F.lit(1)).alias(n))
    earlier = counts.select(h, d, task, F.coalesce(F.sum(n).over(Window.partitionBy(h, d).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n))
    placed = own.withColumn(at, F.row_number().over(local) - 1).join(earlier, [h, d, task]).withColumn(at, F.col(at) + F.col(n))
    found = placed.join(F.broadcast(pieces), [h, d]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop)))
    return found.select(*named(kept), "shard", (F.col(base) + F.col(at) - F.col(start)).cast("long").alias("slot")), keyed.join(F.broadcast(hot), [h, d], "left_anti")


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, read from the rows after the exchange."""
    placed = shard(docs.select("doc_id", "text"), shards)
    text = text_of()
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
