"""Texts that share a band of their signatures, by sorting numbers.

A text has a key for each band (tree): its hashes there, and the number of the tree.  Keys go to buckets by their
hash.  What is exchanged is not a row a key but a block for each bucket that a task has keys for, and a bucket's
keys are sorted as one array.  Keys are whole, so no two bands are taken for one.

A worker holds one bucket, some ENTRIES keys.  Where a bucket grows beyond FULL, the keys that more than ``most``
texts have leave at once, with their texts; the others have that many at most.  So a band that very many texts
have is held nowhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a bucket, keys that a worker holds before it looks for frequent ones, and texts whose keys a task gathers.
ENTRIES, FULL, GATHERED = 1 << 19, 1 << 21, 1 << 16
#: Rows of a batch that leaves.
ROWS = 1 << 16
#: A block: one array after the other, each of the same number of entries.
BLOCK = ("<u4", "<u4", "<u4", "<u2", "u1")
WIDTH = sum(np.dtype(x).itemsize for x in BLOCK)
_MIX = np.uint64(0x9E3779B97F4A7C15)
SHARED = "a long, b long, region long, members int, tree int"


def pack(sigs: np.ndarray) -> np.ndarray:
    """Rows of 16-bit hashes as rows of longs, four hashes each."""
    n, hashes = sigs.shape
    whole = np.zeros((n, -(-hashes // 4) * 4), "<u2")
    whole[:, :hashes] = sigs
    return whole.view(">i8").astype(np.int64)


def unpack(columns: list[pa.Array], hashes: int) -> np.ndarray:
    """What was packed, from a column for each long."""
    longs = np.stack([c.to_numpy() for c in columns], 1)
    return longs.astype(">i8").view("<u2")[:, :hashes]


def packed(hashes: int) -> list[str]:
    """The names of the columns that a signature is packed into."""
    return [f"s{k}" for k in range(-(-hashes // 4))]


def binary(hashes: int) -> Column:
    """A column: the signature as bytes, from the packed ones."""
    return F.substring(F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in packed(hashes)))), 1, 2 * hashes)


def blocks(reps: np.ndarray, sigs: np.ndarray, forest, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of all bands of some texts."""
    n = len(reps)
    part = sigs.reshape(n, forest.trees, forest.step)
    key = np.zeros((forest.trees, n), np.uint64)
    for k in range(forest.depths[0]):
        key = key << np.uint64(16) | part[:, :, k].T
    tree = np.repeat(np.arange(forest.trees, dtype=np.uint8), n)
    key = key.ravel()
    mixed = ((key | tree.astype(np.uint64) << np.uint64(48)) * _MIX) >> np.uint64(32)
    bucket = (mixed * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    # Texts of a tree follow each other in a bucket, so that all but the low halves of numbers shrink well.
    order = np.argsort(bucket, kind="stable")
    rep = np.tile(reps.view(np.uint64), forest.trees)
    low = np.uint64(0xFFFFFFFF)
    arrays = [x[order].astype(kind) for x, kind in zip((rep & low, rep >> np.uint64(32), key & low, key >> np.uint64(32), tree), BLOCK, strict=True)]
    numbers, start = np.unique(bucket[order], return_index=True)
    for number, a, b in zip(numbers.tolist(), start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
        yield number, b"".join(x[a:b].tobytes() for x in arrays)


def entries(block) -> tuple[np.ndarray, np.ndarray]:
    """The keys (tree, then hashes) and texts of a block."""
    n, at, found = len(block) // WIDTH, 0, []
    for kind in BLOCK:
        found.append(np.frombuffer(block, kind, n, at).astype(np.int64))
        at += n * np.dtype(kind).itemsize
    return found[4] << 48 | found[3] << 32 | found[2], found[1] << 32 | found[0]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and how many it has."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.diff(np.append(start, len(keys)))


def _large(keys: np.ndarray, reps: np.ndarray, members: np.ndarray | int) -> list[np.ndarray]:
    return [reps, np.zeros_like(reps), keys, np.broadcast_to(np.int32(members), keys.shape), (keys >> 48).astype(np.int32)]


class Bucket:
    """The keys of one bucket, as they come."""

    def __init__(self, few: int, most: int, full: int) -> None:
        self.few, self.most, self.full = few, most, full
        self.keys: list[np.ndarray] = []
        self.reps: list[np.ndarray] = []
        self.hot = np.zeros(0, np.int64)
        self.held, self.limit = 0, full

    def _ordered(self) -> tuple[np.ndarray, np.ndarray]:
        keys, reps = np.concatenate(self.keys), np.concatenate(self.reps)
        order = np.argsort(keys)
        return keys[order], reps[order]

    def add(self, keys: np.ndarray, reps: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Takes entries; yields columns of SHARED for those of bands that are known to have more than ``most``."""
        if len(self.hot):
            known = np.isin(keys, self.hot)
            if known.any():
                yield _large(keys[known], reps[known], -1)
                keys, reps = keys[~known], reps[~known]
        self.keys.append(keys)
        self.reps.append(reps)
        self.held += len(keys)
        if self.held > self.limit:
            keys, reps = self._ordered()
            start, n = _runs(keys)
            self.hot = np.concatenate([self.hot, keys[start[n > self.most]]])
            gone = np.repeat(n > self.most, n)
            if gone.any():
                yield _large(keys[gone], reps[gone], -1)
            self.keys, self.reps = [keys[~gone]], [reps[~gone]]
            self.held = len(self.keys[0])
            self.limit = max(self.full, 2 * self.held)

    def end(self) -> Iterator[list[np.ndarray]]:
        """Columns of SHARED for what is held."""
        if not self.held:
            return
        keys, reps = self._ordered()
        start, n = _runs(keys)
        for size in range(2, self.few + 1):
            at = start[n == size]
            i, j = np.triu_indices(size, 1)
            x, y = reps[at[:, None] + i].ravel(), reps[at[:, None] + j].ravel()
            none = np.zeros_like(x)
            yield [np.minimum(x, y), np.maximum(x, y), none, none.astype(np.int32), np.repeat(keys[at] >> 48, len(i)).astype(np.int32)]
        many = np.repeat(n > self.few, n)
        if many.any():
            members = np.where(n > self.most, -1, n)
            yield _large(keys[many], reps[many], np.repeat(members, n)[many].astype(np.int32))


def dealt_blocks(reps: DataFrame, forest, buckets: int) -> DataFrame:
    """(bucket, block) of all bands.  reps: rep and the packed columns."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        found = list(blocks(table.column(0).to_numpy(), unpack(table.columns[1:], forest.hashes), forest, buckets))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "block"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (x for x in batches if x.num_rows):
            held.append(batch)
            n += batch.num_rows
            if n >= GATHERED:
                yield made(held)
                held, n = [], 0
        if held:
            yield made(held)

    return reps.select("rep", *packed(forest.hashes)).mapInArrow(run, "bucket int, block binary")


def shared(reps: DataFrame, forest, few: int, most: int) -> DataFrame:
    """The bands that two texts or more have: a and b (a < b), members 0 and tree for each two texts of one that has
    ``few`` at most; a (a text), region, members and tree for each text of a larger one, with members -1 if it has more
    than ``most``.

    reps: a written table of rep and the packed columns.  A tree's hashes are 48 bits at most.
    """
    if forest.depths[0] > 3:
        raise ValueError("a band has three hashes at most")
    tasks, full = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), FULL
    buckets = tasks * (1 + reps.count() * forest.trees // (ENTRIES * tasks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Iterable[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for columns in found:
                for a in range(0, len(columns[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + ROWS]) for x in columns], ["a", "b", "region", "members", "tree"])

        now, held = None, Bucket(few, most, full)
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    yield from out(held.end())
                    now, held = bucket, Bucket(few, most, full)
                yield from out(held.add(*entries(block.as_buffer())))
        yield from out(held.end())

    # Dealt by number, as many buckets to each task.
    return dealt_blocks(reps, forest, buckets).repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket").mapInArrow(run, SHARED)
