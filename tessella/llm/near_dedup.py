"""Near-duplicate groups by an LSH forest.

Every text has a signature of 256 minhashes.  Each of 16 trees is an order of all texts by their
signatures, read from another hash on; texts whose longest common prefix in some tree has at least three
hashes are neighbours, i.e. they stand in one *region* of that order.  A region of at most REGION texts
is compared whole.  A larger one is sorted again by the hashes that follow: a range exchange
by the whole rotated signature, in which each task measures the common prefix of every two rows that follow each
other and cuts its rows where that is shortest until no run has more than REGION (so the depth is
that of each run, up to the whole signature).  This finds what is quickly connected.  Then all pairs of a cut region that
are not connected are compared, part by part in tasks of their own, so no pair is lost by a cut.

Equal shingle sets are one class first, so copies cost nothing from there on.  Two texts that are
neighbours in several trees are compared in the first of them.  A region of few classes gives pairs,
which are confirmed on the full sets of both texts.  In a larger region the texts
themselves come together: pairs are taken by falling estimate, a pair already connected is skipped,
the others are confirmed on their full sets, and only the confirmed links leave, fewer than texts.
Components of all confirmed links are found by star contraction.

Two texts of similarity J share a region with probability 1 - (1 - J**3)**16: 0.99999 at 0.8, whatever
the size of their regions.  Pairs whose estimate is more than four standard deviations below the threshold
aren't confirmed, which loses another 8e-5 of the pairs at 0.8 and fewer above.  The work in a region above
REGION grows with the square of those of its texts that its largest components leave out.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and stay; fewer
words than a shingle make one shingle; a null doc_id names no component: its row has its class's
smallest id, or null; a doc_id that repeats is taken to name one text; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sized
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bands
from .common import FILTER_BITS, bit_filter, bounded_batches, filter_bits, maybe_in, stash, text_of, without
from .components import components


@dataclass(frozen=True)
class Forest:
    """Trees, hashes from the start of one tree to that of the next, the common prefix of neighbours, and in how
    many orders a tree is sorted: one for all texts, then so many for each region that is too large."""

    trees: int
    step: int
    depths: tuple[int, ...]
    branches: tuple[int, ...]

    @property
    def hashes(self) -> int:
        return self.trees * self.step

    def least_estimate(self, similarity: float) -> float:
        """Four standard deviations below the similarity."""
        return similarity - 4 * (similarity * (1 - similarity) / self.hashes) ** 0.5


    def first_hash(self, tree: Column, order: Column) -> Column:
        """Where the label of a text begins in its signature, in an order of a region that is sorted again."""
        apart = self.hashes // (1 + self.orders)
        return (tree * self.step + self.depths[0] + order * apart) % self.hashes

    @property
    def orders(self) -> int:
        return self.branches[1] if len(self.branches) > 1 else 1


DOCUMENTS = Forest(16, 16, (3,), (1, 1))
#: Most classes of a region that are compared in one task, and of one that gives pairs.
REGION, FEW = 2000, 6
#: So many times REGION are in a part of a cut region, all of whose pairs of parts meet; and are held at once where it is cut.
FACES = 4
#: 64-bit words of a filter that is broadcast, and ids that are.
MAX_BROADCAST_WORDS, MAX_BROADCAST_ROWS = FILTER_BITS // 64, 1 << 21
#: Words whose hashes a worker remembers, the bytes of the longest, and shingles of the sets of a region that it holds.
MEMO_WORDS, LONGEST, HELD_SHINGLES = 500_000, 100, 1 << 22
#: Pairs of a region, by its rows, from which all its sets are multiplied, if it has no more rows than these; the
#: multiplications that cost as much as a pair; and the columns of one product.
MANY, MOST_ROWS, PRODUCT, COLUMNS = 8, 4096, 300_000, 2048
#: Pairs whose signatures are compared at once: their flags stay in a core's cache.
PAIRS_AT_ONCE = 1 << 12

LOWER = bytes((b | 32) if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20)
_A = (_RNG.integers(1, 1 << 32, 256, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
_C = _RNG.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


class Shingler:
    """Sets of word shingles as sorted arrays of 64-bit hashes."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().translate(LOWER).split()
        memo = self.memo
        try:
            hashes = [memo[w] for w in words]
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            hashes = []
            for w in words:
                if (x := memo.get(w)) is None:
                    x = xxhash.xxh3_64_intdigest(w)
                    if len(w) <= LONGEST:
                        memo[w] = x
                hashes.append(x)
        h = np.array(hashes, np.uint64)
        n = len(h)
        if not n:
            return h
        size = min(self.size, n)
        # The number of words is part of the hash, so a short text's sequence is no prefix of another's.
        x = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            x += h[k : n - size + 1 + k] * _C[k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return np.unique(x)

    @staticmethod
    def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
        return linked_sets(x, y, percent)


def linked_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted arrays without repeats."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False  # no intersection is larger than the one, no union smaller than the other
    merged = np.concatenate([x, y])
    merged.sort(kind="stable")  # two runs in order: one merge
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * both >= percent * (len(x) + len(y) - both)


class Sets:
    """The sets of a region's texts, made when they are asked for; of large ones only the latest stay."""

    def __init__(self, texts: pa.ChunkedArray, shingles) -> None:
        self.texts, self.shingles = texts, shingles
        self.made: dict[int, Sized] = {}
        self.size = 0

    def __getitem__(self, i: int) -> Sized:
        found = self.made.get(i)
        if found is None:
            found = self.shingles(self.texts[i].as_py())
            self.size += len(found)
            while self.size > HELD_SHINGLES and self.made:
                self.size -= len(self.made.pop(next(iter(self.made))))
            self.made[i] = found
        return found


    def shares(self, n: int, pairs: int) -> np.ndarray | None:
        """How many elements each two of the n sets have in common, if that costs less than so many pairs and fits."""
        size, own = 0, []
        for k in range(n):
            own.append(self.shingles(self.texts[k].as_py()))
            size += len(own[-1])
            if size > HELD_SHINGLES:
                return None
        values, column, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        # Elements of one set alone are in no product; the number of those that are left is the cost.
        place = np.cumsum(often > 1) - 1
        wide = int(place[-1]) + 1
        if n * n * wide > PRODUCT * pairs:
            return None
        row = np.repeat(np.arange(n), [len(x) for x in own])
        several = often[column] > 1
        row, at = row[several], place[column[several]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        out = np.zeros((n, n), np.float32)
        for a in range(0, wide, COLUMNS):
            first, last = np.searchsorted(at, (a, a + COLUMNS))
            block = np.zeros((n, min(COLUMNS, wide - a)), np.float32)
            block[row[first:last], at[first:last] - a] = 1
            out += block @ block.T
        share = out.astype(np.int32)  # exact: sums of ones below 2**24
        np.fill_diagonal(share, [len(x) for x in own])
        return share


def signature(shingles: np.ndarray, hashes: int = 256) -> bytes:
    """16 bits of each minhash."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    a, b = _A[:hashes], _B[:hashes, None]
    low = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        y = np.multiply.outer(a, x[at : at + 1024])
        y += b
        np.minimum(low, y.min(1), out=low)
    low ^= low >> 15
    low = low * np.uint32(0x2C1B3C6D)
    low ^= low >> 12
    return low.astype("<u2").tobytes()


FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, sig binary"


def features(docs: DataFrame, size: int) -> DataFrame:
    """The set size, a 128-bit digest of the set and the signature of each document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for text in batch.column(1):
                x = shingler(text.as_py())
                raw = x.tobytes()
                digest = xxhash.xxh3_128_digest(raw)
                n.append(len(x))
                k1.append(int.from_bytes(digest[:8], "little", signed=True))
                k2.append(int.from_bytes(digest[8:], "little", signed=True))
                sig.append(signature(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, FEATURES)


def _prefixes(forest: Forest) -> Column:
    """The first hashes of each tree."""
    return F.array(*(F.substring("sig", 2 * forest.step * k + 1, 2 * forest.depths[0]) for k in range(forest.trees)))


def filtered(rows: DataFrame, key: Column, keys: DataFrame, of_keys: Column, each: int = 16) -> DataFrame:
    """The rows whose key may be among the keys (a written table): most of the others go where they are read.  each:
    bits a key."""
    if not MAX_BROADCAST_WORDS:
        return rows
    bits = filter_bits(keys.count(), each, 64 * MAX_BROADCAST_WORDS)
    return maybe_in(rows, key, bit_filter(keys, of_keys, bits), bits, "__maybe").where("__maybe").drop("__maybe")


def _shared(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of keys whose region is in sizes, with its members.

    A filter of the regions goes first, since most texts have no neighbour at all.
    """
    return filtered(keys, F.col("region"), sizes, F.col("region"), 64).join(sizes, "region")


def regions(reps: DataFrame, forest: Forest = DOCUMENTS) -> tuple[DataFrame, DataFrame | None]:
    """(region, members, tree, rep, deep) of the regions of two classes or more and REGION at most, and
    (region, tree, rep, sig) of the larger ones.  reps: rep and sig.

    deep has a bit for each tree in which the text's region was larger, so that a pair can't rely on meeting there.
    """
    keyed = reps.select("rep", "sig", F.posexplode(_prefixes(forest)).alias("tree", "prefix"))
    keyed = keyed.withColumn("region", F.xxhash64("tree", "prefix")).drop("prefix")
    sizes = stash(keyed.groupBy("region").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    found = _shared(keyed.select("rep", "region", "tree"), sizes.where(F.col("members") <= REGION)).select("region", "members", "tree", "rep")
    large = sizes.where(F.col("members") > REGION)
    if large.isEmpty():
        return found.withColumn("deep", F.lit(0).cast("long")), None
    hot = stash(_shared(keyed, large).select("region", "tree", "rep", "sig"))
    return _with_deep(found, "rep", hot), hot


def _with_deep(rows: DataFrame, rep: str, hot: DataFrame | None) -> DataFrame:
    """rows with deep, of the text in the column rep."""
    if hot is None:
        return rows.withColumn("deep", F.lit(0).cast("long"))
    deep = hot.groupBy(F.col("rep").alias(rep)).agg(F.expr("bit_or(shiftleft(1L, tree))").alias("deep"))
    return rows.join(deep, rep, "left").withColumn("deep", F.coalesce("deep", F.lit(0).cast("long")))


def cuts(labels: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of sorted labels with two rows at least and ``most`` at most: cut where the common prefix of
    neighbours is shortest.  Equal labels are cut anywhere, with a row in two runs."""
    differ = labels[1:] != labels[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), labels.shape[1]) if len(labels) > 1 else np.zeros(0, np.int64)
    left = [(0, len(labels))]
    while left:
        a, b = left.pop()
        if b - a <= most:
            if b - a > 1:
                yield a, b
            continue
        between = prefix[a : b - 1]
        least = between.min()
        if least == labels.shape[1]:
            yield from ((k, min(k + most, b)) for k in range(a, b - 1, most - 1))
        else:
            at = [a, *(a + 1 + np.flatnonzero(between == least)).tolist(), b]
            left += zip(at, at[1:], strict=False)


def _again(hot: DataFrame, forest: Forest, percent: int) -> DataFrame:
    """The rows of the cut regions that have a probable link in a run of one of their orders, as _needed has them.

    This is to connect what is quickly connected, so pairs with an estimate below the threshold are left to the facing parts.
    """
    order = F.explode(F.sequence(F.lit(0), F.lit(forest.orders - 1)))
    spread = hot.select("region", "tree", "rep", "sig", order.alias("order"))
    label = F.substring(F.concat("sig", "sig"), 2 * forest.first_hash(F.col("tree"), F.col("order")) + 1, F.lit(2 * forest.hashes))
    spread = spread.select(F.xxhash64("region", "order").alias("run"), "rep", label.alias("label"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = percent / 100
        for group in grouped(batches, FACES * REGION):
            labels, ids, name = _sigs(group.column(2), forest.hashes), group.column(1).to_numpy(), group.column(0)[0].as_py()
            for a, b in cuts(labels, REGION):
                i, j, _ = region_pairs(0, ids, labels[a:b], forest, least)
                if len(i):
                    at = a + np.unique(np.concatenate([i, j]))
                    # A text stands in one run of an order only, but for those that join two.
                    region = xxhash.xxh3_64_intdigest(f"{name},{ids[a]},{ids[b - 1]}") - (1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), region)), pa.array(ids[at]), pa.array(np.full(len(at), -1, np.int32)), pa.array(np.zeros(len(at), np.int64)), group.column(2).take(pa.array(at)).combine_chunks()], ["region", "rep", "tree", "deep", "sig"])

    return spread.repartitionByRange("run", "label").sortWithinPartitions("run", "label").mapInArrow(run, "region long, rep long, tree int, deep long, sig binary")


def facing(hot: DataFrame, linked: DataFrame) -> DataFrame:
    """(region, rep, side, root, sig): pairs of parts of the cut regions, each as a region of its own.  side is
    0 or 1, or 2 for a part that faces itself, and four times the tree.

    hot: region, tree, rep and sig.  linked: node and root of what is connected already.  A component of more
    than FACES * REGION texts of a region has parts of its own, which don't meet each other; the other texts
    are dealt to parts by their component.  Any two texts of a region with different roots meet: either in
    two parts (side 0 and 1) or within one (side 2).
    """
    half = FACES * REGION
    rooted = hot.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = stash(rooted.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n")))
    rest = sizes.groupBy("region").agg(F.sum(F.when(F.col("n") <= half, F.col("n")).otherwise(0)).alias("rest"), F.count(F.lit(1)).alias("n_roots"))
    # A region of one component is done.
    some = stash(sizes.join(rest.where("n_roots > 1"), "region"))
    big = F.col("n") > half
    own = F.xxhash64("region", "root", F.pmod(F.xxhash64("rep", "region"), F.ceil(F.col("n") / half)))
    mixed = F.xxhash64("region", F.pmod(F.xxhash64("root", "region"), F.ceil(F.col("rest") / half)))
    dealt = rooted.join(some, ["region", "root"]).select("region", "tree", "rep", "root", "sig", F.when(big, own).otherwise(mixed).alias("part"), F.when(big, F.col("root")).alias("owner"))
    dealt = stash(dealt)
    parts = stash(dealt.groupBy("region", "part").agg(F.first("owner").alias("owner")))
    one, two = (parts.select("region", F.col("part").alias(f"part{k}"), F.col("owner").alias(f"owner{k}")) for k in (0, 1))
    pairs = one.join(two, "region").where("part0 <= part1 AND (owner0 IS NULL OR owner1 IS NULL OR owner0 <> owner1)")
    side = F.when(F.col("part0") == F.col("part1"), F.array(F.struct(F.col("part0").alias("part"), F.lit(2).alias("side"))))
    side = side.otherwise(F.array(F.struct(F.col("part0").alias("part"), F.lit(0).alias("side")), F.struct(F.col("part1").alias("part"), F.lit(1).alias("side"))))
    named = pairs.select("region", F.xxhash64("region", "part0", "part1").alias("name"), F.explode(side).alias("x")).select("region", "name", "x.part", "x.side")
    return dealt.join(stash(named), ["region", "part"]).select(F.col("name").alias("region"), "rep", (F.col("side") + 4 * F.col("tree")).alias("side"), "root", "sig")


def met_before(equal: np.ndarray, tree: np.ndarray, deep: np.ndarray, forest: Forest) -> np.ndarray:
    """Whether pairs share an uncut region of an earlier tree.  equal: pairs x hashes."""
    numbers = np.arange(forest.trees)
    shared = equal.reshape(len(equal), forest.trees, forest.step)[:, :, : forest.depths[0]].all(2)
    earlier = (numbers < tree[:, None]) & (deep[:, None] >> numbers & 1 == 0)
    return (shared & earlier).any(1)


def grouped(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """The rows of each value of the first column (in pieces of some ``most`` rows).  Equal values come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and (held[-1].column(0)[0] != batch.column(0)[a] or most and sum(map(len, held)) >= most):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with those of a region together.  Their tasks compute far more than they read, so small ones aren't joined."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region").sortWithinPartitions("region")


def _sigs(column: pa.Array | pa.ChunkedArray, hashes: int) -> np.ndarray:
    """Signatures as rows of 16-bit hashes."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(whole):
        return np.zeros((0, hashes), "<u2")
    # Binary cells follow each other in one buffer, and all have one size.
    _, offsets, data = whole.buffers()
    start = int.from_bytes(memoryview(offsets)[4 * whole.offset : 4 * whole.offset + 4], "little")
    return np.frombuffer(data, "<u2", len(whole) * hashes, start).reshape(len(whole), hashes)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many hashes of each row of x agree with those of each row of y."""
    if x.shape[1] < 128:
        # A plane of flags for each hash, and their sum.
        same = np.ascontiguousarray(x.T)[:, :, None] == np.ascontiguousarray(y.T)[:, None]
        return np.add.reduce(same.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
    same = x[:, None] == y[None]
    if same.shape[2] % 8:
        return same.sum(2)
    # Eight flags a word: sums of words are sums of each byte, at most 32 for 256 hashes; then pairs of bytes, and all.
    total = same.view(np.uint64).sum(2)
    pairs = (total & np.uint64(0x00FF00FF00FF00FF)) + (total >> np.uint64(8) & np.uint64(0x00FF00FF00FF00FF))
    return (pairs * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


def _small(members: DataFrame, forest: Forest, percent: int) -> DataFrame:
    """Pairs of the small regions whose estimate is high enough.  members: region, rep, tree, deep, sig."""
    kind = {"a": pa.int64(), "b": pa.int64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = forest.least_estimate(percent / 100)
        held = None
        for batch in (x for x in batches if x.num_rows):
            rows = (*(batch.column(k).to_numpy() for k in range(4)), _sigs(batch.column(4), forest.hashes))
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            # All rows of the batch at once: each with those that follow it in its region.
            region, ids, tree, deep, sigs = rows
            pairs = [np.zeros((0, 2), np.int64)]
            for d in range(1, min(FEW, len(region))):
                i = np.flatnonzero(region[:-d] == region[d:])
                i = i[i + d >= (0 if held is None else len(held[0]))]
                if len(i):
                    equal = sigs[i] == sigs[i + d]
                    i = i[(equal.mean(1) >= least) & ~met_before(equal, tree[i], deep[i], forest)]
                pairs.append(np.stack([ids[i], ids[i + d]], 1))
            found = np.sort(np.concatenate(pairs), 1)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=pa.schema(kind))
            # The next batch may go on with the last region.
            held = tuple(x[-FEW:] for x in rows)

    return dealt(members.select("region", "rep", "tree", "deep", "sig")).mapInArrow(run, "a long, b long").distinct()


def _paired(pairs: DataFrame, signs: DataFrame, forest: Forest, percent: int) -> DataFrame:
    """Those pairs whose estimate is high enough.  pairs: a, b, tree (the first of the small regions that they share)
    and deep.  signs: rep and the packed signature."""
    names = bands.packed(forest.hashes)
    one, two = (signs.select(F.col("rep").alias(end), *(F.col(c).alias(end + c) for c in names)) for end in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "tree", "deep", *(end + c for end in "ab" for c in names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = forest.least_estimate(percent / 100)
        for batch in (x for x in batches if x.num_rows):
            first, second = (bands.unpack(batch.columns[k : k + len(names)], forest.hashes) for k in (4, 4 + len(names)))
            equal = first == second
            ok = np.flatnonzero(equal.mean(1) >= least)
            tree, deep = (batch.column(k).to_numpy()[ok] for k in (2, 3))
            ok = ok[~met_before(equal[ok], tree, deep, forest)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(ok)) for k in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _by_bands(reps: DataFrame, forest: Forest, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Pairs of the small regions, as _small has them; the rows of the larger ones (region, rep, tree, deep, sig), and
    of those above REGION (region, tree, rep, sig).  reps: a written table of rep and the packed signature.

    As regions, for signatures of few hashes: only the numbers of texts are looked for, and signatures follow where
    two texts meet.
    """
    rows = stash(bands.shared(reps, forest, FEW, REGION))
    pairs = stash(rows.where("members = 0").groupBy("a", "b").agg(F.min("tree").alias("tree")))
    large = rows.where("members <> 0").select("region", "members", "tree", F.col("a").alias("rep"))
    signs = reps.select("rep", *bands.packed(forest.hashes))
    # As bytes only where needed; a join by text keeps them where the next needs them.
    binary = signs.join(large.select("rep").distinct(), "rep", "left_semi").select("rep", bands.binary(forest.hashes).alias("sig"))
    signed = large.join(binary, "rep")
    hot = None
    if not large.where("members < 0").isEmpty():
        hot = stash(signed.where("members < 0").select("region", "tree", "rep", "sig"))
    small = stash(_paired(_with_deep(pairs, "a", hot), signs, forest, percent))
    return small, _with_deep(signed.where("members > 0"), "rep", hot), hot


def region_pairs(tree: int, deep: np.ndarray, sigs: np.ndarray, forest: Forest, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a region that are to be compared in it: their places, and their estimates."""
    n, enough = len(sigs), least * forest.hashes
    step = max(1, PAIRS_AT_ONCE // max(1, n))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, n - 1, step):
        e = agreeing(sigs[a : min(n - 1, a + step)], sigs[a + 1 :])
        i, j = np.nonzero(e >= enough)
        i, j = i[j >= i], j[j >= i]
        if tree > 0 and len(i):
            equal = sigs[a + i] == sigs[a + 1 + j]
            new = ~met_before(equal, np.full(len(i), tree), deep[a + i], forest)
            i, j = i[new], j[new]
        found.append((a + i, a + 1 + j, e[i, j]))
    first, second, estimate = (np.concatenate(x) for x in zip(*found, strict=True))
    return first, second, estimate


def facing_pairs(side: np.ndarray, root: np.ndarray, sigs: np.ndarray, forest: Forest, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As region_pairs, those of two parts or within one: all that aren't connected already, in the first tree of which
    they share a region."""
    tree, side = int(side[0]) // 4, side % 4
    within = side[0] == 2
    left, right = (np.arange(len(side)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    enough = least * sigs.shape[1]
    for a in range(0, len(left), step):
        x, y = left[a : a + step], right[a:] if within else right
        e = agreeing(sigs[x], sigs[y])
        i, j = np.nonzero((e >= enough) & (root[x, None] != root[None, y]))
        if within:
            i, j = i[j > i], j[j > i]
        if tree and len(i):
            new = ~met_before(sigs[x[i]] == sigs[y[j]], np.full(len(i), tree), np.zeros(len(i), np.int64), forest)
            i, j = i[new], j[new]
        found.append((x[i], y[j], e[i, j]))
    first, second, estimate = (np.concatenate(x) for x in zip(*found, strict=True))
    return first, second, estimate


def compared(group: pa.Table, forest: Forest, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a group (a region, or parts that face each other) that are to be compared in it."""
    third, fourth, sigs = group.column(2), group.column(3).to_numpy(), _sigs(group.column(4), forest.hashes)
    if group.column_names[2] == "side":
        return facing_pairs(third.to_numpy(), fourth, sigs, forest, least)
    return region_pairs(third[0].as_py(), fourth, sigs, forest, least)


def _needed(members: DataFrame, forest: Forest, percent: int) -> DataFrame:
    """The rows of the larger regions that have a pair to be compared there.  members: region, rep, tree, deep, sig,
    or region, rep, side, root, sig."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, held, size = forest.least_estimate(percent / 100), [], 0
        for group in grouped(batches):
            i, j, _ = compared(group, forest, least)
            if len(i):
                held.append(group.take(np.unique(np.concatenate([i, j]))))
                size += len(held[-1])
            if size > 5000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    names = ["region", "rep", *(["side", "root"] if "side" in members.columns else ["tree", "deep"]), "sig"]
    return dealt(members.select(*names)).mapInArrow(run, f"region long, rep long, {names[2]} int, {names[3]} long, sig binary")


def region_links(group: pa.Table, sets: Sets, forest: Forest, percent: int) -> Iterator[tuple[int, int]]:
    """Confirmed links that connect whatever all confirmed links of the region's pairs would connect, fewer than texts."""
    linked, ids = sets.shingles.linked, group.column(1).to_pylist()
    quick = group.column_names[2] == "tree" and group.column(2)[0].as_py() < 0
    i, j, estimate = compared(group, forest, percent / 100 if quick else forest.least_estimate(percent / 100))
    order = np.argsort(-estimate, kind="stable")
    # What has one root is connected already.
    parent = np.unique(group.column(3).to_numpy(), return_inverse=True)[1] if group.column_names[3] == "root" else np.arange(len(ids))
    share = sets.shares(len(ids), len(order)) if len(order) > MANY * len(ids) and len(ids) <= MOST_ROWS else None
    if share is not None:
        # So many pairs that one product of all sets costs less than they do one by one.
        sizes = share.diagonal()
        both = share[i, j].astype(np.int64)
        order = order[(100 * both >= percent * (sizes[i] + sizes[j] - both))[order]]
    at, links = 0, 0
    while at < len(order):
        # Among the pairs to come, those that are connected by now are left out from time to time.
        if links:
            order = order[at:]
            order = order[parent[i[order]] != parent[j[order]]]
            at, links = 0, 0
        stop = at + max(256, (len(order) - at) // 16)
        for x, y in zip(i[order[at:stop]].tolist(), j[order[at:stop]].tolist(), strict=True):
            if parent[x] != parent[y] and (share is not None or linked(sets[x], sets[y], percent)):
                keep, gone = sorted((parent[x], parent[y]))
                parent[parent == gone] = keep
                links += 1
                yield ids[x], ids[y]
        at = stop


def _large(members: DataFrame, forest: Forest, shingler: Callable, percent: int) -> DataFrame:
    """Confirmed links of the larger regions.  members: those of _needed, and text."""

    def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler()
        links: list[tuple[int, int]] = []
        for group in grouped(batches):
            links += region_links(group, Sets(group.column(5), shingles), forest, percent)
            if len(links) > 10_000:
                yield made(links)
                links = []
        yield made(links)

    names = ["region", "rep", *(["side", "root"] if "side" in members.columns else ["tree", "deep"]), "sig", "text"]
    return dealt(members.select(*names)).mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, shingler: Callable, percent: int) -> DataFrame:
    """The pairs that are links on their full sets.  texts: rep and text."""
    one = pairs.join(texts.withColumnsRenamed({"rep": "a", "text": "ta"}), "a")
    two = one.join(texts.withColumnsRenamed({"rep": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler()
        for batch in batches:
            ok, known, second = [], None, None
            # Pairs come in the order of b.
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != known:
                    known, second = b, shingles(y.as_py())
                ok.append(shingles.linked(shingles(x.as_py()), second, percent))
            yield pa.RecordBatch.from_arrays(list(batch.select([0, 1]).filter(pa.array(ok, pa.bool_())).columns), ["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def roots(reps: DataFrame, texts: Callable[[DataFrame], DataFrame], forest: Forest, shingler: Callable, percent: int, packed: bool = False) -> DataFrame:
    """node and root of every rep that is linked to a smaller one.

    reps: rep and sig, or (packed) a written table of rep and the packed signature.  texts: makes rep and text of a
    table of wanted reps.  shingler: makes what turns a text into a set (a call) and tells whether two sets are linked.
    """
    if packed:
        pairs, many, hot = _by_bands(reps, forest, percent)
    else:
        found, hot = regions(reps, forest)
        members = stash(found)
        few, many = members.where(F.col("members") <= FEW), members.where(F.col("members") > FEW).join(reps, "rep")
        pairs = stash(_small(few.join(reps, "rep"), forest, percent))
    compared_ = _needed(many, forest, percent)
    needed = stash(compared_ if hot is None else compared_.unionByName(_again(hot, forest, percent)))
    wanted = stash(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(needed.select("rep")).distinct())
    full = stash(texts(wanted))
    links = _confirmed(pairs, full, shingler, percent).unionByName(_large(needed.join(full, "rep"), forest, shingler, percent))
    if hot is None:
        return components(links)
    linked = stash(components(links))
    needed = stash(_needed(facing(hot, linked), forest, percent))
    full = texts(stash(needed.select("rep").distinct()))
    more = _large(needed.join(full, "rep"), forest, shingler, percent)
    return components(linked.toDF("a", "b").unionByName(more))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and text of the wanted ids.  A filter of the ids is tested where the texts are read,
    so that hardly any other text moves."""
    source = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text"))
    return filtered(source, F.col("rep"), wanted, F.col("rep")).join(wanted, "rep", "left_semi").dropDuplicates(["rep"])


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    feats = stash(features(docs, shingle))
    some = feats.where("n_shingles > 0")
    classes = stash(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    named = classes.where("rep IS NOT NULL")
    # By the id of the class's first row, of which there is one: a class of many copies is no hot key here.
    first = named.select(F.col("rep").alias("doc_id"), "k1", "k2", "rep")
    reps = stash(some.select("doc_id", "k1", "k2", "sig").join(first, ["doc_id", "k1", "k2"]).select("rep", "sig").dropDuplicates(["rep"]))
    linked_ = roots(reps, lambda wanted: texts_of(docs, wanted), DOCUMENTS, partial(Shingler, shingle), percent)
    rooted = named.join(linked_.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    # Only classes of several rows, or that were linked, need to be looked up again.
    told = rooted.where("n > 1 OR component_id <> rep").select("k1", "k2", "component_id")
    out = some.select("doc_id", "n_shingles", "k1", "k2").join(told, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    # Texts without words are linked with nothing and go round the join.
    return out.unionByName(feats.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group left, all columns kept.  Texts that stay don't move (see without)."""
    gone = stash(groups(docs, shingle, percent).where("NOT kept").select("doc_id").distinct())
    return without(docs, gone, MAX_BROADCAST_ROWS, 64 * MAX_BROADCAST_WORDS)
