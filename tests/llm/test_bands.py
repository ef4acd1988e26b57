import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tessella.llm import bands, line_dedup, near_dedup

FOREST = near_dedup.Forest(4, 3, (3,), (1, 1))


def signs(n, seed, values=3):
    """Signatures of few values, so that bands are shared; and rep numbers that need more than 32 bits."""
    rng = np.random.default_rng(seed)
    return np.arange(n, dtype=np.int64) * 7 + (5 << 33), rng.integers(0, values, (n, FOREST.hashes)).astype("<u2") * 21845


def expected(reps, sigs, few, most):
    """Pairs of small bands, and texts of larger ones with their number, or -1."""
    by = defaultdict(list)
    for rep, sig in zip(reps.tolist(), sigs.tolist(), strict=True):
        for tree in range(FOREST.trees):
            by[tree, tuple(sig[3 * tree : 3 * tree + 3])].append(rep)
    pairs, large = [], []
    for (tree, _), own in by.items():
        if 2 <= len(own) <= few:
            pairs += [(a, b, tree) for a in own for b in own if a < b]
        elif len(own) > few:
            large += [(rep, len(own) if len(own) <= most else -1, tree) for rep in own]
    return sorted(pairs), sorted(large)


def frame(spark, reps, sigs):
    rows = [(int(rep), *map(int, x)) for rep, x in zip(reps, bands.pack(sigs), strict=True)]
    return spark.createDataFrame(rows, "rep long, " + ", ".join(f"{c} long" for c in bands.packed(FOREST.hashes)))


def test_packed_signatures_come_back(spark):
    sigs = np.random.default_rng(4).integers(0, 1 << 16, (20, 6)).astype("<u2")
    longs = bands.pack(sigs)
    assert (bands.unpack([pa.array(x) for x in longs.T], 6) == sigs).all()
    rows = spark.createDataFrame([tuple(map(int, x)) for x in longs], "s0 long, s1 long").select(bands.binary(6).alias("sig")).collect()
    assert [bytes(r.sig) for r in rows] == [x.tobytes() for x in sigs]


def test_shared_bands_against_a_plain_loop(spark):
    reps, sigs = signs(300, 1, values=6)
    sigs[:100, :3] = 9  # one band that very many have
    rows = bands.shared(frame(spark, reps, sigs).repartition(3), FOREST, 3, 20).collect()
    pairs, large = expected(reps, sigs, 3, 20)
    assert sorted((r.a, r.b, r.tree) for r in rows if not r.members) == pairs
    assert sorted((r.a, r.members, r.tree) for r in rows if r.members) == large
    assert {m for _, m, _ in large} > {-1}
    by = defaultdict(set)
    for r in rows:
        if r.members:
            by[r.region].add((r.members, r.tree))
    assert all(len(x) == 1 for x in by.values())


def test_a_bucket_holds_no_band_that_very_many_have():
    reps, sigs = signs(4000, 2, values=40)
    sigs[::2, :3] = 1
    sigs[1::3, 6:9] = 2
    held, rows, most_held = bands.Bucket(3, 50, 500), [], 0
    for a in range(0, 4000, 100):
        for _, block in bands.blocks(reps[a : a + 100], sigs[a : a + 100], FOREST, 1):
            for columns in held.add(*bands.entries(block)):
                rows += zip(*(c.tolist() for c in columns), strict=True)
            frequent = sum(int((k == held.hot[0]).sum()) for k in held.keys) if len(held.hot) else 0
            most_held = max(most_held, frequent)
    assert len(held.hot) == 2 and most_held == 0
    for columns in held.end():
        rows += zip(*(c.tolist() for c in columns), strict=True)
    pairs, large = expected(reps, sigs, 3, 50)
    assert sorted((a, b, tree) for a, b, _, members, tree in rows if not members) == pairs
    assert sorted((a, members, tree) for a, _, _, members, tree in rows if members) == large


def test_bands_are_exchanged_as_blocks(spark):
    """Not a row for each band of each text, which was the larger part of the cost of op6_line_minhash."""
    reps, sigs = signs(5000, 3, values=50)
    assert bands.dealt_blocks(frame(spark, reps, sigs).coalesce(2), FOREST, 8).count() <= 2 * 8


def test_lines_go_by_blocks(spark, monkeypatch):
    def by_rows(*_):
        raise AssertionError("a row for each band of each line")

    monkeypatch.setattr(near_dedup, "regions", by_rows)
    rng = random.Random(5)
    text = "\n".join("".join(rng.choices("abcdefgh ", k=60)) for _ in range(50))
    docs = spark.createDataFrame([(1, text), (2, text[:59] + "X")], "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in line_dedup.dedup(docs).collect()} == {1: 50, 2: 0}


def test_dense_bands_of_lines_give_the_same_as_small_ones(spark, monkeypatch):
    """Bands above REGION, those between and small ones at once."""
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=160))
    lines = []
    for k in range(120):
        line = list(base if k % 3 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=80)))
        line[rng.randrange(len(line))] = rng.choice("0123456789")
        lines += ["".join(line), "".join(line[:-1]) + "!"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.n_kept for r in line_dedup.dedup(docs).collect()}
    monkeypatch.setattr(near_dedup, "REGION", 12)
    assert {r.doc_id: r.n_kept for r in line_dedup.dedup(docs).collect()} == want
    assert sum(want.values()) == 41
