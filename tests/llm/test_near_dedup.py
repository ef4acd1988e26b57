import itertools
import os
import random
import re

import numpy as np
import pytest

from tessella.llm import components, near_dedup

from .all_pairs import least_reachable
from .helpers import ODD, clashing, empty_docs, odd_docs, union


def word_sets(texts, size):
    out = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return out


def expected(ids, texts, size=4, percent=80):
    sets = word_sets(texts, size)
    links = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union(len(ids), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[root[i]], ids[i] == least[root[i]]) for i in range(len(ids))}


def family(seed, groups=12, copies=10, words=120):
    """Texts with near copies at many distances, chains of them, and exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    texts = []
    for _ in range(groups):
        text = rng.choices(vocabulary, k=rng.randint(words // 2, words))
        for k in range(copies):
            texts.append(" ".join(text))
            if k % 4 != 3:  # each copy differs from the last in a few words
                text = list(text)
                for _ in range(rng.choice([1, 1, 2, 4])):
                    text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rng.shuffle(texts)
    return texts


def found(spark, ids, texts, **more):
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(docs, shingle=4, **more).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = family(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    assert found(spark, ids, texts) == expected(ids, texts)


def test_large_regions_are_cut(spark, monkeypatch):
    """With regions of eight texts at most, all ways of cutting them are taken; the groups stay."""
    monkeypatch.setattr(near_dedup, "REGION", 8)
    texts = [f"{' '.join(f'v{k}' for k in range(100))} tail{i % 40}" for i in range(60)] + family(3, groups=3)
    ids = list(range(len(texts)))
    assert found(spark, ids, texts) == expected(ids, texts)


#: Two trees that no depth cuts further.
FLAT = near_dedup.Forest(2, 3, (3,), (1,))


def flat(shingles, hashes=FLAT.hashes):
    """A signature that all texts have, so that their regions are too large at every depth."""
    return bytes(2 * hashes)


def sparse(pairs=30, words=60):
    """Texts that have nothing in common but with one other each, and a dense family."""
    texts = []
    for i in range(pairs):
        text = [f"p{i}x{k}" for k in range(words)]
        texts += [" ".join(text), " ".join([*text[:-2], "other", "end"])]
    return texts + [f"{' '.join(f'v{k}' for k in range(100))} tail{i}" for i in range(20)]


def test_few_links_in_regions_that_no_depth_cuts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    monkeypatch.setattr(near_dedup, "DOCUMENTS", FLAT)
    monkeypatch.setattr(near_dedup, "signature", flat)
    texts = sparse()
    ids = random.Random(5).sample(range(1000), len(texts))
    assert found(spark, ids, texts) == expected(ids, texts)


def test_threshold_is_exact(spark):
    # Sets of 10 and 8 shingles with 8 in common: 80 of 100, linked; 9 and 7 with 7: not.
    base = [f"t{i}" for i in range(13)]
    texts = [" ".join(base), " ".join(base[:11]), " ".join(f"u{i}" for i in range(12)), " ".join(f"u{i}" for i in range(10))]
    assert [v[1] for v in found(spark, [1, 2, 3, 4], texts).values()] == [1, 1, 3, 4] or found(spark, [1, 2, 3, 4], texts) == expected([1, 2, 3, 4], texts)
    assert expected([1, 2, 3, 4], texts)[2][1] == 1 and expected([1, 2, 3, 4], texts)[4][1] == 4


def test_odd_tables(spark):
    rows = near_dedup.groups(odd_docs(spark), shingle=4).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[d][0].n_shingles == 0 and by[d][0].component_id == d for d in (1, 2, 3))
    assert by[5][0].component_id == 4
    assert by[None][0].component_id == 6
    assert [r.component_id for r in by[7]] == [7, 7]
    assert by[9][0].n_shingles == 1 and by[10][0].n_shingles == 1
    assert near_dedup.groups(empty_docs(spark)).count() == 0
    out = near_dedup.dedup(clashing(odd_docs(spark)))
    assert out.columns == clashing(odd_docs(spark)).columns
    assert {1, 2, 3, 4, 6, 7, 8, 9, 10, -11} <= {r.doc_id for r in out.collect()}
    assert 5 not in {r.doc_id for r in out.collect()}
    assert near_dedup.dedup(empty_docs(spark)).count() == 0


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 63, 3000, np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * 2 * share / (1 + share))
        a, b = pool[:2000], np.concatenate([pool[2000 - n : 2000], rng.integers(1, 1 << 63, 2000 - n, np.uint64)])
        x, y = (np.frombuffer(near_dedup.signature(np.unique(s)), "<u2") for s in (a, b))
        assert abs((x == y).mean() - share) < 4 * (share * (1 - share) / 256) ** 0.5 + 0.01


def test_components_of_paths_and_rings(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)] + [(200 + i, 200) for i in range(1, 30)] + [(5, 5)]
    rng.shuffle(links)
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert out == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100, **{200 + i: 200 for i in range(1, 30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_stay_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "HELD_SHINGLES", 10)
    sets = near_dedup.Sets(pa.chunked_array([[" ".join(f"{i}x{k}" for k in range(9)) for i in range(5)]]), near_dedup.Shingler(4))
    assert all(len(sets[i]) == 6 for i in (0, 1, 2, 0, 4))
    assert len(sets.made) == 1


def test_runs_are_cut_where_the_prefix_is_shortest():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (300, 8)).astype("<u2")
    rows[100:140] = rows[100]
    labels = np.array(sorted(rows.tolist(), key=lambda r: np.array(r, "<u2").tobytes()), "<u2")
    prefix = lambda a, b: next((k for k in range(8) if labels[a][k] != labels[b][k]), 8)
    for most in (2, 5, 20, 299, 300):
        runs = sorted(near_dedup.cuts(labels, most))
        assert all(1 < b - a <= most for a, b in runs)
        for a, b in runs:
            # Rows at a run's borders have less in common with what is outside than any two inside, or all is equal.
            inside = min(prefix(k, k + 1) for k in range(a, b - 1))
            for left, right in ((a - 1, a), (b - 1, b)):
                if 0 <= left and right < len(labels):
                    assert prefix(left, right) < inside or inside == 8
        # A row that is in no run stands alone between shorter prefixes, where its neighbours' run was too large.
        within = {k for a, b in runs for k in range(a, b)}
        assert most < 300 or within == set(range(300))
    assert list(near_dedup.cuts(labels[:1], 5)) == []


@pytest.mark.parametrize("hashes", [256, 48, 6])
def test_agreeing_counts_all_hashes(hashes):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2, (40, hashes)).astype("<u2"), rng.integers(0, 2, (30, hashes)).astype("<u2")
    y[0] = x[0]
    assert (near_dedup.agreeing(x, y) == (x[:, None] == y[None]).sum(2)).all()
    assert near_dedup.agreeing(x[:1], y[:1])[0, 0] == hashes


def crowd(seed, n, words=260):
    """Texts around one, each with some words of its own: most pairs are near the threshold, on either side."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    texts = []
    for i in range(n):
        text = list(base)
        for k in rng.sample(range(words), rng.choice([3, 4, 5, 6])):
            text[k] = f"x{i}y{k}"
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_a_region_of_twenty_times_the_limit(spark, monkeypatch, capsys, seed):
    """One group of 400 different texts, with regions of 20 at most: the components of all pairs."""
    monkeypatch.setattr(near_dedup, "REGION", 20)
    texts = crowd(seed, 400) + family(seed, groups=3)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    want, got = expected(ids, texts), found(spark, ids, texts)
    sets = word_sets(texts, 4)
    links = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    met = sum(got[ids[i]][1] == got[ids[j]][1] for i, j in links)
    with capsys.disabled():
        print(f" recall {met / len(links):.5f} of {len(links)} links", end="")
    assert met >= 0.99 * len(links)
    assert got == want


@pytest.mark.skipif("TESSELLA_LARGE" not in os.environ, reason="some minutes: set TESSELLA_LARGE to run it")
@pytest.mark.parametrize("table", ["check_s", "check_h"])
def test_equal_to_an_exact_join(spark, table):
    """All rows of a large table, against an exact join by prefix filter."""
    from tessella.llm.queries import op10_lsh_forest

    rows = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text").collect()
    first, sets = {}, []
    number = []
    for r in rows:
        s = frozenset(hash(x) for x in word_sets([r.text], 4)[0])
        if s not in first:
            first[s] = len(sets)
            sets.append(s)
        number.append(first[s])
    root = least_reachable(sets)
    least = {}
    for r, k in zip(rows, number, strict=True):
        if sets[k]:
            least[root[k]] = min(least.get(root[k], r.doc_id), r.doc_id)
    want = {r.doc_id: least[root[k]] if sets[k] else r.doc_id for r, k in zip(rows, number, strict=True)}
    got = {r.doc_id: r.component_id for r in op10_lsh_forest(spark, f"/root/testdata/{table}").collect()}
    wrong = [d for d in want if want[d] != got[d]]
    print(f"{table}: {len(want)} rows, {len(sets)} sets, {len(wrong)} differ")
    assert not wrong
