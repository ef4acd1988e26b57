import hashlib
import itertools
import os
import random

import numpy as np
import pytest

from tessella.llm import line_dedup, near_dedup

from .all_pairs import least_reachable
from .helpers import ODD, clashing, empty_docs, odd_docs, union


def expected(docs):
    """n_lines, n_kept and the text of each document, by all pairs of lines."""
    places = []
    for doc, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r"):
                places.append((doc, at, line.strip(" \t\r")))
    texts = sorted({p[2] for p in places})
    sets = [{t[i : i + 7] for i in range(max(1, len(t) - 6))} for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = dict(zip(texts, union(len(texts), links), strict=True))
    first = {}
    for doc, at, line in places:
        first[root[line]] = min(first.get(root[line], (doc, at)), (doc, at))
    gone = {(doc, at) for doc, at, line in places if first[root[line]] != (doc, at)}
    out = {}
    for doc, text in docs:
        lines = [] if text is None else text.split("\n")
        left = [x for at, x in enumerate(lines) if (doc, at) not in gone]
        out[doc] = (len(lines), len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    bases = ["".join(rng.choices("abcdefghij klmno", k=rng.randint(3, 90))) for _ in range(30)]
    docs = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice("XYZ")
            lines.append(rng.choice(["", "  ", "\t"]) + "".join(line) + rng.choice(["", " \r"]))
            if rng.random() < 0.2:
                lines.append("  ")
        docs.append((doc, "\n".join(lines)))
    return docs


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_lines, r.n_kept, r.text_sha256) for r in line_dedup.report(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    assert found(spark, docs) == expected(docs)


def test_large_regions_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_WORDS", 0)
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST_WORDS", 0)
    docs = [(i, f"the very same long line of a page footer, but for number {i:03d}\nown line {i} {i * i} {i * 7}") for i in range(40)]
    assert found(spark, docs) == expected(docs)


#: Two bands that no depth cuts further.
FLAT = near_dedup.Forest(2, 3, (3,), (1,))


def flat(lines, hashes=FLAT.hashes):
    """Signatures that all lines have, so that their bands are too large at every depth."""
    return np.zeros((len(lines), hashes), "<u2")


def test_few_links_in_bands_that_no_depth_cuts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    monkeypatch.setattr(line_dedup, "LINES", FLAT)
    monkeypatch.setattr(line_dedup, "signatures", flat)
    rng = random.Random(6)
    docs = []
    for i in range(30):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))
        docs += [(i, line), (100 + i, f"{line[:-1]}X")]
    assert found(spark, docs) == expected(docs)


def test_bands_find_lines_at_the_threshold():
    """A pair of 0.8 is missed by one in 100,000 at most or so."""
    assert (1 - 0.8 ** line_dedup.LINES.depths[0]) ** line_dedup.LINES.trees < 2e-5


def test_signatures_of_lines():
    lines = ["short", "a", "exactly", "a line with some more characters", "é漢😀 and so on and on", "x" * 500]
    many = line_dedup.signatures(lines)
    for k, line in enumerate(lines):
        assert (many[k] == line_dedup.signatures([line])[0]).all()
    assert len({m.tobytes() for m in many}) == len(lines)
    assert line_dedup.signatures([]).shape == (0, line_dedup.LINES.hashes)
    rng = np.random.default_rng(1)
    a = "".join(map(chr, rng.integers(97, 123, 4000)))
    b = a[:3500] + "".join(map(chr, rng.integers(97, 123, 500)))
    x, y = line_dedup.signatures([a, b])
    share = len(line_dedup.shingles(a) & line_dedup.shingles(b)) / len(line_dedup.shingles(a) | line_dedup.shingles(b))
    assert abs((x == y).mean() - share) < 0.3


def test_odd_tables(spark):
    rows = line_dedup.dedup(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert (by[1][0].text, by[1][0].n_lines, by[1][0].n_kept) == (None, 0, 0)
    assert (by[2][0].text, by[2][0].n_lines) == ("", 1)
    assert (by[3][0].text, by[3][0].n_lines, by[3][0].n_kept) == ("  \n\t ", 2, 2)
    # A null id comes first, so its line stays and that of 6 goes; rows that repeat keep the same.
    assert by[None][0].n_kept == 1 and by[6][0].n_kept == 0
    assert [r.n_kept for r in by[7]] == [1, 1]
    assert line_dedup.dedup(empty_docs(spark)).count() == 0
    out = line_dedup.dedup(clashing(odd_docs(spark)))
    assert set(out.columns) == {*clashing(odd_docs(spark)).columns, "n_lines", "n_kept"}


def test_rows_that_repeat_an_id_lose_their_own_lines(spark):
    docs = [(None, "x line that is here\nonly in the first"), (None, "only in the second\nx line that is here"), (5, "own of five, row one\nshared by the two of them"), (5, "shared by the two of them\nown of five, row two, quite unlike")]
    rows = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    assert sorted(r.text for r in rows) == sorted(["x line that is here\nonly in the first", "only in the second", "own of five, row one", "shared by the two of them\nown of five, row two, quite unlike"])


def test_a_document_of_very_many_lines(spark):
    """200,000 lines, half of which go: no step takes lines times places."""
    text = "\n".join("the same line again and again" if i % 2 else "" for i in range(200_000))
    rows = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.dedup(spark.createDataFrame([(1, text), (2, "the same line again and again\nother")], "doc_id long, text string")).collect()}
    assert rows == {1: (200_000, 100_001), 2: (2, 1)}


def test_masks_that_are_too_large_to_broadcast(spark, monkeypatch):
    docs = corpus(5)
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_BYTES", 0)
    assert found(spark, docs) == expected(docs)
    df = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # Documents that no filter holds back go straight to the output.
    assert plan.startswith("Union")


def test_a_band_of_twenty_times_the_limit(spark, monkeypatch, capsys):
    monkeypatch.setattr(near_dedup, "REGION", 20)
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=180))
    lines = []
    for _ in range(400):
        line = list(base)
        for k in rng.sample(range(180), rng.choice([1, 2, 3])):
            line[k] = rng.choice("0123456789")
        lines.append("".join(line))
    docs = list(enumerate(lines))
    want, got = expected(docs), found(spark, docs)
    same = sum(want[d] == got[d] for d in want)
    with capsys.disabled():
        print(f" {same} of {len(want)} as by all pairs", end="")
    assert got == want


@pytest.mark.skipif("TESSELLA_LARGE" not in os.environ, reason="some minutes: set TESSELLA_LARGE to run it")
@pytest.mark.parametrize("table", ["check_s", "check_h"])
def test_equal_to_an_exact_join(spark, table):
    """All lines of a large table, against an exact join by prefix filter."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text").collect()]
    number, first = {}, []
    for doc, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\r"):
                k = number.setdefault(line, len(number))
                if k == len(first):
                    first.append((doc, at))
                else:
                    first[k] = min(first[k], (doc, at))
    sets = [frozenset(hash(x) for x in line_dedup.shingles(line)) for line in number]
    root = least_reachable(sets)
    keep = {}
    for k, r in enumerate(root):
        keep[r] = min(keep.get(r, first[k]), first[k])
    want = {}
    for doc, text in docs:
        left = [x for at, x in enumerate((text or "").split("\n")) if not x.strip(" \t\r") or keep[root[number[x.strip(" \t\r")]]] == (doc, at)]
        want[doc] = hashlib.sha256("\n".join(left).encode()).hexdigest()
    from tessella.llm.queries import op6_line_minhash

    got = {r.doc_id: r.text_sha256 for r in op6_line_minhash(spark, f"/root/testdata/{table}").collect()}
    wrong = [d for d in want if want[d] != got[d]]
    print(f"{table}: {len(docs)} documents, {len(sets)} lines, {len(wrong)} documents differ")
    assert not wrong
