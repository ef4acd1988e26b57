import random
import re

import pytest

from tessella.llm import decontam
from tessella.llm.queries import ORACLE_SQL, op4_decontam

from .helpers import CLASHING, DATA, ODD, clashing, empty_docs, needs_data, odd_docs, same_columns

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, said in items:
        w = words(said)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(own), len(hit), len(found), decontam.digest(found), bool(hit)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ab", "é", "z9", "word", "漢字"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(8)]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choices([*vocabulary, "other", "x-y"], k=rng.randint(0, 15))))
            if rng.random() < 0.4:
                parts.append(rng.choice(items)[1].upper().replace(" ", rng.choice([" ", ", ", "\n"])))
        docs.append((d, " ... ".join(parts)))
    return items, docs


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [1 << 20, 30])
def test_against_brute_force(spark, monkeypatch, seed, block):
    items, docs = corpus(seed)
    monkeypatch.setattr(decontam.contamination, "__defaults__", (decontam.WINDOW, block))
    rows = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == {d: brute(t, items) for d, t in docs}


def test_shifts_skip_and_find():
    windows = {tuple(f"w{i}".encode() for i in range(10)): [1]}
    search = decontam.Searcher(windows, 10)
    text = [b"x"] * 50 + [f"w{i}".encode() for i in range(10)] + [b"y"] * 50
    assert list(search.occurrences(text)) == [(50, [1])]
    assert list(search.occurrences(text[:59])) == []


def test_odd_tables(spark):
    items = spark.createDataFrame([(1, "said TWICE"), (1, "said twice"), (2, None), (3, ""), (4, "..."), (5, "id")], "item_id long, text string")
    rows = decontam.report(odd_docs(spark), items).collect()
    assert len(rows) == len(ODD)
    hit = sorted(str(r.doc_id) for r in rows if r.contaminated)
    assert hit == sorted(["4", "5", "None", "6", "7", "7"])
    assert decontam.report(empty_docs(spark), items).count() == 0
    none = decontam.report(odd_docs(spark), spark.createDataFrame([], "item_id long, text string")).collect()
    assert not any(r.contaminated for r in none)
    clean = decontam.clean(clashing(odd_docs(spark)), items)
    assert clean.columns == clashing(odd_docs(spark)).columns
    assert clean.count() == len(ODD) - 6
    for block in (1 << 20, 5):
        out = decontam.contamination(clashing(odd_docs(spark)), items, block_bytes=block)
        assert same_columns(out, [c for c in CLASHING if c not in ("runs", "n_words")]) and out.count() == len(ODD)


@needs_data
def test_query(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    wanted = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op4_decontam']})").fetchall()
    assert sorted(tuple(r) for r in op4_decontam(spark, DATA).select(*cols).collect()) == sorted(wanted)
