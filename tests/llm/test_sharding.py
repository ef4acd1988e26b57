import random
import zlib
from collections import Counter, defaultdict

import pytest

from tessella.llm import sharding

from .helpers import CLASHING, ODD, clashing, empty_docs, odd_docs, same_columns


def checked(rows, shards, tolerance=0.02):
    """The laws: gapless slots, near equal bytes, equal texts together."""
    slots, size, texts = defaultdict(list), Counter(), defaultdict(set)
    for text, shard, slot in rows:
        slots[shard].append(slot)
        size[shard] += len((text or "").encode()) + 1
        texts[text].add(shard)
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(size.values())
    largest = max(len((t or "").encode()) + 1 for t, *_ in rows)
    assert all(abs(size[k] - total / shards) <= tolerance * total / shards + largest for k in range(shards))
    return texts


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_bytes_are_near_equal(spark, shards):
    rng = random.Random(shards)
    docs = [(i, "".join(rng.choices("abc é", k=rng.randint(0, 400))), None) for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string, x string").repartition(4), shards)
    rows = [(r.text, r.shard, r.slot) for r in out.collect()]
    assert len(rows) == len(docs)
    texts = checked(rows, shards)
    assert all(len(s) == 1 for t, s in texts.items() if t)


def test_hot_texts_are_cut(spark):
    """A text that has more than a shard's bytes is cut by the ids; others stay whole."""
    docs = [(i, "the same for half of all rows" if i % 2 else f"own text number {i} of the others") for i in range(4000)]
    out = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 8)
    texts = checked([(r.text, r.shard, r.slot) for r in out.collect()], 8)
    assert len(texts["the same for half of all rows"]) >= 4
    assert all(len(s) == 1 for t, s in texts.items() if t.startswith("own"))


def test_same_whatever_the_partitions(spark):
    docs = [(i, f"text {i % 50} {i}") for i in range(500)]
    found = [{r.doc_id: (r.shard, r.slot) for r in sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), 4).collect()} for n in (1, 7)]
    assert found[0] == found[1]


def test_report(spark):
    rows = sharding.report(odd_docs(spark), 8).collect()
    assert len(rows) == len(ODD)
    by = Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows)
    assert by == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for d, t, *_ in ODD)
    assert all(0 <= r.shard < 8 for r in rows)


def test_odd_tables(spark):
    assert sharding.shard(empty_docs(spark), 8).count() == 0
    same = sharding.shard(spark.createDataFrame([(1, "x")] * 40, "doc_id long, text string"), 4).collect()
    assert sorted(r.slot for r in same) == list(range(40)) and len({r.shard for r in same}) == 1
    out = sharding.shard(clashing(odd_docs(spark)), 3)
    assert same_columns(out, [c for c in CLASHING if c not in ("shard", "slot")])
    assert out.count() == len(ODD)


def test_rows_that_are_equal_in_text_and_id(spark):
    """Half of all bytes are one row again and again: it is cut by number, into gapless slots."""
    docs = [(7, "same", i) for i in range(4000)] + [(i, f"own {i}", i) for i in range(2000)]
    out = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string, x long").repartition(5), 8).collect()
    texts = checked([(r.text, r.shard, r.slot) for r in out], 8)
    assert len(texts["same"]) >= 4 and len(out) == len(docs)
    assert sorted((r.doc_id, r.text, r.x) for r in out) == sorted(docs)
    assert all(len(s) == 1 for t, s in texts.items() if t != "same")
    alone = sharding.shard(spark.createDataFrame(docs[:4000], "doc_id long, text string, x long").repartition(5), 4).collect()
    checked([(r.text, r.shard, r.slot) for r in alone], 4)
    assert len({r.shard for r in alone}) == 4


def test_against_splitters_of_sorted_rows(spark):
    """Shards and slots, by sorting all keys in one list: splitters are where the running sum of bytes is near k parts in all."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    docs = [(i, "".join(rng.choices("abc é", k=rng.randint(0, 300)))) for i in range(2500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keys = sorted((r.h, r.d, r.doc_id, len((r.text or "").encode()) + 1) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", F.lit(1)).alias("d")).collect())
    total = sum(k[3] for k in keys)
    found = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.repartition(3), 8).collect()}
    order = [k[2] for k in keys]
    # In key order, shards follow each other and slots count up from 0 in each.
    assert [found[i] for i in order] == sorted(found.values())
    ends, run, shard = {}, 0, 0
    for _, _, doc, size in keys:
        if found[doc][0] != shard:
            ends[found[doc][0]] = run
            shard = found[doc][0]
        run += size
    assert sorted(ends) == list(range(1, 8))
    # No splitter is farther from its place than the tolerance, or the rows next to it.
    assert all(abs(ends[k] - total * k / 8) <= max(0.005 * total / 8, 301 * 4) for k in ends)
