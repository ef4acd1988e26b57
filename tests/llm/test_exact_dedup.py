import hashlib
import re

from tessella.llm import exact_dedup

from .helpers import ODD, clashing, empty_docs, odd_docs


def expected(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(norm(text), []).append(doc)
    out = []
    for doc, text, *_ in rows:
        g = groups[norm(text)]
        keep = min((d for d in g if d is not None), default=None)
        out.append((doc, keep, len(g), doc == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return out


def key(rows):
    return sorted(tuple((v is None, 0 if v is None else v) for v in r) for r in rows)


def test_against_brute_force(spark):
    rows = exact_dedup.report(odd_docs(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert key(rows) == key(expected(ODD))


def test_many_copies_and_false_positives(spark, monkeypatch):
    # A filter far too small: nearly every row is possibly repeated, and the result is the same.
    monkeypatch.setattr(exact_dedup, "ROWS_PER_WORD", 500)
    rows = [(i, f"text {i % 700 if i % 3 else 0}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = exact_dedup.report(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert key(found) == key(expected(rows))
    kept = sorted(r.doc_id for r in exact_dedup.dedup(docs).collect())
    assert kept == sorted(d for d, _, _, k, _ in expected(rows) if k)


def test_large_filters_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_WORDS", 0)
    rows = exact_dedup.report(odd_docs(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert key(rows) == key(expected(ODD))


def test_dedup_keeps_columns(spark):
    docs = clashing(odd_docs(spark))
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    # One row a text; of ids that repeat with the text one row, of rows without ids one.
    assert len(rows) == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in ODD})
    assert all(r["__word"] == "mine" for r in rows)


def test_empty(spark):
    assert exact_dedup.report(empty_docs(spark)).count() == 0
    assert exact_dedup.dedup(empty_docs(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    for df in (exact_dedup.report(odd_docs(spark)), exact_dedup.dedup(odd_docs(spark))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_that_stay_never_shuffle(spark, monkeypatch, tmp_path):
    """With more rows to tell than are broadcast, only what the filter holds back is exchanged."""
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_ROWS", 0)
    rows = [(i, f"own text {i}" if i % 5 else f"one of ten  {i % 50}") for i in range(2000)] + [(10, "one of ten 10"), (10, "one of ten 10"), (None, "nobody"), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact_dedup.dedup(docs)
    order = lambda ids: sorted(ids, key=lambda d: (d is None, d))
    assert order(r.doc_id for r in out.collect()) == order(d for d, _, _, k, _ in set(expected(rows)) if k)
    docs.write.parquet(f"{tmp_path}/docs")
    plan = exact_dedup.dedup(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution()
    first = plan.optimizedPlan().children().apply(0).toString()
    # The first branch of the union is the scan, the filter and nothing that exchanges texts: one join, of a broadcast.
    assert plan.optimizedPlan().nodeName() == "Union" and first.count("Join ") == 1 and "rightHint=(strategy=broadcast)" in first
    above = first[: first.index("Join ")]
    assert "Aggregate" not in above and "Repartition" not in above


def test_filters_miss_nothing_and_pass_little(spark):
    from pyspark.sql import functions as F

    from tessella.llm import common

    keys = spark.range(20_000).select((F.col("id") * 3).alias("k"))
    for bits in (common.filter_bits(20_000), 1 << 12):
        some = common.bit_filter(keys, F.col("k"), bits)
        rows = common.maybe_in(spark.range(60_000), F.col("id"), some, bits, "hit").where("hit")
        assert rows.where("id % 3 = 0").count() == 20_000
        others = rows.where("id % 3 <> 0").count() / 40_000
        assert others < 0.08 if bits > 1 << 12 else others > 0.9
    twice = common.bit_filter(keys.unionByName(keys.where("k < 300")), F.col("k"), 1 << 22, repeated=True)
    hits = common.maybe_in(keys, F.col("k"), twice, 1 << 22, "hit").where("hit")
    assert hits.where("k < 300").count() == 100 and hits.count() < 400
    assert common.filter_bits(1 << 40) == common.FILTER_BITS and common.filter_bits(0) == common.ROW_BITS
