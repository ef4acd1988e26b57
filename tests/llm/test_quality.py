import numpy as np
from pyspark.sql import functions as F

from tessella.llm import quality_knn
from tessella.llm.queries import op2_quality_knn

from .helpers import CLASHING, ODD, clashing, empty_docs, needs_data, odd_docs, same_columns

LABELS = "doc_id long, quality int, toxic int"


@needs_data
def test_held_out_accuracy(spark):
    """On the fold that nothing is learned from."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op2_quality_knn(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert np.mean([p == y for _, p, y in held]) > 0.95
    good, bad = ([s for s, _, y in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@needs_data
def test_only_the_other_folds_teach(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality_knn.report(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    from pyspark.sql import functions as F

    # Labels of the held-out fold change nothing, nor do other columns.
    flipped = labels.withColumn("quality", F.when(quality_knn.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r for r in quality_knn.report(docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit("q")), flipped).collect()}
    assert {d: r.score for d, r in rows.items()} == {d: r.score for d, r in again.items()}


def test_brute_force_votes():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.05, (60, quality_knn.TERMS + 2)).astype(np.float32)
    labels = (np.arange(60) % 3 == 0).astype(float)
    model = quality_knn.fitted(counts, labels)
    ask = rng.poisson(0.05, (9, quality_knn.TERMS + 2)).astype(np.float32)
    scores = model.scores(ask)
    v = model.embed(ask)
    for k in range(9):
        near = model.vectors @ v[k]
        top = np.argsort(-near, kind="stable")[: quality_knn.NEIGHBOURS]
        weight = np.maximum(near[top].astype(float), 0) ** quality_knn.SHARP
        assert abs(scores[k] - (weight @ labels[top]) / weight.sum()) < 1e-4


def test_odd_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (8, 0, 0), (None, 1, 0), (9, None, None), (10, 1, 1), (99, 1, 0)], LABELS)
    rows = quality_knn.report(docs, labels).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == quality_knn.EMPTY for r in rows if r.doc_id in (1, 2))
    # No labels, one kind of label, no documents.
    none = quality_knn.report(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {quality_knn.EMPTY}
    one = quality_knn.report(docs, spark.createDataFrame([(d, 1, 0) for d in (4, 5, 6, 7, 8)], LABELS)).collect()
    assert {r.score for r in one} <= {1.0, quality_knn.EMPTY}
    assert quality_knn.report(empty_docs(spark), labels).count() == 0
    out = quality_knn.score_column(clashing(docs), quality_knn.fit(docs, labels))
    assert same_columns(out, [c for c in CLASHING if c != "score"])
    assert quality_knn.accepted(clashing(docs), labels).columns == clashing(docs).columns


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text number {i} with words {i * i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], LABELS)
    assert len(quality_knn.fit(docs, labels, sample=20).labels) == 20


def test_ids_that_repeat_leave_the_fit_alone(spark):
    rows = [(i, f"{'good words here' if i % 2 else 'x!x! junk ###'} number {i}") for i in range(40)]
    rows += [(3, "zz another text of three"), (4, "another text of four")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (quality_knn.fit(d, labels) for d in (docs.repartition(5), docs.orderBy(F.desc("text")).repartition(2)))
    assert (one.vectors == two.vectors).all() and (one.labels == two.labels).all()
