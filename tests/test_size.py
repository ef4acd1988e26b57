"""Work and memory of the raster queries that grow with the tables: dealt to all tasks, bounded in each."""

from collections import Counter

from pyspark.sql import functions as F

from tessella import queries
from tessella.functions import grid
from tessella.operators import layout


def test_tiles_of_one_image_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(grid, "PIECE", 50, raising=False)
    sizes = [(1, 16, 7, 1600), (2, 16, 1, 1), (3, 32, 1000, 70), (4, 16, 100, 2400)]
    levels = spark.createDataFrame(sizes, "id int, blocksize int, level_height long, level_width long").coalesce(1)
    rows = grid.tile_grid(levels).withColumn("task", F.spark_partition_id()).collect()
    found = sorted((r.id, r.tile_row, r.tile_col, r.tile_height, r.tile_width) for r in rows)
    assert found == sorted((i, y, x, min(b, h - y * b), min(b, w - x * b)) for i, b, h, w in sizes for y in range(-(-h // b)) for x in range(-(-w // b)))
    assert max(Counter(r.task for r in rows).values()) < len(rows) / 2


def shuffled(spark, df):
    """The rows of df, and the records that its exchanges wrote."""
    context, name = spark.sparkContext, "shuffled"
    context.setJobGroup(name, name)
    rows, tracker, store = df.collect(), context.statusTracker(), context._jsc.sc().statusStore()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for job in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(job).stageIds}
    context.setLocalProperty("spark.jobGroup.id", None)
    return rows, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_absent_tiles_are_not_exchanged(spark, monkeypatch):
    monkeypatch.setattr(queries, "BLOCK", 1)
    kinds = "l_suppkey long, l_partkey long, l_quantity double"
    rows = [(0, 0, 1.0), (3, 900, 1.0), (3, 901, 1.0), (3, 901, 1.0), (40, 5, 1.0), (60, 999, 1.0)]
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: spark.createDataFrame(rows, kinds))
    # As for tables that are too large to broadcast.
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found, records = shuffled(spark, queries.sparse_tiles(spark, ""))
    finally:
        spark.conf.set(key, before)
    assert len(found) == 2 * sum(((60 >> k) + 1) * ((999 >> k) + 1) for k in range(3))
    assert records < len(found) / 20


def test_whole_grids(spark, monkeypatch):
    monkeypatch.setattr(layout, "RUN", 6, raising=False)
    sizes = [(0, 4, 11), (1, 1, 1), (2, 2, 3), (3, 0, 5)]
    # Two at one place, the ends of rows and runs, one without bytes, and two outside of the grid.
    placed = [(0, 0, 0, False, 10, 5), (0, 0, 3, False, 15, 1), (0, 0, 3, False, 16, 2), (0, 0, 10, True, 18, 3), (0, 2, 2, True, 21, 4), (2, 1, 0, True, 25, 0), (2, 2, 0, False, 30, 1), (0, 1, 11, True, 40, 1)]
    found = layout.with_sparse(spark.createDataFrame(sizes, "level int, rows int, cols int"), spark.createDataFrame(placed, "level int, tile_row int, tile_col int, is_mask boolean, off long, nbytes int"))
    assert dict(found.dtypes) == {"level": "int", "tile_row": "int", "tile_col": "int", "is_mask": "boolean", "off": "bigint", "nbytes": "int"}
    there = {}
    for *key, off, nbytes in placed:
        there.setdefault(tuple(key), []).append((off, nbytes))
    expected = [(k, y, x, m, *at) for k, h, w in sizes for y in range(h) for x in range(w) for m in (False, True) for at in there.get((k, y, x, m), [(0, 0)])]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_tasks_of_the_index_grow_with_the_rows(spark, monkeypatch):
    items = spark.range(20_000).select((F.col("id") * 7919 % 600).alias("l_suppkey"), (F.col("id") * 104729 % 3001).alias("l_partkey"), F.lit(1.0).alias("l_quantity")).cache()
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: items)
    monkeypatch.setattr(queries, "TASK_ROWS", 1000, raising=False)
    blocks = queries.index_h(spark, "").withColumn("task", F.spark_partition_id()).collect()
    tasks = Counter(r.task for r in blocks)
    assert len(tasks) >= 15
    assert max(tasks.values()) < len(blocks) / 5
    seen = Counter((k, (r >> k) // 16, (c >> k) // 16) for r, c in {tuple(x)[:2] for x in items.collect()} for k in range(3))
    assert sorted((r.level, r.tile_row, r.tile_col, r.is_mask, r.nbytes) for r in blocks) == sorted((*k, m, n % 5 if m else n * 8) for k, n in seen.items() for m in (False, True))


def test_index_below_zero_and_null(spark, monkeypatch):
    rows = [(y, x, 1.0) for y in (None, -200, -65, -64, -63, -33, -32, -31, -17, -16, -1, 0, 15, 64) for x in (None, -70, -40, -15, 0, 70)] * 2
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double"))
    monkeypatch.setattr(queries, "TASK_ROWS", 4, raising=False)
    at = lambda v, k: None if v is None else int((v >> k) / 16)
    seen = Counter((k, at(r, k), at(c, k)) for r, c, _ in set(rows) for k in range(3))
    found = Counter({(r.level, r.tile_row, r.tile_col): r.nbytes // 8 for r in queries.index_h(spark, "").where("NOT is_mask").collect()})
    assert found == seen
    assert queries.index_h(spark, "").count() == 2 * len(seen)
