"""Every registered raster query against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tessella.functions import options
from tessella.queries import _KERNELS, _OPTIONS, _REFUSED, ORACLE_SQL, QUERIES, _overlaid, option_rows

DATA = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem", "events", "embeddings", "orders", "customer")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


def test_all_have_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(key(r) for r in df.select(*columns).collect())
    rel = oracle.execute(ORACLE_SQL[name])
    order = [c[0] for c in rel.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    assert found == sorted(key([r[i] for i in at]) for r in rel.fetchall())
    assert found


def test_odd_edge_takes_the_whole_image(spark, tmp_path):
    rows = [(i, [float(i % 7 + k + 1) / 1000 for k in range(70)]) for i in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["overview_odd_edge"](spark, str(tmp_path)).collect()
    assert (max(r.r for r in found), max(r.c for r in found)) == (348, 33)


#: The SQL of queries that took a part of the layers only, as it was registered for them.
SOME_LAYERS = {
    "option_validate": f"""WITH {_OPTIONS}, j AS (SELECT job, lower(key) AS key, lower(value) AS value FROM o WHERE layer % 3 = 0)
        SELECT job, count(DISTINCT key) FILTER (key IN ({_REFUSED})) AS n_refused,
               coalesce(coalesce(max(value) FILTER (key = 'overview_resampling'), max(value) FILTER (key = 'resampling')) IN ({_KERNELS}), false) AS resampling_ok FROM j GROUP BY job""",
    "option_overview": f"""WITH {_OPTIONS}, {_overlaid('layer % 4 = 0')},
        wide AS (SELECT job, {', '.join(f"max(value) FILTER (key = '{n}') AS {n}" for k in ('compress', 'quality', 'predictor') for n in (k, f'overview_{k}'))} FROM over GROUP BY job),
        other AS (SELECT *, overview_compress IS NOT NULL AND overview_compress IS DISTINCT FROM compress AS own FROM wide)
        SELECT job, coalesce(overview_compress, compress) AS compress, coalesce(overview_quality, CASE WHEN NOT own THEN quality END) AS quality, coalesce(overview_predictor, CASE WHEN NOT own THEN predictor END) AS predictor FROM other""",
}


@pytest.mark.parametrize("name", list(SOME_LAYERS))
def test_operators_on_some_layers(spark, oracle, name):
    rows = option_rows(spark, DATA)
    df = options.refused_rows(rows.where("layer % 3 = 0")) if name == "option_validate" else options.overview_rows(options.overlay_rows(rows.where("layer % 4 = 0")))
    columns = sorted(df.columns)
    rel = oracle.execute(SOME_LAYERS[name])
    at = [[c[0] for c in rel.description].index(c) for c in columns]
    assert sorted(key(r) for r in df.select(*columns).collect()) == sorted(key([r[i] for i in at]) for r in rel.fetchall())
