"""What the tests of the text operators share: odd tables, and brute-force versions."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names that operators make or use inside.
CLASHING = ["score", "runs", "n_words", "ids", "decoded", "shard", "slot", "word", "bits", "sig", "rep", "region", "__text", "__word", "k1", "at", "spans", "n_tokens", "a.b", "kept", "part"]

ODD = [
    (1, None, None, None, None),
    (2, "", "x", "y", 0),
    (3, "  \n\t ", None, "y", None),
    (4, "same text here, said twice", "x", None, 1),
    (5, "same  text\there, said twice", "x", "y", 1),
    (None, "a row without an id", None, None, None),
    (6, "a row without an id", None, None, None),
    (7, "repeated row with an id", "x", "y", 3),
    (7, "repeated row with an id", "x", "y", 3),
    (8, "ünïcödé und 漢字 и кириллица 😀   end", "x", "y", 3),
    (9, "word " * 30000, "x", "y", 150000),
    (10, "x", "x", "y", 1),
    (-11, "negative ids are ids", "x", "y", 1),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def clashing(df):
    """df with columns of clashing names, all of one value."""
    from pyspark.sql import functions as F

    for c in CLASHING:
        df = df.withColumn(c, F.lit("mine"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def same_columns(out, names, expect="mine"):
    """Whether columns came through with their values."""
    rows = out.select(*(f"`{n}`" for n in names)).collect()
    return all(all(v == expect for v in r) for r in rows)


def union(n, links):
    """The smallest reachable of 0..n-1."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
