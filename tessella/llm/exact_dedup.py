"""Exact deduplication by two Bloom passes, in DataFrame operations only.

Both passes run on slim rows: an id and the SHA-256 of the normalised text.  Pass 1 sets a bit of a
Bloom filter for each row (one hash, 16 bits a row) and keeps the bits that were set at least twice.  A
text is *possibly repeated* if its bit is such a bit.  Pass 2 tests every row against that filter: rows
that fail are unique and pass straight through, only the rest shuffle, grouped by digest.  A
false positive costs a shuffled slim row and never changes a result.

Sizes: the filter grows with the rows up to 512 MB (2.7e8 rows at 16 bits); beyond, more rows are
falsely possible (a share of 1 - exp(-rows / bits) at most, 21 % of 10**9), and from 3.4e10 rows on all are.
Texts don't move for that: ``dedup`` broadcasts the rows that go up to 2**21, and beyond makes a filter of them (512 MB
at most) that lets all texts but those that go, and that same share of the others, pass straight through.

Defined cases: a null text equals an empty one; a null doc_id sorts after every other (it stays only
if its whole group has none); rows that repeat both doc_id and text are one document, so all of them
are reported alike and ``dedup`` leaves one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_filter, filter_bits, fresh, maybe_in, named, stash, text_of

#: 64-bit words of a filter that is broadcast, and rows (an id and a hash) that are.
MAX_BROADCAST_WORDS, MAX_BROADCAST_ROWS = FILTER_BITS // 64, 1 << 21
#: A word of 64 bits for so many rows: 16 bits a row.
ROWS_PER_WORD = 4


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space.  A lone space is left alone, which is the same and cheaper."""
    return F.regexp_replace(text, r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def possible(slim: DataFrame, key: str, out: str) -> DataFrame:
    """Both passes over slim rows.  Adds out: whether another row may have the same key.

    A filter has 16 bits a row while that is MAX_BROADCAST_WORDS at most, and fewer for more rows, so
    that more of them are falsely possible; below an eighth of a bit a row there is none, and all are.
    """
    rows = slim.count()
    bits = min(64 * -(-rows // ROWS_PER_WORD), 64 * MAX_BROADCAST_WORDS)
    if 8 * bits < rows or not bits:
        return slim.withColumn(out, F.lit(True))
    return maybe_in(slim, F.col(key), bit_filter(slim, F.col(key), bits, repeated=True), bits, out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    The text is read once: the slim rows (id, digest) go to the shared folder, both passes run on them.
    """
    slim = stash(docs.select("doc_id", F.sha2(normalised(text_of()), 256).alias("text_sha256")))
    rows = possible(slim, "text_sha256", "__possible")
    unique = rows.where("not __possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = rows.where("__possible").select("doc_id", "text_sha256")
    # Written, so that the join has an exchange on either side and Spark can split a hot text's rows.
    groups = stash(some.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    repeated = some.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return unique.unionByName(repeated)


def _told(docs: DataFrame) -> DataFrame:
    """doc_id, raw (a hash of the text as it is) and again of the rows that don't simply stay: they go, or, if
    again, one of several equal rows stays."""
    text = text_of()
    slim = stash(docs.select("doc_id", F.xxhash64(text, F.octet_length(text)).alias("raw"), F.sha2(normalised(text), 256).alias("sha")))
    some = possible(slim, "sha", "possible").where("possible").drop("possible")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")).alias("least")
    groups = stash(some.groupBy("sha").agg(least, F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", F.col("least.doc_id").alias("keep"), F.col("least.raw").alias("keep_raw")))
    # Spark can split a hot text's rows here: both sides are exchanged for this join alone.
    rows = some.join(groups, "sha").select("doc_id", "raw", (F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("raw") == F.col("keep_raw"))).alias("again"))
    return stash(rows.groupBy("doc_id", "raw", "again").agg(F.count(F.lit(1)).alias("n")).where("not again OR n > 1").drop("n"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Both passes run on slim rows; what goes is told by id and hash of the text.  Up to MAX_BROADCAST_ROWS such
    rows are broadcast, and no text moves at all.  More make a filter of at most MAX_BROADCAST_WORDS: rows
    that are not in it pass straight through, and only the others shuffle.
    """
    told = _told(docs)
    raw, maybe, key, own, again = (fresh(docs, x) for x in ("raw", "maybe", "key", "own", "again"))
    text = text_of()
    keyed = docs.withColumn(raw, F.xxhash64(text, F.octet_length(text)))
    told = told.select(F.col("doc_id").alias(key), F.col("raw").alias(own), F.col("again").alias(again))
    rows = told.count()
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(raw) == F.col(own))
    columns = named(docs.columns)
    straight = None
    if rows > MAX_BROADCAST_ROWS:
        bits = filter_bits(rows, most=64 * MAX_BROADCAST_WORDS)
        whole = lambda a, b: F.xxhash64(a, b)
        marked = maybe_in(keyed, whole("doc_id", raw), bit_filter(told, whole(key, own), bits), bits, maybe)
        straight = marked.where(~F.col(maybe)).select(*columns)
        joined = marked.where(maybe).join(told, same, "left")
    else:
        joined = keyed.join(F.broadcast(told), same, "left")
    out = joined.where(F.col(again).isNull()).select(*columns)
    if not told.where(again).isEmpty():
        # Rows that repeat id and text: few, and one of each stays.
        out = out.unionByName(joined.where(again).dropDuplicates(["doc_id", raw]).select(*columns))
    return out if straight is None else straight.unionByName(out)
