"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import shared_dir, shared_path
from ..session import written as stash

__all__ = ["bit_filter", "bounded_batches", "filter_bits", "fresh", "maybe_in", "map_arrow", "named", "shared_dir", "shared_path", "stash", "steps", "table", "text_of", "without"]

#: Rows and bytes of an Arrow batch that goes to a Python worker.  A worker holds one batch at a
#: time, so these bound its memory (a single longer text still goes whole).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Characters of text that one vectorised step works on.
STEP_CHARS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the plans that this session makes from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Bits of one row of a filter, and of a whole one that is broadcast: 512 MB, whatever the size of the data.
ROW_BITS, FILTER_BITS = 1 << 12, 1 << 32


def filter_bits(keys: int, each: int = 16, most: int = FILTER_BITS) -> int:
    """The size of a filter for so many keys.  At ``most`` bits further keys only make it less selective."""
    return max(ROW_BITS, min(most, each * keys))


def _position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(bits).cast("long"))


def bit_filter(keys: DataFrame, key: Column, bits: int, repeated: bool = False) -> DataFrame:
    """(row, words): a filter of one bit a key, ROW_BITS a row, without the rows that have none.  repeated: only
    bits that two or more keys set; they are counted by partial aggregation, so a hot key is one row a task."""
    at = keys.select(_position(key, bits).alias("at"))
    if repeated:
        at = at.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # One exchange, by row, serves both aggregations.
    dealt = at.select(F.expr(f"at div {ROW_BITS}").alias("row"), F.expr(f"cast((at % {ROW_BITS}) div 64 AS int)").alias("k"), F.expr("cast(at % 64 AS int)").alias("bit")).repartition("row")
    words = dealt.groupBy("row", "k").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    held = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "bits"))).alias("held"))
    return held.select("row", F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long"))).alias("words"))


def maybe_in(df: DataFrame, key: Column, filter_: DataFrame, bits: int, out: str) -> DataFrame:
    """Adds out: whether the key's bit is in a filter, which is broadcast (its size is bits at most)."""
    at, row, words = (fresh(df, x) for x in ("at", "row", "words"))
    filter_ = filter_.select(F.col("row").alias(row), F.col("words").alias(words))
    placed = df.withColumn(at, _position(key, bits)).withColumn(row, F.expr(f"{at} div {ROW_BITS}"))
    joined = placed.join(F.broadcast(filter_), row, "left")
    bit = F.getbit(F.get(words, F.expr(f"cast(({at} % {ROW_BITS}) div 64 AS int)")), F.expr(f"cast({at} % 64 AS int)"))
    return joined.withColumn(out, F.coalesce(bit == 1, F.lit(False))).drop(at, row, words)


def without(docs: DataFrame, gone: DataFrame, most_rows: int, most_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of docs whose doc_id is not in gone, a written table of one column.

    Up to most_rows ids are broadcast.  More make a filter of at most most_bits: texts that are not in it pass straight
    through, and only the others are joined by a shuffle.
    """
    key, maybe = fresh(docs, "gone"), fresh(docs, "maybe")
    gone = gone.toDF(key)
    same = F.col("doc_id") == F.col(key)
    count = gone.count()
    if count <= most_rows:
        return docs.join(F.broadcast(gone), same, "left_anti")
    bits = filter_bits(count, most=most_bits)
    marked = maybe_in(docs, F.col("doc_id").cast("long"), bit_filter(gone, F.col(key), bits), bits, maybe)
    some = marked.where(F.col(maybe)).join(gone, same, "left_anti")
    return marked.where(~F.col(maybe)).unionByName(some).select(*named(docs.columns))


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their whole names, whatever characters those have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def map_arrow(source: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """mapInArrow for any names of columns, which Spark resolves there as if they were expressions."""
    inner = [f"c{i}" for i in range(len(schema.fields))]

    def renamed(batches):
        for batch in run(batches):
            yield batch.rename_columns(inner)

    plain = source.toDF(*(f"c{i}" for i in range(len(source.columns))))
    made = StructType([StructField(c, f.dataType, True) for c, f in zip(inner, schema.fields, strict=True)])
    return plain.mapInArrow(renamed, made).toDF(*schema.names)


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def steps(texts: list[str], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit characters each; a longer text is a range of its own."""
    start = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > limit:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
