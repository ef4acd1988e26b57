"""A Spark data source that writes a file from rows of its parts.

Rows are part_no, layer, at and data: bytes for a place in a part; of overlapping ones the higher layer
holds, and what no row covers is zero.  All rows of a part come to one task together, a task's lowest
part first, so a task holds one part at a time.
"""

from __future__ import annotations

import pickle
from base64 import b64decode, b64encode
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .multipart import Store

PARTS = "part_no int, layer int, at long, data binary"
NAME = "tessella_parts"


@dataclass
class Receipts(WriterCommitMessage):
    parts: list[dict[str, Any]]


def assembled(batches: Iterable[pa.RecordBatch], part_bytes: int, total: int) -> Iterator[tuple[int, bytearray]]:
    """Whole parts of their rows, which are in order."""
    number, buffer = 0, bytearray()
    for batch in batches:
        for no, at, data in zip(batch.column("part_no").to_pylist(), batch.column("at").to_pylist(), batch.column("data"), strict=True):
            if no != number:
                if number:
                    yield number, buffer
                number, buffer = no, bytearray(min(part_bytes, total - (no - 1) * part_bytes))
            piece = data.as_buffer()
            buffer[at : at + piece.size] = piece
    if number:
        yield number, buffer


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.store: Store = pickle.loads(b64decode(options["store"]))  # noqa: S301  our own, from plan()
        self.session = options["session"]
        self.part_bytes, self.total = int(options["part_bytes"]), int(options["total"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Receipts:
        sent = [{"PartNumber": n, "ETag": self.store.upload(self.session, n, (n - 1) * self.part_bytes, bytes(data))} for n, data in assembled(iterator, self.part_bytes, self.total)]
        return Receipts(sent)

    def commit(self, messages: list[Receipts | None]) -> None:
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: p["PartNumber"])
        wanted = -(-self.total // self.part_bytes)
        if [p["PartNumber"] for p in parts] != list(range(1, wanted + 1)):
            raise OSError(f"{len(parts)} parts came, of {wanted}")
        self.store.complete(self.session, parts)

    def abort(self, messages: list[Receipts | None]) -> None:
        self.store.abort(self.session)


class PartSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PARTS

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(dict(self.options))


def write_parts(parts: DataFrame, store: Store, part_bytes: int, total: int) -> None:
    """Writes the file, or raises and leaves nothing of it.  Every part has a row."""
    spark: SparkSession = parts.sparkSession
    spark.dataSource.register(PartSink)
    session = store.create()
    n = -(-total // part_bytes)
    tasks = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # By the number's hash: a range would first sample the rows, and so make the whole plan twice.
    ready = parts.repartition(tasks, "part_no").sortWithinPartitions("part_no", "layer", "at")
    try:
        ready.write.format(NAME).mode("append").option("store", b64encode(pickle.dumps(store)).decode()).option("session", session).option("part_bytes", part_bytes).option("total", total).save()
    except Exception:
        store.abort(session)
        raise
