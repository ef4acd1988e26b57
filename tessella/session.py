"""The shared folder, and results that are written there instead of being computed again."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a session whose
    tasks run in this process gets a folder of its own; on a cluster that is an error, since executors would
    not see it."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


#: Bytes of an Arrow batch on its way to a Python worker, which holds one at a time (a larger tile goes alone).
BATCH_BYTES = 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the plans that this session makes from now on: tiles are large, so a
    number of rows alone is no bound."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_WRITTEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have gone
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear(start: int = 0) -> None:
    for spark, path in _WRITTEN[start:]:
        _delete(spark, path)
    del _WRITTEN[start:]


def shared_path(spark: SparkSession, stem: str) -> str:
    """A new path in the shared folder that goes when the driver's Python ends, or the ``scratch`` around it."""
    path = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    # Registered again each time, so that it runs before the session's own end.
    atexit.unregister(_clear)
    atexit.register(_clear)
    _WRITTEN.append((spark, path))
    return path


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What is written to the shared folder inside goes at the end: for sessions that run many jobs.  Results
    must have been written or collected by then."""
    start = len(_WRITTEN)
    try:
        yield
    finally:
        _clear(start)


def written(df: DataFrame, stem: str = "rows", **options: str) -> DataFrame:
    """df, written to the shared folder (as the writer's options say) and read back: what follows neither computes
    it again nor depends on an executor that may be lost."""
    path = shared_path(df.sparkSession, stem)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def released(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for df, which nothing will read any more."""
    path = df._written_at
    _delete(df.sparkSession, path)
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]
