"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows of a few longs may be broadcast (about 16 MB).
BROADCAST_ROWS = 500_000
#: While a table is written: the write's shuffle files go when it ends, not when the driver collects garbage, and rows reach Python some MB at
#: a time, since the JVM, outside its heap, and Python each hold a whole batch for every running task.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), a new local one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidepanel/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    return _written(df, name, True)


def written_plain(df: DataFrame, name: str) -> DataFrame:
    """written() without dictionaries, which columns of hashes have no use for."""
    return _written(df, name, False)


def _written(df: DataFrame, name: str, dictionary: bool) -> DataFrame:
    spark = df.sparkSession
    path, before = new_path(spark, name), {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


#: Of glibc; elsewhere there is none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: What Python workers keep from one task to the next, such as a tokenizer's tables.
kept: dict = {}


def release() -> None:
    """Frees what a worker keeps for tasks of another kind, and gives the system back what is free; called where tasks begin that need the room."""
    kept.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in batches of about that many bytes of one of their columns of texts, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def unused(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2 ... that no column of df has, whatever the case."""
    taken, found, k = {c.lower() for c in df.columns}, name, 0
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found


def drop(df: DataFrame) -> None:
    """Deletes a table that written() made and that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most that many rows; beyond it the planner's shuffled join is used."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
