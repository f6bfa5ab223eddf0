"""What the operators of this subpackage share: tables in the shared folder, and Arrow kernels."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of text that a kernel works on at once; a single longer text forms a chunk of its own.
CHUNK_CHARS = 2_000_000

#: Rows that the JVM gathers for a kernel at once while it writes a table; the session's own setting is kept if lower.
BATCH_ROWS = 1000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="ampliref-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Tables that this process has written and not dropped, in order.
_WRITTEN: list[str] = []


def written() -> int:
    """How many tables stand; for drop_since()."""
    return len(_WRITTEN)


def drop_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Deletes the tables that materialize() wrote since written() was mark, but for the last `keep`, when no DataFrame reads them any more."""
    gone = _WRITTEN[mark : len(_WRITTEN) - keep]
    del _WRITTEN[mark : len(_WRITTEN) - keep]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and lost executors cost no rework."""
    spark, most = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}", spark.conf.get(most)
    spark.conf.set(most, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(most, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose input batches hold at most CHUNK_CHARS of text (column `text`, where there is one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kernel(chunks(batches))

    return df.mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        if at < 0 or batch.num_rows == 0:
            yield batch
            continue
        start = total = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(at)).to_pylist()):
            if total and total + (n or 0) > CHUNK_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        yield batch.slice(start)


#: The cache that fills this Python worker; none or one.
_HELD: list[dict] = []


def alone(cache: dict) -> dict:
    """Called in a worker before a module's cache is used. Workers are used again by later stages, so what another module
    left there is emptied and its memory given back: a worker never holds two operators' caches."""
    if not any(c is cache for c in _HELD):
        for other in _HELD:
            other.clear()
        _HELD[:] = [cache]
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    return cache


def lower_ascii(text):
    """A-Z only, unlike lower()."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
