"""What the training-data operators share: input columns, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.settings import shared_dir
from cuboid.sources.files import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table in the shared folder; Spark's cleaner removes the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table of its own in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that ``written`` made for a DataFrame, once nothing reads it any more; others are left alone."""
    path = getattr(df, "written_to", None)
    if path is not None:
        Store(df.sparkSession, path).delete("")


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Batches of texts to and from Python take 8 MB or one row, not Spark's 64 MB, if the session hasn't set its own size."""
    if spark.conf.get(_BYTES) == "67108864b":
        spark.conf.set(_BYTES, str(8 << 20))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that others can't clash with its own names."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in more))


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def release() -> None:
    """Gives memory that a worker has freed back to the machine: workers are kept for later tasks, of other operators too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def releasing(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for mapInArrow, which leaves a worker small when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return run
