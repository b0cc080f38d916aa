"""What the corpus operators share: shared-folder tables, batch sizes, per-text mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship_package
from ..functions.work import discard, work_path, written

__all__ = ["BATCH_RECORDS", "clear_of", "discard", "map_arrow", "small_batches", "texts_of", "tidy", "work_path", "written"]

#: Records of one Arrow batch; a batch of long texts must fit beside the JVM.
BATCH_RECORDS = 512


def small_batches(spark: SparkSession, records: int = BATCH_RECORDS) -> None:
    """Before Python work: ship the package, lower the Arrow batch size to `records`, never raise it."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > records:
        spark.conf.set(key, str(records))


def tidy() -> None:
    """Gives a Python worker's free memory back: workers are used again, and idle ones keep what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_arrow(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: T.StructType,
) -> DataFrame:
    """mapInArrow with per-task state: make() runs once a task and gives the batch function."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)
        tidy()

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exactly (id_col as given, text with null as empty); other columns cannot clash."""
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """df without any column that carries one of `names`, whatever its case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
