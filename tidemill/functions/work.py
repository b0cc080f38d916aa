"""Tables and folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), as a URI.

    Where a local session has none, as in tests, a fresh local folder becomes it; a cluster
    that names none is refused, for its machines share no local folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, in a folder of this application's own."""
    return f"{shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Where the tables of written() lie, by the frame's identity.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again; other frames are left alone."""
    for df in tables:
        ref, path = _PATHS.pop(id(df), (lambda: None, ""))
        if ref() is df:
            _remove(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes every table that this application has written; results that are not saved yet are lost."""
    _remove(spark, f"{shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}")
    _PATHS.clear()
