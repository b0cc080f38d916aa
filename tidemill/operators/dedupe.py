"""Duplicate resolution: identical copies keep their first row, differing ones conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import PROVENANCE


def ref() -> Column:
    """A row's reference; its struct order is the source order (bytes of file, of sheet, row)."""
    return F.struct(*(F.col(p).alias(n) for p, n in zip(PROVENANCE, ("file", "sheet", "row"))))


def resolve(rows: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """rows with status (SURVIVOR, DUPLICATE, CONFLICT) and survivor (its reference).

    Two partial aggregates by key and one join that Spark may split, instead of a window, so
    a key with very many rows is never gathered in one task. Nulls are facts like others. Two
    rows of a key with one reference are refused: the query fails and names the key.
    """
    fact = F.struct(*facts)
    groups = rows.groupBy(F.col(key).alias("_key")).agg(F.min(fact).eqNullSafe(F.max(fact)).alias("_same"), F.min(ref()).alias("_first"), F.max(ref()).alias("_last"), F.count("*").alias("_rows"))
    groups = groups.withColumn("_first", F.when((F.col("_rows") > 1) & F.col("_first").eqNullSafe(F.col("_last")), F.raise_error(F.concat(F.lit("repeated reference under key "), F.col("_key").cast("string"))).cast(groups.schema["_first"].dataType)).otherwise(F.col("_first")))
    joined = rows.join(groups, F.col(key) == F.col("_key"))
    status = F.when(~F.col("_same"), "CONFLICT").when(F.col("_first") == ref(), "SURVIVOR").otherwise("DUPLICATE")
    return joined.withColumn("status", status).withColumn("survivor", F.when(status != "CONFLICT", F.col("_first"))).drop("_key", "_same", "_first", "_last", "_rows")
