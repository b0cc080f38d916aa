"""Sales that arrive as files of cells, disposed of batch by batch.

Each micro-batch is a run of its own against the given references: duplicates are resolved
within a batch. A conflict with an accepted row of an earlier batch would have to take that
row back, which a batch cannot; `revise` therefore disposes of all rows received so far again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.contracts import AS_OF
from ..operators.normalize import normalize
from ..operators.validate import dispose


def dispose_stream(cells: DataFrame, customers: DataFrame, products: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, as_of: str = AS_OF) -> StreamingQuery:
    """Starts a query that gives sink each batch's disposed rows; stops when all input is read.

    cells is a streaming frame of sales cells, customers and products are prepared references.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sink(dispose(normalize(rows, "sales"), customers, products, as_of), number)

    return cells.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revise(spark: SparkSession, received: str, customers: DataFrame, products: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """All rows received below a path so far, disposed of together."""
    return dispose(normalize(spark.read.parquet(received), "sales"), customers, products, as_of)
