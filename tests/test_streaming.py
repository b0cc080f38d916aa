"""Micro-batches and their revision."""

from pyspark.sql import functions as F

from test_engine import CUSTOMER, PRODUCT, SALE, frame
from tidemill.operators.normalize import normalize
from tidemill.operators.validate import prepare_reference
from tidemill.streaming.microbatch import dispose_stream, revise


def test_batches_then_revision(spark, tmp_path):
    refs = [prepare_reference(normalize(frame(spark, r, [x]), r), r) for r, x in (("customers", CUSTOMER), ("products", PRODUCT))]
    path, seen = str(tmp_path / "in"), []
    for i, quantity in enumerate("12"):
        rows = frame(spark, "sales", [SALE | {"quantity": quantity}]).withColumn("_source_file", F.lit(f"f{i}"))
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        dispose_stream(stream, *refs, lambda d, n: seen.extend(r["disposition"] for r in d.collect()), str(tmp_path / "state")).awaitTermination()
    assert seen == ["ACCEPTED", "ACCEPTED"]
    assert {r["disposition"] for r in revise(spark, path, *refs).collect()} == {"QUARANTINED"}
