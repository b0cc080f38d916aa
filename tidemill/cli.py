"""python -m tidemill.cli INPUT OUTPUT: one run over a directory."""

from __future__ import annotations

import argparse
import csv
import sys
import zipfile
from collections.abc import Sequence
from xml.etree.ElementTree import ParseError

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .plans.pipeline import run


def main(argv: Sequence[str] | None = None) -> int:
    """0 after a published run; 2, with the reason on standard error, if nothing was published."""
    parser = argparse.ArgumentParser(description="Cleans a directory of sales, customer and product files.")
    parser.add_argument("input")
    parser.add_argument("output")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        result = run(spark, args.input, args.output)
    except (ValueError, OSError, csv.Error, zipfile.BadZipFile, ParseError, PySparkException) as why:
        print(f"failed: {why}", file=sys.stderr)
        return 2
    t = result.summary["transaction_counts"]
    print(f"completed: {args.input} -> {args.output}")
    print(f"transactions: {t['input']} input = {t['accepted']} accepted + {t['quarantined']} quarantined + {t['deduplicated']} deduplicated")
    print("artifacts: " + ", ".join(p.name for p in result.paths))
    return 0


if __name__ == "__main__":
    sys.exit(main())
