"""Makes the package importable on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # else it already comes from a zip file
        name = os.path.join(tempfile.mkdtemp(prefix="tidemill-"), "tidemill.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in sorted(os.walk(root)):
                for f in sorted(files):
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.relpath(path, os.path.dirname(root)))
        spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)
