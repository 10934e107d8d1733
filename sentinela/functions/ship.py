"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark application."""
    sc = spark.sparkContext
    name = f"sentinela-{sc.applicationId}.zip"
    if any(f.endswith(name) for f in sc._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="sentinela-ship-")  # the driver serves the file from here
    path = os.path.join(folder, name)
    with zipfile.ZipFile(path, "w") as z:
        for top, _, files in os.walk(_ROOT):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    sc.addPyFile(path)
