"""Sending this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make the package importable on all workers, once for a SparkContext, so
    that jobs run wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_tilewright_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tilewright-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tilewright_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("tilewright", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._tilewright_shipped = True
