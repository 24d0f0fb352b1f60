"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application.

    The archive goes through Spark's own file server, so executors need no shared code folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    fd, path = tempfile.mkstemp(prefix="tidemark-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for at, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    sc.addPyFile(path)
    sc._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests), one of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, found, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found
