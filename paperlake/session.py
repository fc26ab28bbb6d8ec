"""Session defaults. Sizes follow the cluster unless the caller sets them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "paperlake", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution and skew-join splitting; ``settings`` (with
    ``__`` for dots) win over these."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    builder = SparkSession.builder.appName(name)
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return shipped(builder.getOrCreate())


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, which may run where it isn't installed: the
    driver packs it once and Spark hands it to every executor."""
    here, folder = os.path.dirname(os.path.abspath(__file__)), tempfile.mkdtemp(prefix="code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = os.path.join(folder, "code")
    shutil.copytree(here, os.path.join(copy, os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, os.path.basename(here)), "zip", copy))
    return spark
