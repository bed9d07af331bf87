"""Session defaults."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "leadloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution on; everything else is left to the cluster's configuration."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for key, value in extra.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; once per application."""
    if any("leadloom" in f for f in spark.sparkContext.listFiles):
        return
    package = Path(__file__).parent
    with tempfile.TemporaryDirectory() as folder:  # Spark's file server keeps its own copy
        archive = shutil.make_archive(f"{folder}/leadloom", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
