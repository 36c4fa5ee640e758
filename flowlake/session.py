"""Session settings shared by the jobs, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the operators rely on for right results or for safe plans at scale.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


SHUFFLE_PART_BYTES = 128 << 20


def shuffle_partitions(shuffled_bytes: int, at_least: int = 200) -> int:
    """Parts of about 128 MB for a shuffle of the given size; adaptive execution may merge some."""
    return max(at_least, -(-shuffled_bytes // SHUFFLE_PART_BYTES))


def build_session(app: str = "flowlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC and adaptive execution on; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    cores = cores or min(8, os.cpu_count() or 1)
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    spark = build_session(master=f"local[{cores}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_library(spark: SparkSession) -> None:
    """Python workers find this library where it lies; on a cluster without shared folders it comes by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
