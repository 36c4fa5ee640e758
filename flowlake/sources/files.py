"""File listings and the ledger of processed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import fixed


def list_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, file_name, length, modificationTime); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return (reader.load(path).select("path", "length", "modificationTime")
            .withColumn("file_name", F.element_at(F.split("path", "/"), -1)))


def unprocessed(files: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Files whose exact path is not in the ledger."""
    return files.join(ledger.select(key).distinct(), key, "left_anti")


def new_files(files: DataFrame, ledger: DataFrame, min_kb: int = fixed.MIN_CAPTURE_KB,
              key: str = "path") -> DataFrame:
    """Unprocessed files of at least ``min_kb`` KiB (smaller ones may be incomplete)."""
    return unprocessed(files.filter(F.col("length") >= min_kb * 1024), ledger, key)


def files_over(files: DataFrame, kb: int = fixed.MIN_CAPTURE_KB) -> DataFrame:
    """Files of strictly more than ``kb`` KiB."""
    return files.filter(F.col("length") > kb * 1024)
