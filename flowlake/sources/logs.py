"""Plain-text tool logs (P20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import fixed


def credential_hits(spark: SparkSession, path: str,
                    mark: str = fixed.CREDENTIAL_MARK) -> DataFrame:
    """P20: (file, line) of lines that report a found login."""
    return (spark.read.option("recursiveFileLookup", True).text(path)
            .filter(F.col("value").contains(mark))
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))
