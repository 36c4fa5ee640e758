"""IDS event logs: JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = ("event_type STRING, timestamp STRING, src_ip STRING, dest_ip STRING,"
                " dest_port INT, alert STRUCT<signature: STRING, category: STRING>,"
                " _corrupt STRING")


def parse_ids_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event columns beside the line's other columns; ``_corrupt`` keeps a bad line's text.

    The generator keeps the parse a step of its own: as a plain column, every filter pushed
    below would parse the line again.
    """
    parsed = F.from_json(F.col(column), EVENT_SCHEMA,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in lines.columns if c != column]
    return lines.filter(F.trim(column) != "").select(*rest, F.inline(F.array(parsed)))


def read_ids_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All files as one table with their place (``file``, ``split``, ``line``)."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"))
    return parse_ids_lines(lines)


def good_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def bad_lines(events: DataFrame) -> DataFrame:
    return events.filter(F.col("_corrupt").isNotNull()).select("_corrupt")
