"""Attack-window logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import fixed
from flowlake.functions.times import shift_hours

LOG_SCHEMA = ("timestamp_start STRING, timestamp_end STRING, scenario STRING,"
              " targets STRING, label STRING, notes STRING")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# start, end, scenario, then targets up to the label token, then notes
_LINE = (r"^\s*([^,]*),([^,]*),([^,]*),(.*?),(" + "|".join(fixed.SESSION_LABELS)
         + r")(?:,(.*))?$")


def _file_order() -> Column:
    """Sortable place of a row in the log: file, split, row in split."""
    return F.struct(F.col("_metadata.file_name").alias("file"),
                    F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("row"))


def split_targets(c: Column) -> Column:
    """Comma list to array; surrounding quotes and blanks go, '' gives no target."""
    parts = F.split(F.regexp_replace(c, '"', ""), r"\s*,\s*")
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def parse_sessions(raw: DataFrame, offset_hours: int = 0) -> DataFrame:
    """Naive text times taken as UTC after the shift; the placeholder row goes."""
    def at(name: str) -> Column:
        return shift_hours(F.try_to_timestamp(F.trim(F.col(name)), F.lit(TIME_FORMAT)),
                           offset_hours)

    return drop_placeholder(raw.select(
        at("timestamp_start").alias("start"), at("timestamp_end").alias("end"),
        F.trim("scenario").alias("scenario"), split_targets(F.col("targets")).alias("targets"),
        "label", "notes", "ord"))


def drop_placeholder(sessions: DataFrame) -> DataFrame:
    """The example row of an unused log."""
    return sessions.filter(F.col("scenario") != fixed.PLACEHOLDER_SCENARIO)


def localize_sessions(sessions: DataFrame, offset_hours: int = fixed.LOCAL_TO_UTC_HOURS) -> DataFrame:
    """Local wall-clock windows to UTC."""
    return (sessions.withColumn("start", shift_hours(F.col("start"), offset_hours))
            .withColumn("end", shift_hours(F.col("end"), offset_hours)))


def read_sessions(spark: SparkSession, path: str, offset_hours: int = 0) -> DataFrame:
    """Quoted CSV log to windows, in file order (``ord``)."""
    raw = (spark.read.schema(LOG_SCHEMA).option("header", True).option("quote", '"')
           .option("escape", '"').csv(path).withColumn("ord", _file_order()))
    return parse_sessions(raw, offset_hours)


def repair_session_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of log lines whose targets hold unquoted commas, found by the label token."""
    def part(i: int) -> Column:
        return F.regexp_extract(F.col(column), _LINE, i)

    return (lines.filter(F.col(column).rlike(_LINE))
            .select(part(1).alias("timestamp_start"), part(2).alias("timestamp_end"),
                    part(3).alias("scenario"), part(4).alias("targets"),
                    part(5).alias("label"), part(6).alias("notes"),
                    *[c for c in lines.columns if c != column]))


def read_unquoted_sessions(spark: SparkSession, path: str, offset_hours: int = 0) -> DataFrame:
    """Log written without quotes; the header and other non-rows do not match."""
    lines = spark.read.text(path).withColumn("ord", _file_order())
    return parse_sessions(repair_session_lines(lines), offset_hours)


def session_targets(sessions: DataFrame) -> DataFrame:
    """One row per window and target."""
    return sessions.withColumn("target", F.explode("targets")).drop("targets")
