"""Sinks (S10-S14)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators.boosting import BoostedModel, load_boosted, save_boosted

BOOSTED_TABLE = "boosted"

def write_dataset(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: tuple[str, ...] = ("label",)) -> None:
    """Labeled, train or test set. CSV keeps the partition columns in the rows instead."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.partitionBy(*[c for c in partition_by if c in df.columns]).format(fmt).save(path)


def append_run(df: DataFrame, path: str, run_ts: str | None = None) -> str:
    """Keep every earlier result; the new one gets its own ``run_ts`` partition."""
    run_ts = run_ts or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    (df.withColumn("run_ts", F.lit(run_ts)).write.mode("append")
     .partitionBy("run_ts").parquet(path))
    return run_ts


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest run; the filter prunes the other partitions."""
    runs = spark.read.option("recursiveFileLookup", False).parquet(path)
    runs = runs.withColumn("run_ts", F.col("run_ts").cast("string"))
    newest = runs.agg(F.max("run_ts")).first()[0]
    return runs.filter(F.col("run_ts") == newest)


def save_scaler(scaler: DataFrame, path: str) -> None:
    """(ord, feature, mean, std_pop)."""
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel | BoostedModel, path: str) -> None:
    """Fitted model folder."""
    if isinstance(model, BoostedModel):
        save_boosted(SparkSession.getActiveSession(), model, f"{path}/{BOOSTED_TABLE}")
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | BoostedModel:
    spark = SparkSession.getActiveSession()
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BOOSTED_TABLE}")
    if table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(table):
        return load_boosted(spark, f"{path}/{BOOSTED_TABLE}")
    return PipelineModel.load(path)


def write_report(lines: DataFrame, path: str, order: str = "ord", column: str = "line") -> None:
    """Report lines in order, one small text file."""
    lines.orderBy(order).select(column).coalesce(1).write.mode("overwrite").text(path)
