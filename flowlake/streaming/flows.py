"""Structured Streaming forms of ingest, labeling, scoring, counting and metering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowlake.operators import metering
from flowlake.operators.labeling import RANGE_JOIN_LIMIT, label_flows
from flowlake.operators.models import rescore
from flowlake.plans import windows
from flowlake.sources.flows import TEXT_COLUMNS, typed_flows


def drain(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process everything that has arrived, once, and stop. The checkpoint is the ledger."""
    query = (stream.writeStream.format(fmt).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start(path))
    query.awaitTermination()
    return query


def flow_stream(spark: SparkSession, path: str, columns: Sequence[str],
                text_columns: tuple[str, ...] = TEXT_COLUMNS,
                files_per_batch: int | None = None) -> DataFrame:
    """New CSV files of a folder as a stream of typed flows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return typed_flows(reader.csv(path), text_columns)


def ingest_flows(spark: SparkSession, path: str, columns: Sequence[str], out: str,
                 checkpoint: str, text_columns: tuple[str, ...] = TEXT_COLUMNS) -> StreamingQuery:
    """Each file reaches the flow table once, however often this runs."""
    return drain(flow_stream(spark, path, columns, text_columns), out, checkpoint)


def land_new_files(spark: SparkSession, path: str, out: str, checkpoint: str,
                   pattern: str = "*") -> StreamingQuery:
    """Contents of files that have not landed before."""
    stream = (spark.readStream.format("binaryFile").option("pathGlobFilter", pattern)
              .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
              .load(path))
    return drain(stream, out, checkpoint)


def label_stream(flows: DataFrame, sessions: DataFrame, time: str = "ts",
                 range_limit: int = RANGE_JOIN_LIMIT) -> DataFrame:
    """J1 against a static log. A log too large to broadcast goes batch by batch."""
    if windows.bounded_segments(sessions) is None:
        raise ValueError("log exceeds the broadcast bound: use label_batches")
    return label_flows(flows, sessions, time, range_limit)


def label_batches(flows: DataFrame, sessions: DataFrame, out: str, checkpoint: str,
                  time: str = "ts") -> StreamingQuery:
    """T2 for a log of any size. A repeated batch overwrites its own folder."""
    def label(batch: DataFrame, batch_id: int) -> None:
        label_flows(batch, sessions, time).write.mode("overwrite").parquet(
            f"{out}/batch_id={batch_id}")

    query = (flows.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def score_stream(flows: DataFrame, scaler_rows: Sequence, model: PipelineModel,
                 keep: Sequence[str]) -> DataFrame:
    """M8 on a stream; row by row, no state."""
    return rescore(flows, scaler_rows, model, keep)


def label_counts_stream(labeled: DataFrame, bucket: str = "5 minutes",
                        late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """T4: malicious and benign flows per tumbling window.

    A window is emitted once the watermark has passed its end; later rows are dropped.
    State holds open windows only.
    """
    return (labeled.withWatermark(time, late)
            .groupBy(F.window(time, bucket).alias("w"))
            .agg(F.count_if(F.col("label") == 1).alias("malicious"),
                 F.count_if(F.col("label") == 0).alias("benign"))
            .select(F.col("w.start").alias("bucket"), "malicious", "benign"))


def meter_stream(packets: DataFrame, gap: str, late: str = "10 minutes",
                 time: str = "ts") -> DataFrame:
    """T5: F1-F7 with session windows.

    A flow appears when the watermark passes its last packet plus the gap. The last open
    flows stay in state until later packets arrive; ``open_flows.meter_open_flows`` flushes them.
    """
    ends = metering.with_endpoints(packets.withWatermark(time, late), keep=(time,))
    grouped = ends.groupBy(*metering.PAIR, F.session_window(time, gap).alias("w")).agg(
        *metering.flow_aggregates())
    return metering.flow_features(grouped, metering.PAIR)
