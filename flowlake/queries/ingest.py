"""Sources and sinks (S1-S14), files made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.times import micros
from flowlake.operators import ids as ids_ops
from flowlake.queries.base import (ACTIVITY_SQL, FLOWS_SQL, IDS_SQL,
                                   activity_sessions, flows, ids_lines, query)
from flowlake.scratch import scratch_path
from flowlake.sources import files, logs, sinks
from flowlake.sources.flows import read_flows
from flowlake.sources.ids import read_ids_events
from flowlake.sources.sessions import read_sessions, read_unquoted_sessions
from flowlake.streaming.flows import land_new_files

FLOW_CSV = ("flow_id", "src_ip", "timestamp", "kind", "value", "k")
OUT = ("flow_id", "src_ip", "kind", "value", "k")


def flow_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as a converter would write them: epoch seconds, text address."""
    return flows(spark, sf_dir).select(
        "flow_id", F.concat(F.lit("10.0.0."), F.col("src").cast("string")).alias("src_ip"),
        (micros(F.col("ts")) / F.lit(1e6)).cast("decimal(20,6)").alias("timestamp"), "kind", "value", "k")


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("flow_id").cast("bigint").alias("flow_id"), "src_ip", "kind",
                     "value", F.col("k").cast("int").alias("k"))


_FLOW_OUT = "SELECT flow_id, '10.0.0.' || src AS src_ip, kind, value, k FROM flows"


@query("s1_read_flows", f"WITH {FLOWS_SQL} {_FLOW_OUT}")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "s1")
    flow_csv(spark, sf_dir).write.option("header", True).csv(f"{path}/a.csv")
    return _typed(read_flows(spark, path))


@query("s2_prefer_merged", f"WITH {FLOWS_SQL} {_FLOW_OUT}")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "s2")
    csv = flow_csv(spark, sf_dir)
    csv.write.option("header", True).csv(f"{path}/merged_flows.csv")
    csv.filter("kind = 'click'").write.option("header", True).csv(f"{path}/single.csv")
    return _typed(read_flows(spark, path))


@query("s3_union_by_name", f"""WITH {FLOWS_SQL}
SELECT flow_id, '10.0.0.' || src AS src_ip, kind,
       CASE WHEN kind <> 'view' THEN value END AS value,
       CASE WHEN kind <> 'click' THEN k END AS k FROM flows""")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layouts: without k, without value, and all columns in another order."""
    path = scratch_path(spark, "s3")
    csv = flow_csv(spark, sf_dir)
    writes = {"no_k": csv.filter("kind = 'click'").drop("k"),
              "no_value": csv.filter("kind = 'view'").drop("value"),
              "turned": csv.filter("kind NOT IN ('click', 'view')").select(*reversed(FLOW_CSV))}
    for name, df in writes.items():
        df.write.option("header", True).csv(f"{path}/{name}.csv")
    return _typed(read_flows(spark, path))


@query("s4_skip_empty_files", f"""WITH {FLOWS_SQL}
SELECT count(*) AS flows, count(DISTINCT flow_id) AS ids FROM flows""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "s4")
    csv = flow_csv(spark, sf_dir)
    csv.write.option("header", True).csv(f"{path}/full.csv")
    nothing = csv.filter("flow_id < 0").coalesce(1)
    nothing.write.option("header", False).csv(f"{path}/zero_bytes.csv")
    nothing.write.option("header", True).csv(f"{path}/header_only.csv")
    return read_flows(spark, path).agg(
        F.count("*").alias("flows"), F.count_distinct("flow_id").alias("ids"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session log of one row per user and day plus the placeholder, times in whole seconds."""
    rows = activity_sessions(spark, sf_dir)
    text = "yyyy-MM-dd HH:mm:ss"
    log = rows.select(
        F.date_format("start", text).alias("timestamp_start"),
        F.date_format("end", text).alias("timestamp_end"), "scenario",
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(",10.0.1."),
                 (F.col("user_id") % 7).cast("string")).alias("targets"),
        F.lit("malicious").alias("label"),
        F.concat(F.lit("window "), F.col("ord").cast("string")).alias("notes"))
    example = spark.createDataFrame(
        [("2024-01-01 00:00:00", "2024-01-31 00:00:00", "EXAMPLE_DO_NOT_USE", "10.0.0.1",
          "malicious", "delete this row")], log.schema)
    return log.unionByName(example)


_LOG_SQL = f"""WITH {ACTIVITY_SQL}
SELECT epoch_us(date_trunc('second', s)) + {{shift}} AS start_us,
       epoch_us(date_trunc('second', e)) + {{shift}} AS end_us, scenario,
       '10.0.0.' || user_id || ';10.0.1.' || (user_id % 7) AS targets, 'malicious' AS label,
       'window ' || ord AS notes FROM activity"""


def _log_out(log: DataFrame) -> DataFrame:
    return log.select(micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"),
                      "scenario", F.array_join("targets", ";").alias("targets"), "label", "notes")


@query("s5_read_sessions", _LOG_SQL.format(shift=6 * 3600 * 1_000_000))
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "s5")
    _log(spark, sf_dir).write.option("header", True).option("quoteAll", True).csv(path)
    return _log_out(read_sessions(spark, path, offset_hours=6))


@query("s6_repair_session_lines", _LOG_SQL.format(shift=0))
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "s6")
    log = _log(spark, sf_dir)
    log.select(F.concat_ws(",", *log.columns).alias("value")).write.text(path)
    return _log_out(read_unquoted_sessions(spark, path))


@query("s7_read_ids_events", f"""WITH {IDS_SQL}
SELECT CASE WHEN NOT bad THEN event_type END AS event_type,
       CASE WHEN NOT bad THEN src_ip END AS src_ip,
       CASE WHEN NOT bad THEN dest_port END AS dest_port,
       CASE WHEN NOT bad AND event_type = 'alert' THEN signature END AS signature,
       bad AS corrupt, count(*) AS events
FROM ids GROUP BY ALL""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "s7")
    ids_lines(spark, sf_dir).select("value").write.text(path)
    bad = F.col("_corrupt").isNotNull()

    def good(c: str):
        return F.when(~bad, F.col(c))

    return (read_ids_events(spark, path)
            .groupBy(good("event_type").alias("event_type"), good("src_ip").alias("src_ip"),
                     good("dest_port").alias("dest_port"),
                     good("alert.signature").alias("signature"), bad.alias("corrupt"))
            .agg(F.count("*").alias("events")))


def _captures(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One file per kind and day, 64 bytes per event."""
    path = scratch_path(spark, name)
    (flows(spark, sf_dir)
     .select("kind", F.dayofmonth("ts").alias("day"),
             F.rpad(F.col("flow_id").cast("string"), 63, ".").alias("value"))
     .repartition("kind", "day").write.partitionBy("kind", "day").text(path))
    return (files.list_files(spark, path, "*.txt")
            .withColumn("kind", F.regexp_extract("path", "kind=([^/]+)", 1))
            .withColumn("day", F.regexp_extract("path", "day=([0-9]+)", 1).cast("int")))


@query("s8_new_files", """
SELECT event_type AS kind, CAST(day(ts) AS INTEGER) AS day, count(*) * 64 AS length FROM events
GROUP BY ALL HAVING count(*) * 64 >= 4096 AND event_type <> 'click'""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _captures(spark, sf_dir, "s8")
    ledger = found.filter(F.col("kind") == "click").select("path")
    return files.new_files(found, ledger, min_kb=4).select("kind", "day", "length")


@query("j4_unprocessed_files", """
SELECT event_type AS kind, CAST(day(ts) AS INTEGER) AS day, count(*) * 64 AS length FROM events
GROUP BY ALL HAVING event_type NOT IN ('click', 'view')""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _captures(spark, sf_dir, "j4")
    ledger = found.filter(F.col("kind").isin("click", "view")).select("path")
    return files.unprocessed(found, ledger).select("kind", "day", "length")


@query("s9_land_new_files", """
SELECT event_type AS kind, count(*) * 64 AS bytes FROM events GROUP BY ALL""")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run twice: the second run finds nothing new."""
    path, out, ledger = (scratch_path(spark, n) for n in ("s9", "s9-landed", "s9-ledger"))
    flows(spark, sf_dir).select(
        "kind", F.rpad(F.col("flow_id").cast("string"), 63, ".").alias("value")) \
        .write.partitionBy("kind").text(path)
    for _ in range(2):
        land_new_files(spark, f"{path}/*", out, ledger, "*.txt")
    return (spark.read.parquet(out)
            .groupBy(F.regexp_extract("path", "kind=([^/]+)", 1).alias("kind"))
            .agg(F.sum("length").alias("bytes")))


@query("s10_write_dataset", f"""WITH {FLOWS_SQL}
SELECT flow_id, kind, value, CAST(k > 50 AS INTEGER) AS label FROM flows""")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet by label and CSV hold the same rows."""
    path = scratch_path(spark, "s10")
    rows = flows(spark, sf_dir).select("flow_id", "kind", "value",
                                       (F.col("k") > 50).cast("int").alias("label"))
    sinks.write_dataset(rows, f"{path}/parquet")
    sinks.write_dataset(rows, f"{path}/csv", "csv")
    csv = spark.read.schema("flow_id BIGINT, kind STRING, value DOUBLE, label INT") \
        .option("header", True).csv(f"{path}/csv")
    return spark.read.parquet(f"{path}/parquet").join(csv, ["flow_id", "kind", "value", "label"])


@query("s11_archive_runs", f"""WITH {IDS_SQL}
SELECT event_type, count(*) AS events, '20240201_000000' AS run_ts FROM ids WHERE NOT bad
GROUP BY event_type""")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs are kept; the newest is read."""
    path, lines = scratch_path(spark, "s11"), scratch_path(spark, "s11-lines")
    ids_lines(spark, sf_dir).select("value").write.text(lines)
    events = read_ids_events(spark, lines)
    sinks.append_run(events.filter("event_type = 'alert'"), path, "20240101_000000")
    sinks.append_run(events, path, "20240201_000000")
    return (sinks.latest_run(spark, path).filter(F.col("_corrupt").isNull())
            .groupBy("event_type", "run_ts").agg(F.count("*").alias("events")))


@query("p20_credential_hits", """
SELECT event_type AS kind, 'attempt ' || event_id || ' login: u' || user_id AS line
FROM events WHERE json_extract_string(props, '$.k')::INTEGER > 90""")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "p20")
    flows(spark, sf_dir).select("kind", F.concat(
        F.lit("attempt "), F.col("flow_id").cast("string"),
        F.when(F.col("k") > 90, F.lit(" login: u")).otherwise(" no answer for u"),
        F.col("src").cast("string")).alias("value")).write.partitionBy("kind").text(path)
    return logs.credential_hits(spark, path).select(
        F.regexp_extract("file", "kind=([^/]+)", 1).alias("kind"), "line")


@query("d9_ids_event_counts", f"""WITH {IDS_SQL},
types AS (SELECT * FROM (VALUES ('alert'), ('flow'), ('dns'), ('http'), ('malformed')) AS v(event_type)),
seen AS (SELECT CASE WHEN bad THEN 'malformed' ELSE event_type END AS event_type FROM ids)
SELECT t.event_type, count(s.event_type) AS events FROM types t LEFT JOIN seen s USING (event_type)
GROUP BY t.event_type""")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_ops.ids_event_counts(_events(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlake.sources.ids import parse_ids_lines
    return parse_ids_lines(ids_lines(spark, sf_dir))


_VIEW_SQL = """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, coalesce(src_ip, '?') AS src,
  '192.0.2.1' AS dst, coalesce(CAST(dest_port AS VARCHAR), '?') AS port, signature,
  coalesce(category, '?') AS category, event_id AS line
FROM ids WHERE event_type = 'alert' AND NOT bad"""


@query("p17_ids_alert_view", f"WITH {IDS_SQL} {_VIEW_SQL}")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_ops.ids_alert_view(_events(spark, sf_dir))


@query("w3_first_alerts", f"WITH {IDS_SQL} {_VIEW_SQL} ORDER BY line LIMIT 3")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_ops.first_alerts(_events(spark, sf_dir), 3, ["line"])


@query("d16_alert_volume", f"""WITH {IDS_SQL}
SELECT epoch_us(date_trunc('hour', ts)) AS bucket_us, signature, category, count(*) AS alerts
FROM ids WHERE event_type = 'alert' AND NOT bad GROUP BY ALL""")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ids_ops.alert_volume(_events(spark, sf_dir), "1 hour")
    return v.select(micros(F.col("bucket")).alias("bucket_us"), "signature", "category", "alerts")
