"""Registry of queries with their SQL, and the tables they read.

The flow, packet, event-log and feature tables are views of the given tables; sessions are
either a literal log of fixed size or derived from the events, one per user and day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- flows ------------------------------------------------------------------------------
FLOWS_SQL = """flows AS (
  SELECT event_id AS flow_id, ts, user_id AS src, event_type AS kind, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("flow_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("src"), F.col("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))


# --- sessions: a literal log (overlap, exact ends, no match, placeholder, nested) ----------
SESSION_ROWS = [
    (0, "2024-01-02 00:00:00", "2024-01-04 12:00:00", "nmap_syn_scan"),
    (1, "2024-01-04 00:00:00", "2024-01-05 00:00:00", "hydra_ssh_brute"),
    (2, "2024-01-01 00:00:00", "2024-01-01 00:00:07.179575", "nmap_evasion_scan"),
    (3, "2023-06-01 00:00:00", "2023-06-02 00:00:00", "metasploit_ms17010"),
    (4, "2024-01-10 00:00:00", "2024-01-20 00:00:00", "EXAMPLE_DO_NOT_USE"),
    (5, "2024-01-15 00:00:00", "2024-01-18 00:00:00", "c2_beacon"),
    (6, "2024-01-16 06:00:00", "2024-01-16 18:00:00", "slowhttptest_dos"),
    (7, "2024-01-22 12:00:00", "2024-01-22 13:00:00", "hydra_http_brute"),
    (8, "2024-01-22 00:00:00", "2024-01-24 00:00:00", "nmap_service_scan"),
    (9, "2024-01-26 00:00:00", "2024-01-26 12:00:00", "unlisted_scan"),
]
_VALUES = ",\n    ".join(
    f"({o}, TIMESTAMP '{s}', TIMESTAMP '{e}', '{k}')" for o, s, e, k in SESSION_ROWS)
ALL_SESSIONS_SQL = f"""all_sessions AS (SELECT * FROM (VALUES
    {_VALUES}) AS v(ord, s, e, scenario))"""
SESSIONS_SQL = f"""{ALL_SESSIONS_SQL},
sessions AS (SELECT * FROM all_sessions WHERE scenario <> 'EXAMPLE_DO_NOT_USE')"""


def all_sessions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SESSION_ROWS, "ord INT, s STRING, e STRING, scenario STRING")
    return rows.select("ord", F.col("s").cast("timestamp").alias("start"),
                       F.col("e").cast("timestamp").alias("end"), "scenario")


def sessions(spark: SparkSession) -> DataFrame:
    from flowlake.sources.sessions import drop_placeholder
    return drop_placeholder(all_sessions(spark))


LABELED_SQL = f"""{FLOWS_SQL},
{SESSIONS_SQL},
hits AS (SELECT flow_id, arg_max(scenario, ord) AS scenario
         FROM flows JOIN sessions ON ts >= s AND ts <= e GROUP BY flow_id),
labeled AS (SELECT f.*, CAST(h.scenario IS NOT NULL AS INTEGER) AS label,
                   coalesce(h.scenario, '') AS scenario
            FROM flows f LEFT JOIN hits h USING (flow_id))"""


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlake.operators.labeling import label_flows
    return label_flows(flows(spark, sf_dir), sessions(spark))


# --- sessions: one per user and day, so the log grows with the data -------------------------
ACTIVITY_SQL = """activity AS (
  SELECT user_id * 100 + day(ts) AS ord, min(ts) AS s, max(ts) AS e,
         max(event_type) AS scenario, user_id
  FROM events GROUP BY user_id, day(ts))"""


def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return (e.groupBy("user_id", F.dayofmonth("ts").alias("d"))
            .agg(F.min("ts").alias("start"), F.max("ts").alias("end"),
                 F.max("event_type").alias("scenario"))
            .select((F.col("user_id") * 100 + F.col("d")).alias("ord"), "start", "end",
                    "scenario", "user_id"))


ACTIVITY_LABELS_SQL = f"""WITH {FLOWS_SQL}, {ACTIVITY_SQL},
hits AS (SELECT flow_id, arg_max(scenario, ord) AS scenario
         FROM flows JOIN activity ON ts >= s AND ts <= e GROUP BY flow_id)
SELECT f.flow_id, CAST(h.scenario IS NOT NULL AS INTEGER) AS label, coalesce(h.scenario, '') AS scenario
FROM flows f LEFT JOIN hits h USING (flow_id)"""


# --- feature matrix ---------------------------------------------------------------------------
FEATURES = ("quantity", "price", "discount", "tax", "line", "bwd_urg_flags", "unit_price")
MATRIX_SQL = """matrix AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS src_ip, CAST(l_partkey AS VARCHAR) AS dst_ip,
         l_linestatus AS scenario, l_orderkey, l_partkey, l_linenumber,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         l_tax AS tax, CAST(l_linenumber AS DOUBLE) AS line, CAST(0 AS DOUBLE) AS bwd_urg_flags,
         CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) WHEN l_tax = 0 THEN NULL
              ELSE l_extendedprice / l_quantity END AS unit_price,
         CAST(l_returnflag <> 'R' AS INTEGER) AS label,
         md5(concat_ws('|', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber,
             CAST(floor(l_quantity * 100 + 0.5::DOUBLE) AS BIGINT),
             CAST(floor(l_extendedprice * 100 + 0.5::DOUBLE) AS BIGINT),
             CAST(floor(l_discount * 100 + 0.5::DOUBLE) AS BIGINT),
             CAST(floor(l_tax * 100 + 0.5::DOUBLE) AS BIGINT),
             l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS h
  FROM lineitem),
clean AS (SELECT * FROM matrix WHERE unit_price IS NOT NULL AND isfinite(unit_price))"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, identifiers, label, and the key parts as text in ``key_text``."""
    li = table(spark, sf_dir, "lineitem")

    def money(c: str) -> Column:
        return F.floor(F.col(c) * 100 + 0.5).cast("string")

    return li.select(
        F.col("l_suppkey").cast("string").alias("src_ip"),
        F.col("l_partkey").cast("string").alias("dst_ip"), F.col("l_linestatus").alias("scenario"),
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_linenumber").cast("double").alias("line"),
        F.lit(0.0).alias("bwd_urg_flags"),
        F.when(F.col("l_discount") == 0, F.lit(float("inf")))
        .when(F.col("l_tax") != 0, F.col("l_extendedprice") / F.col("l_quantity"))
        .alias("unit_price"),
        (F.col("l_returnflag") != "R").cast("int").alias("label"),
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    money("l_quantity"), money("l_extendedprice"), money("l_discount"),
                    money("l_tax"), "l_returnflag", "l_linestatus",
                    F.col("l_shipdate").cast("date").cast("string")).alias("key_text"))


# --- predictions of two deterministic scorers --------------------------------------------------
MODELS = ("by_quantity", "by_price")
PREDICTIONS_SQL = f"""{MATRIX_SQL},
scored AS (
  SELECT 'by_quantity' AS model, label,
         round(1 / (1 + exp(-((quantity - 25) / 10 + (0.05 - discount) * 20))), 4) AS score FROM matrix
  UNION ALL
  SELECT 'by_price' AS model, label,
         round(1 / (1 + exp(-((price - 50000) / 20000 - tax * 10))), 4) AS score FROM matrix),
predictions AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS prediction FROM scored)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    quantity = (F.col("quantity") - 25) / 10 + (0.05 - F.col("discount")) * 20
    price = (F.col("price") - 50000) / 20000 - F.col("tax") * 10
    both = m.select("label", F.explode(F.array(
        F.struct(F.lit("by_quantity").alias("model"), quantity.alias("z")),
        F.struct(F.lit("by_price").alias("model"), price.alias("z")))).alias("p"))
    return (both.select("p.model", "label",
                        F.round(1 / (1 + F.exp(-F.col("p.z"))), 4).alias("score"))
            .withColumn("prediction", (F.col("score") > 0.5).cast("int")))


# --- packets ----------------------------------------------------------------------------------------
PACKETS_SQL = """packets AS (
  SELECT event_id AS packet_id, ts, user_id, event_id % 2 = 0 AS up,
         CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'srv' END AS src,
         CASE WHEN event_id % 2 = 0 THEN 'srv' ELSE 'u' || user_id END AS dst,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS service,
         CAST(round(value) AS INTEGER) AS bytes FROM events)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user talks with one server; odd events are its answers."""
    f = flows(spark, sf_dir)
    up = F.col("flow_id") % 2 == 0
    user = F.concat(F.lit("u"), F.col("src").cast("string"))
    return f.select(
        F.col("flow_id").alias("packet_id"), "ts", F.col("src").alias("user_id"), up.alias("up"),
        F.when(up, user).otherwise("srv").alias("src"),
        F.when(up, F.lit("srv")).otherwise(user).alias("dst"),
        F.when(up, F.lit(40000)).otherwise(443).alias("sport"),
        F.when(up, F.lit(443)).otherwise(40000).alias("dport"),
        F.lit(6).alias("proto"), F.round("value").cast("int").alias("bytes"),
        (F.col("k") % 32).alias("flags"), (F.col("k") * 100).alias("win"), "k",
        F.col("kind").alias("service"))


# --- IDS log lines --------------------------------------------------------------------------------------
IDS_SQL = """ids AS (
  SELECT event_id, ts, event_id % 97 = 0 AS bad,
         CASE event_type WHEN 'error' THEN 'alert' WHEN 'click' THEN 'http' WHEN 'view' THEN 'flow'
              WHEN 'purchase' THEN 'dns' ELSE 'tls' END AS event_type,
         CASE WHEN user_id % 50 <> 0 THEN '10.0.0.' || user_id END AS src_ip,
         CASE WHEN k <> 0 THEN k END AS dest_port, 'SIG ' || (k % 7) AS signature,
         CASE WHEN k % 5 <> 0 THEN 'class ' || (k % 3) END AS category
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def ids_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, line): JSON text per event; some lines are cut short, as by a full disk."""
    f = flows(spark, sf_dir)
    kind = (F.when(F.col("kind") == "error", "alert").when(F.col("kind") == "click", "http")
            .when(F.col("kind") == "view", "flow").when(F.col("kind") == "purchase", "dns")
            .otherwise("tls"))
    alert = F.when(kind == "alert", F.struct(
        F.concat(F.lit("SIG "), (F.col("k") % 7).cast("string")).alias("signature"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("class "), (F.col("k") % 3).cast("string")))
        .alias("category")))
    text = F.to_json(F.struct(
        kind.alias("event_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("src") % 50 != 0, F.concat(F.lit("10.0.0."), F.col("src").cast("string")))
        .alias("src_ip"),
        F.lit("192.0.2.1").alias("dest_ip"), F.when(F.col("k") != 0, F.col("k")).alias("dest_port"),
        alert.alias("alert")))
    cut = F.when(F.col("flow_id") % 97 == 0, F.substring(text, 1, 40)).otherwise(text)
    return f.select(cut.alias("value"), F.col("flow_id").alias("line"))
