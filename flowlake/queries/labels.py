"""Labeling and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.times import micros, with_flow_time
from flowlake.operators import alerts, labeling, targets
from flowlake.queries.base import (ACTIVITY_LABELS_SQL, ACTIVITY_SQL, ALL_SESSIONS_SQL, FLOWS_SQL, LABELED_SQL,
                                   SESSIONS_SQL, activity_sessions, all_sessions, flows, labeled,
                                   query, sessions)
from flowlake.sources import sessions as session_source


@query("p1_epoch_to_ts", "SELECT event_id AS flow_id, epoch_us(ts) AS us FROM events")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir).withColumn("timestamp", micros(F.col("ts")) / F.lit(1e6)).drop("ts")
    return with_flow_time(f).select("flow_id", micros(F.col("ts")).alias("us"))


@query("p2_localize_sessions", f"""WITH {ACTIVITY_SQL}
SELECT ord, epoch_us(s) + 21600000000 AS start_us, epoch_us(e) + 21600000000 AS end_us FROM activity""")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_source.localize_sessions(activity_sessions(spark, sf_dir))
    return s.select("ord", micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"))


@query("p3_drop_placeholder", f"""WITH {FLOWS_SQL}, {ALL_SESSIONS_SQL}
SELECT scenario, count(*) AS flows FROM all_sessions JOIN flows ON ts BETWEEN s AND e
WHERE scenario <> 'EXAMPLE_DO_NOT_USE' GROUP BY scenario""")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per kept window; the placeholder's ten days count for nothing."""
    kept = session_source.drop_placeholder(all_sessions(spark))
    report = labeling.session_match_report(flows(spark, sf_dir), kept)
    return report.groupBy("scenario").agg(F.sum("matched").alias("flows")).filter("flows > 0")


@query("p4_split_targets", """
SELECT event_id AS ord, unnest(['10.0.0.' || user_id, event_type, '10.0.1.' || (user_id % 7)]) AS target
FROM events""")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three targets per row, written with quotes and uneven blanks."""
    f = flows(spark, sf_dir)
    user = F.col("src").cast("string")
    text = F.concat(F.lit('"10.0.0.'), user, F.lit(" , "), "kind", F.lit(",10.0.1."),
                    (F.col("src") % 7).cast("string"), F.lit('"'))
    logs = f.select(F.col("flow_id").alias("ord"), session_source.split_targets(text).alias("targets"))
    return session_source.session_targets(logs)


_LABEL_OUT = "SELECT flow_id, label, scenario FROM labeled"


@query("j1_label_flows", f"WITH {LABELED_SQL} {_LABEL_OUT}")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeled(spark, sf_dir).select("flow_id", "label", "scenario")


@query("j2_last_window_wins", f"""WITH {FLOWS_SQL}, {SESSIONS_SQL},
covers AS (SELECT flow_id, count(*) AS windows, arg_max(scenario, ord) AS winner
           FROM flows JOIN sessions ON ts BETWEEN s AND e GROUP BY flow_id)
SELECT winner, windows, count(*) AS flows FROM covers GROUP BY ALL""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows cover the flows of each winning scenario."""
    bad = labeled(spark, sf_dir).filter("label = 1")
    bounds = sessions(spark).select(micros(F.col("start")).alias("lo"), micros(F.col("end")).alias("hi"))
    # The literal log has ten rows; each flow counts the windows over it in one expression.
    rows = [(r["lo"], r["hi"]) for r in bounds.collect()]
    at = micros(F.col("ts"))
    windows = sum((at.between(lo, hi).cast("bigint") for lo, hi in rows), F.lit(0).cast("bigint"))
    return (bad.select(F.col("scenario").alias("winner"), windows.alias("windows"))
            .groupBy("winner", "windows").agg(F.count("*").alias("flows")))


@query("j7_many_session_join", ACTIVITY_LABELS_SQL)
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window per user and day: array search, as-of scan beyond the bound."""
    return (labeling.label_flows(flows(spark, sf_dir), activity_sessions(spark, sf_dir))
            .select("flow_id", "label", "scenario"))


@query("j7_unbounded_log_join", ACTIVITY_LABELS_SQL)
def j7_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the plan for logs of any size: nothing collected, no broadcast of windows."""
    return (labeling.label_flows(flows(spark, sf_dir), activity_sessions(spark, sf_dir),
                                 broadcast_limit=0).select("flow_id", "label", "scenario"))


_TARGET_LABELS_SQL = f"""WITH {FLOWS_SQL}, {ACTIVITY_SQL},
sent AS (SELECT *, '10.0.0.' || src AS src_ip, '10.0.1.' || (k % 7) AS dst_ip FROM flows),
aimed AS (SELECT *, ['10.0.1.' || (user_id % 7), '10.0.0.' || (user_id + 1), '10.0.0.' || (user_id + 2)] AS targets
          FROM activity),
hits AS (SELECT flow_id, arg_max(scenario, ord) AS scenario
         FROM sent JOIN (SELECT *, unnest(targets) AS target FROM aimed) ON {{on}} AND ts >= s AND ts <= e GROUP BY flow_id)
SELECT f.flow_id, CAST(h.scenario IS NOT NULL AS INTEGER) AS label, coalesce(h.scenario, '') AS scenario
FROM flows f LEFT JOIN hits h USING (flow_id)"""


def _aimed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows to seven busy servers, and windows that each aim at one server and two other clients."""
    sent = flows(spark, sf_dir).select(
        "flow_id", "ts", F.concat(F.lit("10.0.0."), F.col("src").cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.1."), (F.col("k") % 7).cast("string")).alias("dst_ip"))
    log, user = activity_sessions(spark, sf_dir), F.col("user_id")
    other = lambda n: F.concat(F.lit("10.0.0."), (user + n).cast("string"))
    return sent, log.withColumn("targets", F.array(F.concat(F.lit("10.0.1."), (user % 7).cast("string")), other(1), other(2)))


@query("j1_match_targets", _TARGET_LABELS_SQL.format(on="target IN (dst_ip, src_ip)"))
def j1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels where either address is a target, from a shared index."""
    sent, log = _aimed(spark, sf_dir)
    return targets.label_flows_by_target(sent, log, ["dst_ip", "src_ip"]).select("flow_id", "label", "scenario")


@query("j1_match_targets_unbounded", _TARGET_LABELS_SQL.format(on="target = dst_ip"))
def j1_targets_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by destination, by the plan for logs of any size; each server has a seventh of the flows."""
    sent, log = _aimed(spark, sf_dir)
    return targets.label_flows_by_target(sent, log, broadcast_limit=0).select("flow_id", "label", "scenario")


@query("j3_session_match_report", f"""WITH {FLOWS_SQL}, {SESSIONS_SQL}
SELECT ord, scenario, count(flow_id) AS matched
FROM sessions LEFT JOIN flows ON ts >= s AND ts <= e GROUP BY ord, scenario""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (labeling.session_match_report(flows(spark, sf_dir), sessions(spark))
            .select("ord", "scenario", "matched"))


@query("j3_many_session_report", f"""WITH {FLOWS_SQL}, {ACTIVITY_SQL}
SELECT ord, scenario, count(flow_id) AS matched
FROM activity LEFT JOIN flows ON ts >= s AND ts <= e GROUP BY ord, scenario""")
def j3_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (labeling.session_match_report(flows(spark, sf_dir), activity_sessions(spark, sf_dir))
            .select("ord", "scenario", "matched"))


@query("d1_label_counts", f"""WITH {LABELED_SQL}
SELECT count(*) AS total, count(*) FILTER (label = 1) AS malicious,
       count(*) FILTER (label = 0) AS benign FROM labeled""")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_counts(labeled(spark, sf_dir))


D2_SQL = f"""WITH {LABELED_SQL}
SELECT scenario, count(*) AS flows FROM labeled WHERE scenario <> '' GROUP BY scenario"""


@query("d2_scenario_counts", D2_SQL)
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.scenario_counts(labeled(spark, sf_dir))


@query("d3_capture_stats", f"""WITH {LABELED_SQL}
SELECT count(*) AS flows, count(*) FILTER (label = 1) AS malicious,
       count(*) FILTER (label = 0) AS benign,
       round(count(*) FILTER (label = 1) * 100.0::DOUBLE / count(*), 6) AS malicious_pct,
       round(count(*) FILTER (label = 0) * 100.0::DOUBLE / count(*), 6) AS benign_pct,
       min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us,
       round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE, 3) AS duration_s FROM labeled""")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.capture_stats(labeled(spark, sf_dir))


@query("d4_overlap_totals", f"""WITH {LABELED_SQL},
w AS (SELECT count(*) AS n FROM flows JOIN sessions ON ts >= s AND ts <= e)
SELECT (SELECT n FROM w) AS window_matches, count(*) FILTER (label = 1) AS malicious_flows,
       count(*) FILTER (label = 0) AS benign_flows,
       (SELECT n FROM w) - count(*) FILTER (label = 1) AS counted_again FROM labeled""")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir)
    report = labeling.session_match_report(f, sessions(spark))
    return labeling.overlap_totals(report, labeling.label_flows(f, sessions(spark)))


@query("p12_scenario_filter", f"""WITH {LABELED_SQL}
SELECT flow_id, kind, value FROM labeled WHERE label = 1 AND scenario = 'c2_beacon'""")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (labeled(spark, sf_dir).filter((F.col("label") == 1) & (F.col("scenario") == "c2_beacon"))
            .select("flow_id", "kind", "value"))


@query("p18_class_ratio", f"""WITH {LABELED_SQL}
SELECT count(*) FILTER (label = 1) AS malicious, count(*) FILTER (label = 0) AS benign,
       round(count(*) FILTER (label = 1)::DOUBLE / nullif(count(*) FILTER (label = 0), 0), 6) AS ratio
FROM labeled""")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlake.operators.sampling import class_ratio
    return class_ratio(labeled(spark, sf_dir))


@query("j5_scenario_description", f"""WITH {LABELED_SQL},
names AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in alerts.fixed.SCENARIO_TEXT.items())})
          AS v(scenario, description))
SELECT scenario, coalesce(description, scenario) AS description, count(*) AS flows
FROM labeled LEFT JOIN names USING (scenario) WHERE label = 1 GROUP BY ALL""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = labeled(spark, sf_dir).filter("label = 1").groupBy("scenario").agg(
        F.count("*").alias("flows"))
    return (alerts.describe_scenarios(counts, alerts.scenario_dimension(spark))
            .select("scenario", "description", "flows"))
