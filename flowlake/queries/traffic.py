"""Flow metering (F1-F7), traffic signatures (K1-K6) and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.times import micros
from flowlake.operators import metering, signatures
from flowlake.queries.base import (ACTIVITY_LABELS_SQL, FLOWS_SQL, LABELED_SQL, PACKETS_SQL,
                                   activity_sessions, flows, packets, query, sessions)
from flowlake.queries.ingest import FLOW_CSV, flow_csv
from flowlake.scratch import materialize, scratch_path
from flowlake.streaming import flows as streams
from flowlake.streaming import growing_log, open_flows

GAP = 6 * 3600  # seconds; a user's median pause is longer, so flows are short

_FLOWN = f"""{PACKETS_SQL},
gaps AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS before FROM packets
         WINDOW w AS (PARTITION BY user_id ORDER BY ts, packet_id)),
flown AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > {GAP}000000 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, packet_id) AS flow_seq FROM gaps),
sided AS (SELECT *, first_value(up) OVER (PARTITION BY user_id, flow_seq ORDER BY ts, packet_id) = up AS fwd
          FROM flown),
metered AS (
  SELECT user_id, flow_seq, min(us) AS first_us, max(us) - min(us) AS flow_duration,
    arg_min(src, us) AS src_ip, arg_min(dst, us) AS dst_ip,
    count(*) FILTER (fwd) AS fp, count(*) FILTER (NOT fwd) AS bp,
    coalesce(sum(bytes) FILTER (fwd), 0) AS fb, coalesce(sum(bytes) FILTER (NOT fwd), 0) AS bb,
    max(us) FILTER (fwd) - min(us) FILTER (fwd) AS fs,
    max(us) FILTER (NOT fwd) - min(us) FILTER (NOT fwd) AS bs,
    count(*) FILTER ((k % 32) & 2 <> 0) AS syn, count(*) FILTER ((k % 32) & 4 <> 0) AS rst,
    count(*) FILTER ((k % 32) & 8 <> 0) AS psh, count(*) FILTER ((k % 32) & 16 <> 0) AS ack,
    arg_min(k * 100, us) FILTER (fwd) AS fw, arg_min(k * 100, us) FILTER (NOT fwd) AS bw
  FROM sided GROUP BY user_id, flow_seq)"""


def _user(df: DataFrame):
    return F.coalesce(F.when(F.col("a_ip") != "srv", F.col("a_ip")), F.col("b_ip"))


def _metered(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metering.packets_to_flows(packets(spark, sf_dir), GAP)
    return m.withColumn("client", _user(m))


_ID = "'u' || user_id AS client, CAST(flow_seq AS BIGINT) AS flow_seq"


@query("f1_sessionize_packets", f"WITH {_FLOWN} SELECT packet_id, CAST(flow_seq AS BIGINT) AS flow_seq FROM flown")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.sessionize_packets(packets(spark, sf_dir), GAP).select("packet_id", "flow_seq")


@query("f2_direction", f"WITH {_FLOWN} SELECT {_ID}, src_ip, dst_ip FROM metered")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metered(spark, sf_dir).select("client", "flow_seq", "src_ip", "dst_ip")


@query("f3_rates_and_sizes", f"""WITH {_FLOWN}
SELECT {_ID}, flow_duration, fp AS tot_fwd_pkts, bp AS tot_bwd_pkts,
  round((fb + bb) * 1e6::DOUBLE / nullif(flow_duration, 0), 6) AS flow_byts_s,
  round((fp + bp) * 1e6::DOUBLE / nullif(flow_duration, 0), 6) AS flow_pkts_s,
  round(fp * 1e6::DOUBLE / nullif(flow_duration, 0), 6) AS fwd_pkts_s,
  round(bp * 1e6::DOUBLE / nullif(flow_duration, 0), 6) AS bwd_pkts_s,
  round(fb / nullif(fp, 0)::DOUBLE, 6) AS fwd_pkt_len_mean,
  round(bb / nullif(bp, 0)::DOUBLE, 6) AS bwd_pkt_len_mean FROM metered""")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubles = ("flow_byts_s", "flow_pkts_s", "fwd_pkts_s", "bwd_pkts_s", "fwd_pkt_len_mean",
               "bwd_pkt_len_mean")
    return _metered(spark, sf_dir).select("client", "flow_seq", "flow_duration", "tot_fwd_pkts",
                                          "tot_bwd_pkts", *[F.round(c, 6).alias(c) for c in doubles])


@query("f4_inter_arrival", f"""WITH {_FLOWN},
waits AS (SELECT user_id, flow_seq, fwd, us - lag(us) OVER (PARTITION BY user_id, flow_seq, fwd
                 ORDER BY us, packet_id) AS wait FROM sided)
SELECT {_ID}, round(avg(wait) FILTER (fwd), 3) AS fwd_iat_mean,
       round(avg(wait) FILTER (NOT fwd), 3) AS bwd_iat_mean
FROM waits GROUP BY user_id, flow_seq""")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metered(spark, sf_dir).select("client", "flow_seq",
                                          F.round("fwd_iat_mean", 3).alias("fwd_iat_mean"),
                                          F.round("bwd_iat_mean", 3).alias("bwd_iat_mean"))


@query("f5_flags", f"""WITH {_FLOWN} SELECT {_ID}, syn AS syn_flag_cnt, rst AS rst_flag_cnt,
  ack AS ack_flag_cnt, psh AS psh_flag_cnt FROM metered""")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metered(spark, sf_dir).select("client", "flow_seq", "syn_flag_cnt", "rst_flag_cnt",
                                          "ack_flag_cnt", "psh_flag_cnt")


@query("f6_initial_window", f"""WITH {_FLOWN}
SELECT {_ID}, fw AS init_fwd_win_byts, bw AS init_bwd_win_byts FROM metered""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metered(spark, sf_dir).select("client", "flow_seq", "init_fwd_win_byts",
                                          "init_bwd_win_byts")


@query("f7_down_up_ratio", f"""WITH {_FLOWN}
SELECT {_ID}, round(bb / nullif(fb, 0)::DOUBLE, 6) AS down_up_ratio FROM metered""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metered(spark, sf_dir).select("client", "flow_seq",
                                          F.round("down_up_ratio", 6).alias("down_up_ratio"))


# --- signatures ---------------------------------------------------------------------------------
@query("k1_port_fan_out", f"""WITH {PACKETS_SQL}
SELECT epoch_us(date_trunc('day', ts)) AS bucket_us, user_id AS src, count(DISTINCT k) AS ports,
       count(*) FILTER ((k % 32) & 2 <> 0 AND (k % 32) & 16 = 0) AS syn_only
FROM packets GROUP BY ALL HAVING count(DISTINCT k) >= 3""")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("ts", F.col("user_id").alias("src"), F.col("k").alias("dport"), "flags")
    return signatures.port_fan_out(p, "1 day", 3).select(
        micros(F.col("bucket")).alias("bucket_us"), "src", "ports", "syn_only")


@query("k1_sketched_fan_out", f"""WITH {PACKETS_SQL}
SELECT epoch_us(date_trunc('day', ts)) AS bucket_us, service AS src, count(DISTINCT k * 7 + event_day % 5) AS ports, true AS close,
       count(*) FILTER ((k % 32) & 2 <> 0 AND (k % 32) & 16 = 0) AS syn_only
FROM (SELECT *, day(ts) AS event_day FROM packets) GROUP BY ALL""")
def k1_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per hour, stored, then rolled up to days; exact counts beside them, and whether the two are within the error."""
    p = packets(spark, sf_dir).select("ts", F.col("service").alias("src"), (F.col("k") * 7 + F.dayofmonth("ts") % 5).alias("dport"), "flags")
    stored = materialize(signatures.port_sketches(p, "1 hour"), "port-sketches")
    rolled = signatures.fan_out_from_sketches(stored, "1 day").withColumnRenamed("ports", "estimate")
    exact = signatures.port_fan_out(p, "1 day").select("bucket", "src", "ports")
    # Twice the bound: one of the many windows may lie beyond two standard errors.
    close = F.abs(F.col("estimate") - F.col("ports")) <= F.ceil(2 * signatures.sketch_error() * F.col("ports"))
    return rolled.join(exact, ["bucket", "src"]).select(micros(F.col("bucket")).alias("bucket_us"), "src", "ports", close.alias("close"), "syn_only")


@query("k2_connection_bursts", f"""WITH {PACKETS_SQL}
SELECT epoch_us(date_trunc('day', ts)) AS bucket_us, user_id AS src, service AS dst,
       k % 10 AS dport, count(*) AS connections
FROM packets WHERE bytes <= 100 GROUP BY ALL HAVING count(*) >= 2""")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select(
        "ts", F.col("user_id").alias("src"), F.col("service").alias("dst"),
        (F.col("k") % 10).alias("dport"), F.col("bytes").alias("flow_duration"))
    return signatures.connection_bursts(p, "1 day", 2, max_duration_us=100).select(
        micros(F.col("bucket")).alias("bucket_us"), "src", "dst", "dport", "connections")


@query("k3_repeated_requests", f"""WITH {PACKETS_SQL}
SELECT user_id AS src, '/' || service AS uri, bytes, count(*) AS repeats
FROM packets GROUP BY ALL HAVING count(*) >= 2""")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select(F.col("user_id").alias("src"),
                                      F.concat(F.lit("/"), "service").alias("uri"), "bytes")
    return signatures.repeated_requests(p, 2)


@query("k3_request_runs", f"""WITH {PACKETS_SQL},
asked AS (SELECT service AS src, k % 2 AS uri, bytes > 50 AS large, epoch_us(ts) AS us, packet_id FROM packets),
marked AS (SELECT *, CASE WHEN uri IS DISTINCT FROM lag(uri) OVER w OR large IS DISTINCT FROM lag(large) OVER w
                          OR us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS starts
           FROM asked WINDOW w AS (PARTITION BY src ORDER BY us, packet_id)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY src ORDER BY us, packet_id) AS run FROM marked)
SELECT src, uri, large, min(us) AS first_us, max(us) AS last_us, count(*) AS requests
FROM runs GROUP BY src, run, uri, large HAVING count(*) >= 2""")
def k3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources, each with a large share of the requests; a pause of half an hour ends a run."""
    p = packets(spark, sf_dir).select(F.col("service").alias("src"), (F.col("k") % 2).alias("uri"),
                                      (F.col("bytes") > 50).alias("large"), "ts", "packet_id")
    return signatures.request_runs(p, same=["uri", "large"], max_pause_seconds=1800)


@query("k4_slow_connections", f"""WITH {PACKETS_SQL},
c AS (SELECT service, epoch_us(ts) AS a, epoch_us(ts) + k::BIGINT * 60000000 AS b FROM packets
      WHERE k::BIGINT * 60000000 >= 600000000 AND bytes <= 200),
steps AS (SELECT service, a AS t, 1 AS step FROM c UNION ALL SELECT service, b + 1, -1 FROM c),
netted AS (SELECT service, t, sum(step) AS step FROM steps GROUP BY ALL),
running AS (SELECT service, sum(step) OVER (PARTITION BY service ORDER BY t) AS n FROM netted)
SELECT service, (SELECT count(*) FROM c WHERE c.service = r.service) AS connections,
       CAST(max(n) AS BIGINT) AS most_at_once FROM running r GROUP BY service""")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select(
        "service", micros(F.col("ts")).alias("first_us"),
        (F.col("k").cast("bigint") * 60_000_000).alias("flow_duration"),
        F.col("bytes").alias("flow_byts_s"))
    return signatures.slow_connections(p, ["service"], 600_000_000, 200.0)


@query("k5_beacon_regularity", f"""WITH {PACKETS_SQL},
g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id
        ORDER BY ts, packet_id)) / 1e6::DOUBLE AS gap FROM packets)
SELECT user_id, count(gap) AS gaps, round(avg(gap), 4) AS mean_gap_s,
       round(stddev_pop(gap) / avg(gap), 6) AS gap_cv
FROM g GROUP BY user_id HAVING count(gap) >= 2""")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signatures.beacon_regularity(packets(spark, sf_dir), ["user_id"])
    return out.select("user_id", "gaps", F.round("mean_gap_s", 4).alias("mean_gap_s"),
                      F.round("gap_cv", 6).alias("gap_cv"))


@query("k5_beacon_period", f"""WITH {PACKETS_SQL},
g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, packet_id) AS gap FROM packets),
bins AS (SELECT user_id, floor(ln(gap::DOUBLE) / ln(1.05::DOUBLE))::BIGINT AS bin, count(*) AS n, sum(gap)::BIGINT AS total
         FROM g WHERE gap > 0 GROUP BY ALL),
held AS (SELECT *, sum(n) OVER near AS inside, sum(total) OVER near AS inside_us, sum(n) OVER (PARTITION BY user_id) AS gaps
         FROM bins WINDOW near AS (PARTITION BY user_id ORDER BY bin RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING)),
best AS (SELECT user_id, inside_us::DOUBLE / inside AS period, inside::DOUBLE / gaps AS share FROM held WHERE gaps >= 3
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY inside DESC, bin) = 1)
SELECT user_id, any_value(gaps)::BIGINT AS gaps, round(any_value(period) / 1e6::DOUBLE, 4) AS period_s, round(any_value(share), 6) AS share,
       round(sqrt((sum(n * cos(2 * pi() * (total::DOUBLE / n) / period)) / any_value(gaps)) ** 2
                  + (sum(n * sin(2 * pi() * (total::DOUBLE / n) / period)) / any_value(gaps)) ** 2), 6) AS coherence
FROM held JOIN best USING (user_id) GROUP BY user_id""")
def k5_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signatures.beacon_period(packets(spark, sf_dir), ["user_id"], min_gaps=3)
    return out.select("user_id", "gaps", *[F.round(c, d).alias(c) for c, d in (("period_s", 4), ("share", 6), ("coherence", 6))])


@query("k6_outbound_asymmetry", f"""WITH {PACKETS_SQL},
s AS (SELECT user_id, service, coalesce(sum(bytes) FILTER (up), 0)::BIGINT AS sent,
        coalesce(sum(bytes) FILTER (NOT up), 0)::BIGINT AS received,
        round(avg(bytes) FILTER (up), 6) AS mean_sent FROM packets GROUP BY ALL)
SELECT *, round(sent / nullif(received, 0)::DOUBLE, 6) AS out_in_ratio FROM s
WHERE sent > 0 AND (received = 0 OR sent / received::DOUBLE >= 1)""")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signatures.outbound_asymmetry(packets(spark, sf_dir), "user_id", "service", "up", "bytes", 1.0)
    return out.select("user_id", "service", "sent", "received",
                      F.round("mean_sent", 6).alias("mean_sent"),
                      F.round("out_in_ratio", 6).alias("out_in_ratio"))


# --- streams ----------------------------------------------------------------------------------------
def _flow_files(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = scratch_path(spark, name)
    flow_csv(spark, sf_dir).write.option("header", True).csv(path)
    return path


@query("t1_incremental_ingest", f"""WITH {FLOWS_SQL}
SELECT flow_id, '10.0.0.' || src AS src_ip, kind, value, k FROM flows""")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run twice over one checkpoint: every file counts once."""
    path = _flow_files(spark, sf_dir, "t1")
    out, ledger = scratch_path(spark, "t1-flows"), scratch_path(spark, "t1-ledger")
    for _ in range(2):
        streams.ingest_flows(spark, path, FLOW_CSV, out, ledger)
    return spark.read.parquet(out).select(
        F.col("flow_id").cast("bigint").alias("flow_id"), "src_ip", "kind", "value",
        F.col("k").cast("int").alias("k"))


def _timed_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from flowlake.functions.times import with_flow_time
    return with_flow_time(streams.flow_stream(spark, _flow_files(spark, sf_dir, name), FLOW_CSV))


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = scratch_path(spark, f"{name}-out")
    streams.drain(stream, out, scratch_path(spark, f"{name}-ledger"))
    return spark.read.schema(stream.schema).parquet(out)


@query("t2_live_labeling", f"WITH {LABELED_SQL} SELECT flow_id, label, scenario FROM labeled")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = streams.label_stream(_timed_stream(spark, sf_dir, "t2"), sessions(spark))
    return _drained(spark, live, "t2").select(F.col("flow_id").cast("bigint").alias("flow_id"),
                                              "label", "scenario")


@query("t2_growing_log", ACTIVITY_LABELS_SQL)
def t2_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows and log both arrive in two parts; windows of days 13 to 15 come after the flows of these days."""
    sent, log = flows(spark, sf_dir).select("flow_id", "ts"), activity_sessions(spark, sf_dir).drop("user_id")
    parts = {"flows": (sent, F.dayofmonth("ts") < 16), "log": (log, F.dayofmonth("start") < 13)}
    path = {name: scratch_path(spark, f"t2g-{name}") for name in parts}
    out, ledger = scratch_path(spark, "t2g-out"), scratch_path(spark, "t2g-ledger")

    def arrive(early: bool) -> None:
        for name, (rows, first) in parts.items():
            rows.filter(first if early else ~first).write.mode("append").parquet(path[name])

    arrive(early=True)
    live = growing_log.label_growing(*[spark.readStream.schema(parts[n][0].schema).parquet(path[n]) for n in parts],
                                     "5 days", bucket_seconds=6 * 3600)
    with growing_log.newest_stream_leads(spark):
        streams.drain(live, out, ledger)
        arrive(early=False)
        streams.drain(live, out, ledger)
        open_flows.end_input(spark, sent.schema, path["flows"])
        streams.drain(live, out, ledger)
    return spark.read.schema(live.schema).parquet(out).select("flow_id", "label", "scenario")


@query("t4_tumbling_label_counts", f"""WITH {LABELED_SQL}
SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS bucket_us,
       count(*) FILTER (label = 1) AS malicious, count(*) FILTER (label = 0) AS benign
FROM labeled GROUP BY ALL
HAVING time_bucket(INTERVAL '5 minutes', min(ts)) + INTERVAL '5 minutes'
       <= date_trunc('millisecond', (SELECT max(ts) FROM flows)) - INTERVAL '10 minutes'""")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    live = streams.label_stream(_timed_stream(spark, sf_dir, "t4"), sessions(spark))
    counts = streams.label_counts_stream(live)
    return _drained(spark, counts, "t4").select(
        micros(F.col("bucket")).alias("bucket_us"), "malicious", "benign")


_STREAMED = """SELECT 'u' || user_id AS client, first_us, flow_duration, fp AS tot_fwd_pkts, bp AS tot_bwd_pkts,
       syn AS syn_flag_cnt, fw AS init_fwd_win_byts FROM metered"""


def _streamed(m: DataFrame) -> DataFrame:
    return m.select(_user(m).alias("client"), "first_us", "flow_duration", "tot_fwd_pkts",
                    "tot_bwd_pkts", "syn_flag_cnt", "init_fwd_win_byts")


def _packet_files(spark: SparkSession, sf_dir: str, name: str):
    path = scratch_path(spark, name)
    rows = packets(spark, sf_dir).drop("up", "k", "service", "user_id")
    rows.write.parquet(path)
    return path, rows.schema


@query("t5_session_windows", f"""WITH {_FLOWN} {_STREAMED} WHERE first_us + flow_duration + {GAP}000000
       <= (SELECT max(us) // 1000 * 1000 FROM flown) - 600000000""")
def t5_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows closed by the watermark; the last open ones wait for later packets."""
    path, schema = _packet_files(spark, sf_dir, "t5w")
    live = streams.meter_stream(spark.readStream.schema(schema).parquet(path), f"{GAP} seconds")
    return _streamed(_drained(spark, live, "t5w"))


@query("t5_streaming_metering", f"WITH {_FLOWN} {_STREAMED}")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows: those that timers close while packets come, then those still open at the end of input."""
    path, schema = _packet_files(spark, sf_dir, "t5")
    live = open_flows.meter_open_flows(spark.readStream.schema(schema).parquet(path), GAP)
    out, ledger = scratch_path(spark, "t5-out"), scratch_path(spark, "t5-ledger")
    with open_flows.timed_state(spark):
        streams.drain(live, out, ledger)
        open_flows.end_input(spark, schema, path)
        streams.drain(live, out, ledger)
    return _streamed(spark.read.schema(live.schema).parquet(out))
