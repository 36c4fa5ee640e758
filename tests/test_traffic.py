"""Packets to flows, signatures, and their streams."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowlake.operators import metering, signatures
from flowlake.plans.ordered import carry_last, ordered_slices, running_totals, with_following, with_previous
from flowlake.streaming import flows as streams

T0 = datetime(2026, 5, 18, 10, tzinfo=timezone.utc)
SCHEMA = ("packet_id BIGINT, ts TIMESTAMP, src STRING, dst STRING, sport INT, dport INT, proto INT,"
          " bytes INT, flags INT, win INT")


def packet(i, second, up=True, size=100, flags=2, win=0):
    ends = ("A", "B", 4000, 80) if up else ("B", "A", 80, 4000)
    return (i, T0 + timedelta(seconds=second), *ends, 6, size, flags, win)


EXAMPLE = [packet(1, 0, win=1024), packet(2, 1, flags=16), packet(3, 2, up=False, flags=18, win=512),
           packet(4, 3, flags=24)]


def check(flow):
    assert (flow["src_ip"], flow["dst_ip"], flow["flow_duration"]) == ("A", "B", 3_000_000)
    assert (flow["tot_fwd_pkts"], flow["tot_bwd_pkts"]) == (3, 1)
    assert (flow["fwd_iat_mean"], flow["bwd_iat_mean"]) == (1_500_000, None)
    assert flow["down_up_ratio"] == pytest.approx(1 / 3)
    assert flow["flow_byts_s"] == pytest.approx(400 / 3) and flow["fwd_pkts_s"] == 1
    assert (flow["fwd_pkt_len_mean"], flow["bwd_pkt_len_mean"]) == (100, 100)
    assert [flow[f"{n}_flag_cnt"] for n in ("syn", "rst", "psh", "ack")] == [2, 0, 1, 3]
    assert (flow["init_fwd_win_byts"], flow["init_bwd_win_byts"]) == (1024, 512)


def test_metering(spark):
    df = spark.createDataFrame(EXAMPLE + [packet(9, 1000, up=False)], SCHEMA)
    flows = metering.packets_to_flows(df, 60).orderBy("flow_seq").collect()
    assert len(flows) == 2
    check(flows[0])
    assert (flows[1]["src_ip"], flows[1]["flow_duration"], flows[1]["flow_byts_s"]) == ("B", 0, None)
    assert flows[1]["down_up_ratio"] == 0


def test_gap_is_closed(spark):
    df = spark.createDataFrame([packet(1, 0), packet(2, 60), packet(3, 120.000001)], SCHEMA)
    seqs = [r["flow_seq"] for r in metering.sessionize_packets(df, 60).orderBy("packet_id").collect()]
    assert seqs == [1, 1, 2]


def test_streaming_metering(spark, tmp_path):
    closing = packet(99, 100_000)
    df = spark.createDataFrame(EXAMPLE + [closing], SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    live = streams.meter_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "60 seconds")
    streams.drain(live, str(tmp_path / "out"), str(tmp_path / "mark"))
    rows = spark.read.schema(live.schema).parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1
    check(rows[0])


def test_scans_over_one_hot_key(spark):
    """Keys with most rows, the missing one too, span slices; results equal plain windows."""
    n = 4000
    df = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, F.col("id") % 7).when(F.col("id") % 3 == 0, 99).alias("k"),
        F.col("id").alias("t"), (F.col("id") * 37 % 101).alias("v"),
        F.when(F.col("id") % 9 == 0, F.col("id")).alias("sparse"))
    sliced = ordered_slices(df, ["k"], ["t"])
    assert sliced.filter("k IS NULL").select("_slice").distinct().count() > 2
    assert sliced.filter("k = 99").select("_slice").distinct().count() > 1
    out = running_totals(sliced, ["k"], ["t"], {"total": "v"})
    out = with_previous(out, ["k"], ["t"], "v", "before")
    out = with_previous(out, ["k"], ["t"], "t", "earlier")
    out = with_following(out, ["k"], ["t"], "v", "after")
    out = carry_last(out, ["k"], ["t"], "sparse", "seen")
    from pyspark.sql import Window
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", F.sum("v").over(w).alias("total"), F.lag("v").over(w).alias("before"), F.lag("t").over(w).alias("earlier"),
                     F.lead("v").over(w).alias("after"), F.last("sparse", True).over(w).alias("seen"))
    columns = ["k", "t", "total", "before", "earlier", "after", "seen"]
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_beacons(spark):
    def pings(host, gaps):
        second, rows = 0, []
        for i, g in enumerate([0, *gaps]):
            second += g
            rows.append((i, T0 + timedelta(seconds=second), host, "C2"))
        return rows

    df = spark.createDataFrame(pings("steady", [15] * 4) + pings("random", [5, 40, 9, 6]),
                               "packet_id INT, ts TIMESTAMP, src STRING, dst STRING")
    cv = {r["src"]: r["gap_cv"] for r in signatures.beacon_regularity(df).collect()}
    assert cv["steady"] == 0 and cv["random"] > 0.9


def test_beacons_under_jitter(spark):
    """A period with 30 per cent jitter is told from random calls and from uneven ones, by brute force too."""
    import math
    import random
    rng, rows, made = random.Random(8), [], {}
    for i in range(30):
        for kind, gap in (("beacon", lambda: 60 * rng.uniform(0.7, 1.3)), ("clock", lambda: 15.0),
                          ("random", lambda: rng.expovariate(1 / 60)), ("noisy", lambda: 300 * rng.uniform(0.75, 1.25) if rng.random() < 0.8 else rng.uniform(1, 20))):
            second, gaps = 0.0, []
            for k in range(120):
                rows.append((len(rows), T0 + timedelta(seconds=round(second, 6)), f"{kind}{i}", "C2"))
                second += gap()
            made[f"{kind}{i}"] = [(b[1] - a[1]).total_seconds() for a, b in zip(rows[-120:], rows[-119:])]
    rows += [(len(rows) + j, T0, "still", "C2") for j in range(50)]
    got = {r["src"]: r for r in signatures.beacon_period(spark.createDataFrame(
        rows, "packet_id INT, ts TIMESTAMP, src STRING, dst STRING")).collect()}
    assert set(got) == set(made), "repeated instants have no gap"
    for src, gaps in made.items():
        p = got[src]["period_s"]
        exact = abs(sum(complex(math.cos(2 * math.pi * g / p), math.sin(2 * math.pi * g / p)) for g in gaps)) / len(gaps)
        assert abs(got[src]["coherence"] - exact) < 0.03 and got[src]["gaps"] == len(gaps) == 119
    of = lambda kind, c: [got[f"{kind}{i}"][c] for i in range(30)]
    assert all(abs(p - 15) < 1e-6 for p in of("clock", "period_s")) and min(of("clock", "coherence")) > 0.999
    assert all(54 < p < 66 for p in of("beacon", "period_s")) and min(of("beacon", "coherence")) > 0.4
    assert all(270 < p < 330 for p in of("noisy", "period_s")) and min(of("noisy", "share")) > 0.6
    assert max(of("random", "coherence")) < 0.4 and max(of("random", "share")) < 0.6 < min(of("beacon", "share"))


def test_sketches_roll_up(spark):
    df = spark.range(60_000).select(
        (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 7200)).alias("ts"), F.when(F.col("id") % 3 > 0, "scanner").otherwise("client").alias("src"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 40_000).otherwise(F.col("id") % 5).cast("int").alias("dport"), F.lit(2).alias("flags"))
    stored = signatures.port_sketches(df)
    assert stored.agg(F.max(F.octet_length("ports_sketch"))).first()[0] < 5000
    for bucket in ("1 hour", "1 day"):
        want = {(r["bucket"], r["src"]): r for r in signatures.port_fan_out(df, bucket).collect()}
        got = signatures.fan_out_from_sketches(stored, bucket).collect()
        assert {(r["bucket"], r["src"]) for r in got} == set(want)
        for r in got:
            exact = want[r["bucket"], r["src"]]
            assert abs(r["ports"] - exact["ports"]) <= 2 * signatures.sketch_error() * exact["ports"] and r["syn_only"] == exact["syn_only"]
    assert signatures.fan_out_from_sketches(stored, "1 day", min_ports=100).count() == 1


def test_fan_out_and_bursts(spark):
    rows = [packet(i, i) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("dport", F.col("packet_id").cast("int"))
    exact = signatures.port_fan_out(df, "1 hour").first()
    assert (exact["src"], exact["ports"], exact["syn_only"]) == ("A", 3, 3)
    assert signatures.port_fan_out(df, "1 hour", approximate=True).first()["ports"] == 3
    assert signatures.port_fan_out(df, "1 hour", min_ports=4).count() == 0
    same = df.withColumn("dport", F.lit(22)).withColumn("flow_duration", F.lit(5))
    assert signatures.connection_bursts(same, "1 minute", 3, 10).first()["connections"] == 3
    assert signatures.connection_bursts(same, "1 minute", 3, 1).count() == 0
    web = df.select("src", F.lit("/login").alias("uri"), "bytes")
    assert signatures.repeated_requests(web, 2).first()["repeats"] == 3


def test_runs_of_equal_requests(spark):
    """Runs cross the borders of slices; missing values are equal; a pause ends a run."""
    import random
    rng, rows, second = random.Random(3), [], 0
    for i in range(4000):
        second += rng.choice([1, 1, 1, 100])
        # One source has most requests, and one run of it covers several slices.
        src = "busy" if rng.random() < 0.8 else rng.choice(["a", None])
        what = (None, 5) if 500 < i < 2500 and src == "busy" else (rng.choice(["/", None]), rng.choice([5, None]))
        rows.append((i, T0 + timedelta(seconds=second), src, *what))
    df = spark.createDataFrame(rows, "packet_id INT, ts TIMESTAMP, src STRING, uri STRING, bytes INT")
    for pause in (None, 50):
        want = []
        for src in ("busy", "a", None):
            run = []
            for r in [*(x for x in rows if x[2] == src), None]:
                if run and (r is None or r[3:] != run[-1][3:] or (pause and (r[1] - run[-1][1]).total_seconds() > pause)):
                    if len(run) > 1:
                        want.append((src, *run[0][3:], run[0][1], run[-1][1], len(run)))
                    run = []
                run.append(r)
        got = signatures.request_runs(df, max_pause_seconds=pause).withColumns(
            {c: F.timestamp_micros(f"{c}_us") for c in ("first", "last")})
        got = [(r["src"], r["uri"], r["bytes"], r["first"].astimezone(timezone.utc), r["last"].astimezone(timezone.utc), r["requests"]) for r in got.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert (max(w[-1] for w in want) > 1400) == (pause is None)
    assert signatures.request_runs(df.limit(0)).count() == 0


def test_slow_connections(spark):
    rows = [("web", 0, 100, 1.0), ("web", 50, 100, 1.0), ("web", 100, 100, 1.0), ("web", 101, 100, 1.0),
            ("web", 0, 5, 1.0), ("web", 0, 100, 99.0)]
    df = spark.createDataFrame(rows, "service STRING, first_us BIGINT, flow_duration BIGINT, flow_byts_s DOUBLE")
    got = signatures.slow_connections(df, ["service"], 100, 10.0).first()
    assert (got["connections"], got["most_at_once"]) == (4, 3)


def test_asymmetry(spark):
    df = spark.createDataFrame([("a", "s", True, 90), ("a", "s", False, 30), ("b", "s", True, 1),
                                ("b", "s", False, 9), ("c", "s", True, 5)],
                               "client STRING, peer STRING, up BOOLEAN, bytes INT")
    got = {r["client"]: r["out_in_ratio"] for r in signatures.outbound_asymmetry(
        df, "client", "peer", "up", "bytes", 1.0).collect()}
    assert got == {"a": 3.0, "c": None}


def test_live_labels_and_counts(spark, tmp_path):
    log = spark.createDataFrame([(0, T0, T0 + timedelta(seconds=10), "A")],
                                "ord INT, start TIMESTAMP, end TIMESTAMP, scenario STRING")
    times = [timedelta(microseconds=-1), timedelta(0), timedelta(seconds=10),
             timedelta(seconds=10, microseconds=1), timedelta(hours=5)]
    flows = spark.createDataFrame([(i, T0 + t) for i, t in enumerate(times)], "flow_id BIGINT, ts TIMESTAMP")
    for i in range(2):  # two files
        flows.filter(F.col("flow_id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(flows.schema).parquet(str(tmp_path / "in"))

    for _ in range(2):
        streams.drain(streams.label_stream(stream(), log), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("flow_id").collect()
    assert [r["scenario"] for r in got] == ["", "A", "A", "", ""]
    streams.label_batches(stream(), log, str(tmp_path / "b"), str(tmp_path / "bm"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5
    counts = streams.label_counts_stream(streams.label_stream(stream(), log))
    streams.drain(counts, str(tmp_path / "c"), str(tmp_path / "cm"))
    rows = {(r["malicious"], r["benign"]) for r in spark.read.schema(counts.schema).parquet(
        str(tmp_path / "c")).collect()}
    assert rows == {(0, 1), (2, 1)}
