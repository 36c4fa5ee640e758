"""Keyed state with timers: the stream's flows are those of a batch run."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from flowlake.functions.times import micros
from flowlake.operators import metering
from flowlake.streaming import flows as streams
from flowlake.streaming import open_flows
from flowlake.streaming.open_flows import merge_all, packet_runs

T0 = datetime(2026, 5, 18, 10, tzinfo=timezone.utc)
SCHEMA = ("packet_id BIGINT, ts TIMESTAMP, src STRING, dst STRING, sport INT, dport INT, proto INT,"
          " bytes INT, flags INT, win INT")
GAP = 60


def packets(n, seed, hosts=6):
    rng, rows = random.Random(seed), []
    second = 0.0
    for i in range(n):
        second += rng.choice([0, 0.5, 3, 20])
        host = min(int(rng.expovariate(0.7)), hosts)
        ends = (f"h{host}", "srv", 4000 + host, 80)
        ends = ends if rng.random() < 0.6 else (ends[1], ends[0], ends[3], ends[2])
        # Gaps of exactly the limit and one microsecond more.
        at = T0 + timedelta(seconds=second) + timedelta(microseconds=rng.choice([0, 0, 1]))
        rows.append((i, at, *ends, 6, rng.choice([None, 40, 1500]), rng.randrange(32), rng.choice([None, 512, 1024])))
    return rows


def as_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def run(spark, stream_dir, out, mark, schema, late="10 minutes"):
    live = open_flows.meter_open_flows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(stream_dir), GAP, late)
    with open_flows.timed_state(spark):
        streams.drain(live, out, mark)
    return spark.read.schema(live.schema).parquet(out)


def test_stream_equals_batch(spark, tmp_path):
    """Files arrive one by one, packets of neighbouring files out of order; the end closes what is open."""
    rows = packets(1200, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = metering.packets_to_flows(df, GAP).drop("flow_seq")
    source = str(tmp_path / "in")
    rng = random.Random(2)
    # Each file has some packets that are older than the newest of the file before.
    part_of = [min(2, (i + rng.choice([0, 0, 15])) // 400) for i in range(len(rows))]
    for part in range(3):
        piece = [r for r, p in zip(rows, part_of) if p == part]
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    before = run(spark, source, str(tmp_path / "out"), str(tmp_path / "mark"), df.schema).count()
    assert 0 < before < want.count(), "some flows are closed by timers, some are still open"
    open_flows.end_input(spark, df.schema, source)
    got = run(spark, source, str(tmp_path / "out"), str(tmp_path / "mark"), df.schema)
    assert got.dtypes == want.dtypes
    assert as_rows(got) == as_rows(want)
    again = run(spark, source, str(tmp_path / "out"), str(tmp_path / "mark"), df.schema)
    assert again.count() == want.count(), "nothing is emitted twice"


def test_runs_of_any_cut_merge_to_flows(spark):
    """Packets dealt to tasks and batches in any way give the same flows; figures equal the batch aggregates."""
    df = spark.createDataFrame(packets(400, 3, hosts=2), SCHEMA)
    ends = metering.with_endpoints(df).toPandas()
    whole = packet_runs(ends, GAP * 1_000_000)
    rng = random.Random(4)
    for cuts in (1, 2, 7):
        deal = pd.Series([rng.randrange(cuts) for _ in range(len(ends))])
        runs = pd.concat([packet_runs(ends[deal == c], GAP * 1_000_000) for c in range(cuts) if (deal == c).any()])
        merged = []
        for pair, own in runs.groupby(metering.PAIR):
            rows = [{c: (None if pd.isna(v) else v) for c, v in r.items()} for r in own[open_flows.RUN].to_dict("records")]
            merged += [dict(zip(metering.PAIR, pair)) | r for r in merge_all(rows, GAP * 1_000_000)]
        key = lambda r: tuple(str(r[c]) for c in metering.PAIR) + (r["first_us"],)
        want = [{c: (None if pd.isna(v) else v) for c, v in r.items()} for r in whole.to_dict("records")]
        assert sorted(merged, key=key) == sorted(want, key=key)
    flows = metering.sessionize_packets(df, GAP).groupBy(*metering.FLOW).agg(*metering.flow_aggregates())
    got = {(*[r[c] for c in metering.PAIR], r["first_us"]): r for r in want}
    for r in flows.collect():
        mine = got[(*[r[c] for c in metering.PAIR], r["first_us"])]
        assert {c: mine[c] for c in r.asDict() if c in mine} == {c: v for c, v in r.asDict().items() if c in mine}


def test_a_busy_pair_sends_few_rows(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=i), "A", "B", 1, 2, 6, 1, 2, 3) for i in range(5000)], SCHEMA)
    runs = packet_runs(metering.with_endpoints(df).toPandas(), GAP * 1_000_000)
    assert len(runs) == 1 and runs["a_pkts"][0] == 5000


def test_packets_without_a_time_and_an_empty_capture(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "A", "B", 1, 2, 6, 1, 2, 3), (2, T0, "A", "B", 1, 2, 6, None, 0, None)], SCHEMA)
    source = str(tmp_path / "in")
    df.write.parquet(source)
    open_flows.end_input(spark, df.schema, source)
    got = run(spark, source, str(tmp_path / "out"), str(tmp_path / "mark"), df.schema).collect()
    assert [(r["src_ip"], r["tot_fwd_pkts"], r["fwd_pkt_len_mean"], r["init_fwd_win_byts"]) for r in got] == [("A", 1, 0.0, None)]
    empty = str(tmp_path / "empty")
    open_flows.end_input(spark, df.schema, empty)
    assert run(spark, empty, str(tmp_path / "o2"), str(tmp_path / "m2"), df.schema).count() == 0
    assert spark.read.schema(df.schema).parquet(empty).select(micros(F.col("ts"))).first()[0] == open_flows.END_US


def test_a_pair_has_one_timer():
    """However many flows of a pair are open, they cost one timer; it moves to the next flow that closes."""
    class Handle:
        def __init__(self):
            self.timers, self.made, self.rows = set(), 0, []

        def getListState(self, *_):
            return self

        def registerTimer(self, at):
            self.timers.add(at)
            self.made += 1

        def deleteTimer(self, at):
            self.timers.remove(at)

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        getExpiryTimeInMs = getCurrentWatermarkInMs

    def run_at(second):
        us = second * 1_000_000
        return {c: us if c.endswith(("_us", "first", "last")) else True if c == "a_opened" else 1 for c in open_flows.RUN}

    handle, flows = Handle(), open_flows.OpenFlows(GAP * 1_000_000)
    flows.init(handle)
    flows.handleInputRows((6, "a", 1, "b", 2), iter([run_at(1000 * i) for i in range(50)]), Now(0))
    assert len(handle.rows) == 50 and handle.made == 1
    for until, left in ((30_500, 19), (100_000, 0)):
        fired = min(handle.timers)
        handle.timers.remove(fired)
        out = list(flows.handleExpiredTimer((6, "a", 1, "b", 2), Now(until * 1000), Now(fired)))
        assert len(handle.rows) == left and len(out) == (31 if left else 19)
    assert handle.made == 2 and not handle.timers
