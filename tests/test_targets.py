"""Labels by target against every window tried on every flow."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowlake.operators.labeling import label_flows
from flowlake.operators.targets import label_flows_by_target

T0 = datetime(2026, 5, 18, 10, tzinfo=timezone.utc)
LOG = "ord INT, start TIMESTAMP, end TIMESTAMP, scenario STRING, targets ARRAY<STRING>"
FLOWS = "flow_id INT, ts TIMESTAMP, src_ip STRING, dst_ip STRING"


def at(second):
    return None if second is None else T0 + timedelta(seconds=second)


def plain(flows, log, addresses):
    out = {}
    for i, ts, src, dst in flows:
        mine = {"src_ip": src, "dst_ip": dst}
        hits = [w for w in log if ts is not None and w[1] <= ts <= w[2]
                and (not [t for t in w[4] or [] if t] or any(mine[a] is not None and mine[a] in w[4] for a in addresses))]
        out[i] = (1, max(hits)[3]) if hits else (0, "")
    return out


def case(seed, n=1500, windows=60):
    rng = random.Random(seed)
    hosts = ["hot"] * 10 + [f"h{i}" for i in range(12)]
    log = []
    for o in rng.sample(range(1000), windows):
        start = rng.randrange(0, 900)
        aims = rng.choice([None, [], [rng.choice(hosts)], [rng.choice(hosts), rng.choice(hosts)], [rng.choice(hosts), None], ["elsewhere"]])
        if rng.random() < 0.6 and not aims:
            aims = ["hot"]
        log.append((o, at(start), at(start + rng.choice([0, 1, 30, 300, -5])), f"s{o}", aims))
    flows = [(i, at(rng.choice([None, *range(1000)]) if rng.random() < 0.05 else rng.randrange(1000)),
              rng.choice([None, *hosts]), rng.choice([None, *hosts, "unknown"])) for i in range(n)]
    return flows, log


@pytest.mark.parametrize("addresses", [("dst_ip",), ("dst_ip", "src_ip")])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_last_window_on_a_target_wins(spark, addresses, limit):
    flows, log = case(len(addresses))
    got = label_flows_by_target(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(log, LOG), addresses, broadcast_limit=limit)
    assert got.columns == ["flow_id", "ts", "src_ip", "dst_ip", "label", "scenario"]
    want = plain(flows, log, addresses)
    assert {r["flow_id"]: (r["label"], r["scenario"]) for r in got.collect()} == want
    assert got.count() == len(flows) and {v[0] for v in want.values()} == {0, 1}


def test_without_targets_as_plain_labels(spark):
    flows, log = case(5)
    f, s = spark.createDataFrame(flows, FLOWS), spark.createDataFrame(log, LOG)
    open_ = s.withColumn("targets", F.array().cast("array<string>"))
    want = sorted(map(tuple, label_flows(f, s.drop("targets")).collect()), key=str)
    for limit in (100_000, 0):
        assert sorted(map(tuple, label_flows_by_target(f, open_, broadcast_limit=limit).collect()), key=str) == want


def test_empty_log_and_no_flows(spark):
    flows, log = case(6, 50, 5)
    f, s = spark.createDataFrame(flows, FLOWS), spark.createDataFrame(log, LOG)
    for limit in (100_000, 0):
        assert label_flows_by_target(f, s.limit(0), broadcast_limit=limit).filter("label = 0 AND scenario = ''").count() == 50
        assert label_flows_by_target(f.limit(0), s, broadcast_limit=limit).count() == 0


def test_bounded_log_shuffles_no_flow(spark):
    flows, log = case(7)
    got = label_flows_by_target(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(log, LOG))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_busy_target_covers_many_slices(spark, monkeypatch):
    """Nearly all flows go to one target, and no slice holds most of them."""
    from flowlake.operators import targets
    made = []
    real = targets.ordered_slices
    monkeypatch.setattr(targets, "ordered_slices", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    flows = [(i, at(i % 1000), "c", "hot" if i % 20 else "h1") for i in range(4000)]
    log = [(o, at(10 * o), at(10 * o + 15), f"s{o}", ["hot"]) for o in range(90)]
    got = label_flows_by_target(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(log, LOG), broadcast_limit=0)
    assert {r["flow_id"]: (r["label"], r["scenario"]) for r in got.collect()} == plain(flows, log, ("dst_ip",))
    sizes = [r["count"] for r in made[0].groupBy("_slice").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 2000
