"""Windows and labels: closed ends, overlaps, empty logs, all three join plans."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowlake.operators import labeling
from flowlake.plans import windows
from flowlake.sources import sessions as src

DAY = datetime(2026, 5, 18, 10, 0, 0, tzinfo=timezone.utc)


def at(seconds, us=0):
    return DAY + timedelta(seconds=seconds, microseconds=us)


def make_flows(spark, times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "flow_id BIGINT, ts TIMESTAMP")


def make_sessions(spark, rows):
    return spark.createDataFrame(rows, "ord INT, start TIMESTAMP, end TIMESTAMP, scenario STRING")


def labels(df):
    return [r["scenario"] for r in df.orderBy("flow_id").collect()]


PLANS = {"range": {}, "lookup": {"range_limit": 0}, "as_of": {"broadcast_limit": 0}}


@pytest.fixture(params=list(PLANS))
def plan(request):
    return PLANS[request.param]


def test_closed_ends(spark, plan):
    flows = make_flows(spark, [at(0, -1), at(0), at(10), at(10, 1)])
    log = make_sessions(spark, [(0, at(0), at(10), "A")])
    assert labels(labeling.label_flows(flows, log, **plan)) == ["", "A", "A", ""]


def test_last_row_wins_and_counts_twice(spark, plan):
    flows = make_flows(spark, [at(3), at(7), at(12)])
    log = make_sessions(spark, [(0, at(0), at(10), "A"), (1, at(5), at(15), "B")])
    labeled = labeling.label_flows(flows, log, **plan)
    assert labels(labeled) == ["A", "B", "B"]
    report = labeling.session_match_report(flows, log)
    assert [r["matched"] for r in report.orderBy("ord").collect()] == [2, 2]
    totals = labeling.overlap_totals(report, labeled).first()
    assert (totals["window_matches"], totals["malicious_flows"], totals["counted_again"]) == (4, 3, 1)


def test_nested_and_touching(spark, plan):
    flows = make_flows(spark, [at(1), at(5), at(9)])
    log = make_sessions(spark, [(1, at(4), at(6), "A"), (0, at(0), at(10), "B")])
    assert labels(labeling.label_flows(flows, log, **plan)) == ["B", "A", "B"]
    log = make_sessions(spark, [(0, at(0), at(5), "A"), (1, at(5), at(9), "B")])
    assert labels(labeling.label_flows(make_flows(spark, [at(5)]), log, **plan)) == ["B"]


def test_no_match_and_empty_log(spark):
    flows = make_flows(spark, [at(0), None])
    log = make_sessions(spark, [(0, at(100), at(110), "A")])
    assert labeling.session_match_report(flows, log).first()["matched"] == 0
    only_example = src.drop_placeholder(make_sessions(spark, [(0, at(-5), at(5), "EXAMPLE_DO_NOT_USE")]))
    labeled = labeling.label_flows(flows, only_example)
    assert labels(labeled) == ["", ""]
    assert labeling.label_counts(labeled).first()["malicious"] == 0
    assert labeling.scenario_counts(labeled).count() == 0


def test_log_label_is_ignored(spark):
    log = make_sessions(spark, [(0, at(0), at(10), "A")]).withColumn("label", F.lit("benign"))
    assert labeling.label_flows(make_flows(spark, [at(5)]), log).first()["label"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_plans_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    log = []
    for i in range(60):
        start = rng.randrange(0, 2000)
        log.append((i, at(start), at(start + rng.choice([0, 1, 5, 50, 600])), f"s{i}"))
    rng.shuffle(log)
    times = [at(rng.randrange(-10, 2700), rng.choice([0, 0, 1, -1])) for _ in range(400)]
    want = []
    for t in times:
        hits = [(o, name) for o, s, e, name in log if s <= t <= e]
        want.append(max(hits)[1] if hits else "")
    flows, sessions = make_flows(spark, times), make_sessions(spark, log)
    for plan in PLANS.values():
        assert labels(labeling.label_flows(flows, sessions, **plan)) == want
    counts = {o: sum(s <= t <= e for t in times) for o, s, e, _ in log}
    for limit in (256, 0):
        report = labeling.session_match_report(flows, sessions, range_limit=limit)
        assert {r["ord"]: r["matched"] for r in report.collect()} == counts


def test_segments_are_disjoint(spark):
    rng = random.Random(9)
    log = [(i, at(s := rng.randrange(100)), at(s + rng.randrange(40)), f"s{i}") for i in range(30)]
    sessions = make_sessions(spark, log)
    small = windows.bounded_segments(sessions)
    assert windows.bounded_segments(sessions, limit=29) is None
    large = windows.flatten_distributed(windows.window_bounds(sessions))
    large = sorted(map(tuple, large.collect()))
    assert small == large
    assert all(a[1] < b[0] for a, b in zip(small, small[1:]))


def test_hot_instant_keeps_every_row(spark):
    flows = make_flows(spark, [at(5)] * 3000 + [at(50)] * 10)
    log = make_sessions(spark, [(i, at(i), at(i + 1), f"s{i}") for i in range(20)])
    labeled = labeling.label_flows(flows, log, broadcast_limit=0)
    assert {r["scenario"]: r["flows"] for r in labeling.scenario_counts(labeled).collect()} == {"s5": 3000}
    assert labeled.count() == 3010


def test_small_log_plan_has_no_flow_shuffle(spark, sf_dir):
    from flowlake.queries.base import flows, sessions
    labeled = labeling.label_flows(flows(spark, sf_dir), sessions(spark))
    plan = labeled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_session_log_reading(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "timestamp_start,timestamp_end,scenario,targets,label,notes\n"
        "2026-05-18 13:24:59,2026-05-18 15:15:11,nmap_syn_scan,\"10.0.0.1,10.0.0.2\",malicious,full\n"
        "2026-01-01 00:00:00,2026-01-01 00:00:01,EXAMPLE_DO_NOT_USE,10.0.0.1,malicious,x\n"
        "2026-05-18 23:32:00,2026-05-18 23:32:22,metasploit_ms17010,10.0.0.2,malicious,one\n")
    rows = src.read_sessions(spark, str(path), offset_hours=6).orderBy("ord").collect()
    assert [r["scenario"] for r in rows] == ["nmap_syn_scan", "metasploit_ms17010"]
    assert rows[0]["start"] == datetime(2026, 5, 18, 19, 24, 59)
    assert rows[0]["targets"] == ["10.0.0.1", "10.0.0.2"]
    assert src.session_targets(src.read_sessions(spark, str(path))).count() == 3


def test_unquoted_log_is_repaired(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("timestamp_start,timestamp_end,scenario,targets,label,notes\n"
                    "2026-05-18 10:00:00,2026-05-18 10:00:10,nmap,10.0.0.1,10.0.0.2,malicious,note, more\n"
                    "2026-05-18 10:00:00,2026-05-18 10:00:10,ping,10.0.0.9,benign,\n")
    rows = src.read_unquoted_sessions(spark, str(path)).orderBy("ord").collect()
    assert rows[0]["targets"] == ["10.0.0.1", "10.0.0.2"]
    assert (rows[0]["label"], rows[0]["notes"]) == ("malicious", "note, more")
    assert (rows[1]["targets"], rows[1]["notes"]) == (["10.0.0.9"], "")


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_slices_of_a_log_are_cut_and_swept(spark, keys):
    """Slices of few windows, equal starts, windows over many slices and a missing place: brute force at every cut."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), s := rng.choice([7, rng.randrange(300)]), s + rng.choice([0, 3, 40, 290]), o, f"s{o}")
            for o in rng.sample(range(2**60, 2**60 + 500), 150)] + [("a", 0, 500, None, "lost"), ("b", 2, 4, None, None)]
    bounds = spark.createDataFrame(rows, "k STRING, lo BIGINT, hi BIGINT, ord BIGINT, scenario STRING")
    cut = windows.flatten_distributed(bounds, keys, ["ord", "scenario"], piece_cuts=10).collect()
    want, got = {}, {}
    for k, lo, hi, o, name in rows:
        for t in range(lo, hi + 1):
            at = (k if keys else None, t)
            want[at] = max(want.get(at, (-1, "")), (-1 if o is None else o, name or ""))
    for r in cut:
        for t in range(r["lo"], r["hi"] + 1):
            at = (r["k"] if keys else None, t)
            assert at not in got, "segments are disjoint"
            got[at] = (-1 if r["ord"] is None else r["ord"], r["scenario"] or "")
    assert got == want and len(cut) > 30


def test_windows_are_never_multiplied_by_levels(spark):
    """A slice gets the pieces of the windows that end in it, and one for all that cover it."""
    n = 4000
    rows = [(i, 20 * n - i, i, f"s{i}") for i in range(n)]
    bounds = spark.createDataFrame(rows, "lo BIGINT, hi BIGINT, ord BIGINT, scenario STRING").withColumn("_told", F.lit(True))
    borders = windows._borders(bounds, [], 100)
    assert len(borders[()]) > 40
    sizes = [r["count"] for r in windows._pieces(bounds, [], borders).groupBy("_slice").count().collect()]
    assert len(sizes) > 40 and sum(sizes) < 4 * n and max(sizes) < 1000
