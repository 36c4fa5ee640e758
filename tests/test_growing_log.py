"""Labels against a log that grows: the stream's rows are those of a batch run with the whole log."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from flowlake.operators.labeling import label_flows
from flowlake.plans import windows
from flowlake.streaming import flows as streams
from flowlake.streaming import packed
from flowlake.streaming.growing_log import bucket_segments, label_growing, newest_stream_leads, window_pieces
from flowlake.streaming.open_flows import end_input

T0 = datetime(2026, 5, 18, 10, tzinfo=timezone.utc)
FLOWS, LOG = "flow_id INT, ts TIMESTAMP, src STRING", "ord INT, start TIMESTAMP, end TIMESTAMP, scenario STRING"


def at(second):
    return T0 + timedelta(seconds=second)


def run(spark, folder, delay="10 minutes", bucket=60):
    def stream(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")

    live = label_growing(stream("flows", FLOWS), stream("log", LOG), delay, bucket_seconds=bucket, salts=3)
    with newest_stream_leads(spark):
        streams.drain(live, f"{folder}/out", f"{folder}/mark")
    return spark.read.schema(live.schema).parquet(f"{folder}/out")


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def rows_of(df):
    return sorted(map(str, df.select("flow_id", "ts", "src", "label", "scenario").collect()))


def test_late_windows_label_flows_in_state(spark, tmp_path):
    folder, rng = str(tmp_path), random.Random(1)
    flows = [(i, at(i * 3 + rng.choice([0, 0.5])), rng.choice("ab")) for i in range(600)]
    flows += flows[100:103] + [(9999, None, "a")]
    log = [(0, at(100), at(400), "A"), (1, at(300), at(301), "B"), (2, at(350), at(900), "C"), (3, at(1200), at(1200), "D"),
           (4, at(500), at(400), "backwards"), (5, at(700), at(1750), "E"), (6, at(-500), at(30), "F")]
    first, second = [f for f in flows if f[1] and f[1] < at(900)], [f for f in flows if f[1] is None or f[1] >= at(900)]
    put(spark, folder, "flows", first, FLOWS)
    put(spark, folder, "log", log[:1], LOG)
    early = run(spark, folder)
    early_rows = early.count()
    assert 0 < early_rows < len(first), "closed buckets are out, open ones wait"
    # Windows that reach back into open buckets only: they arrive after their flows.
    late = [w for w in log[1:] if w[0] not in (1, 2, 6)] + [(7, at(420), at(800), "G")]
    put(spark, folder, "log", late, LOG)
    put(spark, folder, "flows", second, FLOWS)
    run(spark, folder)
    end_input(spark, spark.createDataFrame([], FLOWS).schema, f"{folder}/flows")
    got = run(spark, folder)
    want = label_flows(spark.createDataFrame([f for f in flows if f[1]], FLOWS), spark.createDataFrame(log[:1] + late, LOG))
    assert rows_of(got) == rows_of(want)
    assert got.filter("scenario = 'G' AND flow_id < 300").count() > 50
    assert run(spark, folder).count() == got.count(), "nothing comes out twice"


def test_pieces_cover_their_window(spark):
    log = spark.createDataFrame([(0, at(0), at(59.999999), "A"), (1, at(30), at(200), "B"), (2, at(60), at(60), "C"), (3, at(5), at(4), "D")], LOG)
    pieces = window_pieces(log, 60).groupBy("scenario").agg(F.sort_array(F.collect_list("bucket")).alias("b")).collect()
    assert {r["scenario"]: [b.astimezone(timezone.utc) for b in r["b"]] for r in pieces} == {
        "A": [at(60)], "B": [at(60), at(120), at(180), at(240)], "C": [at(120)]}


def test_a_bucket_meets_no_pairs(spark, tmp_path):
    """Windows that all lie over one another leave few segments, and the last of them still labels."""
    folder = str(tmp_path)
    log = [(o, at(o % 50), at(550 - o % 50), f"s{o}") for o in range(2000)] + [(None, at(0), at(599), "no place")]
    flows = [(i, at(i / 4), "a") for i in range(2400)]
    made = spark.createDataFrame(log, LOG).coalesce(1)
    assert bucket_segments(window_pieces(made, 600), 600).count() < 200
    put(spark, folder, "flows", flows, FLOWS)
    put(spark, folder, "log", log, LOG)
    run(spark, folder, bucket=600)
    end_input(spark, spark.createDataFrame([], FLOWS).schema, f"{folder}/flows")
    got = run(spark, folder, bucket=600)
    assert rows_of(got) == rows_of(label_flows(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(log[:-1], LOG)))


def test_state_holds_rows_packed(spark, tmp_path):
    """Thousands of flows and segments of a bucket are few rows of state, and all of them are labelled."""
    folder, day = str(tmp_path), 86_400
    flows = [(i, at(i % 7000 + i / 1e5), "a" if i % 3 else None) for i in range(20_000)] + [(-1, at(9 * day), "last")]
    log = [(o, at(o * 3), at(o * 3 + 40 + o % 5), f"s{o}") for o in range(2000)]
    put(spark, folder, "flows", flows, FLOWS)
    put(spark, folder, "log", log, LOG)
    live = label_growing(*[spark.readStream.schema(s).parquet(f"{folder}/{n}") for n, s in (("flows", FLOWS), ("log", LOG))],
                         "20 days", bucket_seconds=6 * 3600, salts=2)
    with newest_stream_leads(spark):
        query = streams.drain(live, f"{folder}/out", f"{folder}/mark")
        held = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
        assert 0 < held < 100
        end_input(spark, spark.createDataFrame([], FLOWS).schema, f"{folder}/flows")
        streams.drain(live, f"{folder}/out", f"{folder}/mark")
    got = spark.read.schema(live.schema).parquet(f"{folder}/out")
    assert rows_of(got) == rows_of(label_flows(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(log, LOG)))


def test_packed_rows_come_back(spark):
    """Any columns, missing values too; a value holds rows of one key and no more than its bytes."""
    rows = spark.range(3000).select(
        (F.col("id") * 7919 % 5).alias("k"), "id", F.when(F.col("id") % 4 > 0, F.timestamp_micros(F.col("id") * 1_000_003 - 10**12)).alias("t"),
        F.struct(F.array("id", "id").alias("x"), F.when(F.col("id") % 3 > 0, F.lit("é")).alias("y")).alias("s")).repartition(3)
    schema = rows.drop("k").schema
    for bytes_, least, most in ((packed.BLOB_BYTES, 5, 15), (2000, 30, 3000)):
        blobs = packed.packed(rows, "k", bytes_)
        assert least <= blobs.count() <= most
        assert sorted(map(str, packed.unpacked(blobs, schema).collect())) == sorted(map(str, rows.drop("k").collect()))
        for k in range(5):
            alone = packed.unpacked(blobs.filter(F.col("k") == k), schema)
            assert alone.count() == 600 and alone.filter(F.col("id") * 7919 % 5 != k).count() == 0
    assert packed.packed(rows.limit(0), "k").count() == 0


def test_sweep_by_arrays(monkeypatch):
    """Long runs are swept by whole arrays, with the segments of the one-by-one sweep; joined ones cover the same."""
    rng = random.Random(4)
    for size, reach in ((300, 20), (300, 3000), (40, 1)):
        lo = [rng.randrange(1000) for _ in range(size)]
        rows = pd.DataFrame({"k": [i * 3 // size for i in range(size)], "lo": lo, "hi": [x + rng.randrange(reach) for x in lo],
                             "name": [rng.choice("abc") for _ in range(size)]})
        want = [(int(k), a, b, n) for k, g in rows.groupby("k") for a, b, n in windows.sweep(
            [{"lo": r.lo, "hi": r.hi, "ord": r.Index, "scenario": r.name} for r in g.itertuples()])]
        monkeypatch.setattr(windows, "FEW", 0)
        got = windows.swept(rows, ["k"])
        assert [tuple(r) for r in got[["k", "lo", "hi", "name"]].itertuples(index=False)] == want
        joined = windows.swept(rows, ["k"], joined=True)
        over = lambda t: {(r.k, x): r.name for r in t.itertuples() for x in range(r.lo, r.hi + 1)}
        assert over(joined) == over(got) and len(joined) <= len(got)
    nested = pd.DataFrame({"lo": [5, 4, 0], "hi": [6, 8, 9]})
    assert windows.swept(nested, [], joined=True)[["lo", "hi"]].values.tolist() == [[0, 9]]
