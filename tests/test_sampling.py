"""Exact sizes, copies, leaks, and the published totals."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import sampling


def table(spark, n_bad, n_good):
    return spark.range(n_bad + n_good).select(
        F.col("id").alias("flow_id"), (F.col("id") < n_bad).cast("int").alias("label"))


def sizes(df):
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}


def test_undersample_is_exact_without_repeats(spark):
    kept = sampling.undersample(table(spark, 5000, 700), ratio=3)
    assert sizes(kept) == {1: 2100, 0: 700}
    assert kept.select("flow_id").distinct().count() == 2800
    again = sampling.undersample(table(spark, 5000, 700).repartition(5), ratio=3)
    assert set(map(tuple, again.collect())) == set(map(tuple, kept.collect()))
    assert sizes(sampling.undersample(table(spark, 50, 700), ratio=3)) == {1: 50, 0: 700}


def test_undersample_cuts_through_copies(spark):
    """Most malicious rows are one row repeated; the size is still exact."""
    hot = spark.range(30_000).select(F.lit(-1).cast("bigint").alias("flow_id"), F.lit(1).alias("label"))
    df = table(spark, 500, 4000).unionByName(hot)
    kept = sampling.undersample(df, ratio=3)
    assert sizes(kept) == {1: 12_000, 0: 4000}


def test_partial_key_falls_back_to_the_whole_row(spark):
    df = spark.range(1000).select(F.col("id").alias("flow_id"), F.lit("same").alias("k"))
    kept = sampling.take_lowest(df, 100, sampling.row_key(1, ["k"]))
    assert kept.count() == 100 and kept.distinct().count() == 100
    assert sampling.take_lowest(df, 5000, sampling.row_key(1, ["k"])).count() == 1000
    assert sampling.take_lowest(df, 0, sampling.row_key(1, ["k"])).count() == 0


def test_take_lowest_is_the_sorted_prefix(spark):
    df = spark.range(3000).withColumn("k", sampling.row_key(7, ["id"]))
    for n in (1, 999, 2999, 3000):
        got = {r["id"] for r in sampling.take_lowest(df, n, F.col("k")).collect()}
        want = {r["id"] for r in df.orderBy("k").limit(n).collect()}
        assert got == want


def test_deep_cells_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SMALL_CELL", 0)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    df = spark.range(2000).withColumn("k", sampling.row_key(7, ["id"]))
    assert sampling.take_lowest(df, 777, F.col("k")).count() == 777


def test_row_numbers(spark):
    df = spark.range(400).select((F.col("id") % 300).alias("v"))
    got = sampling.index_rows(df)
    assert sorted(r["row_idx"] for r in got.collect()) == list(range(400))
    by_value = Counter(r["v"] for r in got.collect())
    assert by_value == Counter(r["v"] for r in df.collect())


def test_row_numbers_of_one_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 100)
    df = spark.range(2501).select(F.lit("x").alias("v"))
    got = sorted(r["row_idx"] for r in sampling.index_rows(df).collect())
    assert got == list(range(2501))


def test_bootstrap_and_squares(spark):
    df = table(spark, 60, 0)
    drawn = Counter(r["flow_id"] for r in sampling.bootstrap(df, 200).collect())
    assert sum(drawn.values()) == 200
    squared = Counter(r["flow_id"] for r in sampling.bootstrap(df, 200, squared=True).collect())
    assert squared == {k: n * n for k, n in drawn.items()}


def test_squared_copies_of_known_draws(spark):
    draws = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "v STRING, k BIGINT")
    got = Counter(r["v"] for r in sampling.expand_copies(
        draws.selectExpr("v", "k * k AS n"), "n").collect())
    assert got == {"a": 1, "b": 4, "c": 9}


def test_expand_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 10)
    df = spark.createDataFrame([("a", 95), ("b", 10), ("c", 1), ("d", 0)], "v STRING, n BIGINT")
    got = Counter(r["v"] for r in sampling.expand_copies(df, "n").collect())
    assert got == {"a": 95, "b": 10, "c": 1}


def test_published_totals():
    bad, good = 1_056_039, 145_521
    draws = np.random.RandomState(42).randint(0, bad, 3 * good)
    assert len(draws) == 436_563 and len(draws) + good == 582_084
    counts = np.bincount(draws)
    assert int((counts.astype("int64") ** 2).sum()) + good == 762_672
    test = sampling.test_sizes({1: 762_672 - good, 0: good}, 0.2)
    assert sum(test.values()) == 152_535 and 762_672 - 152_535 == 610_137
    per_scenario = [525_288, 526_181, 156, 2, 546, 53, 3_795, 18]
    assert sum(per_scenario) == bad and bad + good == 1_201_560


def test_split_sizes(spark):
    assert sampling.test_sizes({1: 7, 0: 3}, 0.25) == {1: 2, 0: 1}
    split = sampling.stratified_split(table(spark, 700, 300), 0.25)
    got = {(r["split"], r["label"]): r["rows"] for r in sampling.split_balance(split).collect()}
    assert got == {("test", 1): 175, ("test", 0): 75, ("train", 1): 525, ("train", 0): 225}
    assert split.select("flow_id").distinct().count() == 1000


def test_split_cuts_through_copies(spark):
    df = spark.range(1000).select(F.lit(1).alias("x"), F.lit(1).alias("label"))
    split = sampling.stratified_split(df, 0.2)
    got = {r["split"]: r["rows"] for r in sampling.split_balance(split).collect()}
    assert got == {"test": 200, "train": 800}


def test_copies_stay_on_one_side(spark):
    df = table(spark, 200, 100).crossJoin(spark.range(9).select(F.col("id").alias("copy")))
    split = sampling.leak_free_split(df, ["flow_id"])
    sides = split.groupBy("flow_id").agg(F.count_distinct("split").alias("n"))
    assert sides.filter("n > 1").count() == 0
    share = split.filter("split = 'test'").count() / df.count()
    assert 0.1 < share < 0.3


@pytest.mark.parametrize("mode,rows", [("undersample", 400), ("bootstrap", 400)])
def test_balance_modes(spark, mode, rows):
    assert sampling.balance(table(spark, 900, 100), 3, mode=mode).count() == rows


def test_shuffle_is_a_seeded_permutation(spark):
    df = table(spark, 50, 50)
    a = [r["flow_id"] for r in sampling.shuffle(df).collect()]
    assert sorted(a) == list(range(100)) and a != list(range(100))
    assert a == [r["flow_id"] for r in sampling.shuffle(df.repartition(3)).collect()]
    assert sampling.class_ratio(table(spark, 3, 0)).first()["ratio"] is None


def test_row_numbers_move_rows_once(spark):
    """Without crowded slices there is one shuffle of rows and none for copies."""
    plan = sampling.index_rows(spark.range(400).select((F.col("id") % 300).alias("v")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_row_numbers_beside_a_crowded_slice(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 100)
    df = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    rows = sampling.index_rows(df).withColumn("k", sampling.full_row_key(df, sampling.fixed.SEED)).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == list(range(3000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)
    assert Counter(r["v"] for r in rows) == Counter(r["v"] for r in df.collect())
