"""Coercion, missing values, variance, scaling, alignment."""

import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowlake.functions.numeric import coerce_columns
from flowlake.functions.times import micros, with_flow_time
from flowlake.operators import quality

INF, NAN = float("inf"), float("nan")


def test_coercion(spark):
    texts = ["12", " 12 ", "1e3", "abc", "", "1d", "inf", "nan", "-4.5", "0x10", "1f", "1e999", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, x STRING")
    got = [r["x"] for r in coerce_columns(df, ["x"]).orderBy("i").collect()]
    assert got == [12.0, 12.0, 1000.0, None, None, None, None, None, -4.5, None, None, None, None]


def test_coercion_leaves_identifiers(spark):
    df = spark.createDataFrame([("10.0.0.1", "7", "c2_beacon", 1)],
                               "src_ip STRING, tot_fwd_pkts STRING, scenario STRING, label INT")
    row = quality.coerce_features(df).first()
    assert (row["src_ip"], row["tot_fwd_pkts"], row["scenario"]) == ("10.0.0.1", 7.0, "c2_beacon")


def test_missing_value_policies(spark):
    df = spark.createDataFrame([(1.0, INF), (NAN, 2.0), (3.0, 4.0)], "a DOUBLE, b DOUBLE")
    assert [tuple(r) for r in quality.drop_incomplete(df, ["a", "b"]).collect()] == [(3.0, 4.0)]
    filled = [tuple(r) for r in quality.zero_fill(df, ["a", "b"]).collect()]
    assert filled == [(1.0, 0.0), (0.0, 2.0), (3.0, 4.0)]


def test_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a DOUBLE, b DOUBLE")
    assert quality.zero_variance_columns(df, ["a", "b"]) == ["a"]
    assert quality.drop_zero_variance(df, ["a", "b"]).columns == ["b"]
    assert quality.zero_variance_columns(df.filter("b = 1"), ["a", "b"]) == []
    report = quality.cleaning_report(df.union(spark.createDataFrame([(INF, 9.0)], df.schema)), ["a", "b"])
    assert report.first().asDict() == {"rows_in": 4, "dropped_rows": 1, "remaining_rows": 3,
                                       "dropped_columns": "a", "remaining_features": 1}


def test_scaler_uses_population_deviation(spark):
    train = spark.createDataFrame([(2.0, 5.0), (4.0, 5.0)], "a DOUBLE, b DOUBLE")
    rows = quality.fit_scaler(train, ["a", "b"]).collect()
    assert [(r["mean"], r["std_pop"]) for r in rows] == [(3.0, 1.0), (5.0, 0.0)]
    assert [tuple(r) for r in quality.scale(train, rows).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    test = spark.createDataFrame([(6.0, 7.0)], train.schema)
    assert tuple(quality.scale(test, rows).first()) == (3.0, 2.0)


def test_scaled_train_is_standard(spark, sf_dir):
    from flowlake.queries.base import matrix
    m = matrix(spark, sf_dir)
    names = ["quantity", "price", "tax"]
    scaled = quality.scale(m, quality.fit_scaler(m, names).collect())
    for r in quality.fit_scaler(scaled, names).collect():
        assert math.isclose(r["mean"], 0, abs_tol=1e-9) and math.isclose(r["std_pop"], 1, rel_tol=1e-9)


def test_alignment(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1)], "b DOUBLE, extra DOUBLE, a DOUBLE, label INT")
    fitted = spark.createDataFrame([(0, "a"), (1, "b")], "ord INT, feature STRING").collect()
    assert quality.align_to_scaler(df, fitted, ["label"]).columns == ["label", "a", "b"]
    with pytest.raises(ValueError, match="missing"):
        quality.align_to_scaler(df.drop("a"), fitted)


def test_quality_profile(spark):
    df = spark.createDataFrame([(1.0, INF), (NAN, -INF), (None, 4.0)], "a DOUBLE, b DOUBLE")
    got = {r["feature"]: (r["infinite"], r["missing"]) for r in
           quality.quality_profile(df, ["a", "b"]).collect()}
    assert got == {"a": (0, 2), "b": (2, 0), "*": (2, 2)}


def test_flow_time(spark):
    df = spark.createDataFrame([(1779132299.123457,), (NAN,)], "timestamp DOUBLE")
    got = [r[0] for r in with_flow_time(df).select(micros(F.col("ts"))).collect()]
    assert got == [1779132299123457, None]
    with pytest.raises(ValueError, match="timestamp"):
        with_flow_time(df.withColumnRenamed("timestamp", "time"))


def test_feature_dictionary(spark):
    df = quality.describe_features(spark.createDataFrame([(1.0, 2.0)], "down_up_ratio DOUBLE, other DOUBLE"))
    assert df.schema["down_up_ratio"].metadata["definition"].startswith("ratio")
    assert quality.feature_dictionary(spark).count() == 16
    assert quality.drop_non_features(spark.createDataFrame([("a", 1.0, 1)], "src_ip STRING, x DOUBLE, label INT")
                                     ).columns == ["x", "label"]


def uneven(spark, n=4000):
    """Two features and a constant one, some of them missing or infinite, over many partitions."""
    i = F.col("id")
    return spark.range(0, n, 1, 16).select(
        "id", F.when(i % 7 == 0, F.lit(NAN)).otherwise(i % 11).alias("a"),
        F.when(i % 13 == 0, F.lit(INF)).when(i % 17 != 0, i * 0.5).alias("b"), F.lit(3.0).alias("c"),
        (i % 2).cast("double").alias("label"))


def test_constants_in_uneven_parts(spark):
    """0.1 in parts of 1 to 40 rows, whose merged variance need not come out as zero."""
    parts = spark.range(0, 40, 1, 40).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("i"))
    df = parts.select(F.lit(0.1).alias("a"), F.lit(INF).alias("b"), F.lit(NAN).alias("c"),
                      F.lit(None).cast("double").alias("d"), F.when(F.col("i") == 0, 0.1).alias("e"), F.col("i").alias("f"))
    assert quality.zero_variance_columns(df, list("abcdef")) == ["a", "e"]
    assert quality.cleaning_report(df.select("a", "f"), ["a", "f"]).first()["dropped_columns"] == "a"


def test_write_complete_is_both_in_one_pass(spark, tmp_path):
    features = ["a", "b", "c"]
    cleaned, report = quality.write_complete(spark, uneven, features, str(tmp_path / "rows"))
    assert report.collect() == quality.cleaning_report(uneven(spark), features).collect()
    assert report.first()["dropped_columns"] == "c"
    want = quality.drop_incomplete(uneven(spark), features)
    assert sorted(cleaned.collect()) == sorted(want.collect()) and report.first()["remaining_rows"] == want.count()


@pytest.mark.parametrize("rows", [0, 1])
def test_write_complete_of_few_rows(spark, tmp_path, rows):
    features = ["a", "b", "c"]
    cleaned, report = quality.write_complete(spark, lambda s: uneven(s, 5).filter(F.col("id") < rows), features, str(tmp_path / "rows"))
    assert tuple(report.first()) == (rows, rows, 0, "", 3) and cleaned.count() == 0
    assert cleaned.columns == uneven(spark).columns


def test_observation_and_models_with_a_summary(spark, tmp_path):
    """Why ``write_complete`` observes in a session of its own: there such a model cannot be shipped, here it can."""
    cleaned, _ = quality.write_complete(spark, uneven, ["a", "b", "c"], str(tmp_path / "rows"))
    makers = (LogisticRegression(maxIter=3), RandomForestClassifier(numTrees=3, seed=1))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(cleaned)
    for maker in makers:
        assert maker.fit(data).transform(data).filter("prediction >= 0").count() == cleaned.count()
    own, seen = spark.newSession(), Observation()
    own.range(10).observe(seen, F.count("*").alias("n")).write.parquet(str(tmp_path / "observed"))
    assert seen.get == {"n": 10}
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(own.read.parquet(str(tmp_path / "rows")))
    with pytest.raises(Py4JJavaError, match="ObservationManager"):
        LogisticRegression(maxIter=3).fit(data).transform(data).filter("prediction >= 0").count()
