"""Feature quality, pruning and scaling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import fixed
from flowlake.functions.numeric import clean_columns, coerce_columns, is_float


def feature_columns(df: DataFrame, non_features: Sequence[str] = fixed.NON_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in non_features]


def drop_non_features(df: DataFrame, keep: Sequence[str] = ("label",)) -> DataFrame:
    """Identifiers, time and scenario go where present; the target stays beside X."""
    return df.drop(*[c for c in fixed.NON_FEATURES if c in df.columns and c not in keep])


def coerce_features(df: DataFrame) -> DataFrame:
    """P6 on feature columns only."""
    return coerce_columns(df, feature_columns(df))


def drop_incomplete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """P8, training policy: rows with any missing or infinite feature go.

    ``cleaning_report`` counts them; ``write_complete`` does both in one pass.
    """
    return clean_columns(df, features).dropna("any", subset=list(features))


def _any_missing(features: Sequence[str]) -> Column:
    missing = F.lit(False)
    for f in features:
        missing = missing | F.col(f).isNull()
    return missing


def zero_fill(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """P9, explanation policy: missing and infinite become 0."""
    return clean_columns(df, features).fillna(0.0, subset=list(features))


def _long(df: DataFrame, features: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """One pass over the table, then one row per feature: (ord, feature, stats...)."""
    aggregates = [make(f).alias(f"{name}_{i}")
                  for i, f in enumerate(features) for name, make in stats.items()]
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("feature"),
                     *[F.col(f"{name}_{i}").alias(name) for name in stats])
            for i, f in enumerate(features)]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def quality_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Infinite and missing (null or NaN) cells per feature, and over all as '*'."""
    def infinite(f: str) -> Column:
        if not is_float(df, f):
            return F.lit(0).cast("bigint")
        return F.count_if(F.abs(F.col(f)) == F.lit(float("inf")))

    def missing(f: str) -> Column:
        nan = F.isnan(F.col(f)) if is_float(df, f) else F.lit(False)
        return F.count_if(F.col(f).isNull() | nan)

    per_column = _long(df, features, {"infinite": infinite, "missing": missing})
    return (per_column.rollup("feature")
            .agg(F.sum("infinite").alias("infinite"), F.sum("missing").alias("missing"))
            .withColumn("feature", F.coalesce("feature", F.lit("*"))))


def column_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sample variance per feature; one row gives null."""
    return _long(df, features, {"variance": lambda f: F.var_samp(F.col(f).cast("double"))})


def _constant(value: Column) -> Column:
    """Whether all of two or more values are one finite number.

    That is a variance of zero, but exact: variances of parts of unequal size are merged with
    rounding, and a constant can come out as 1e-31 or as 0, depending on which part ends first.
    """
    value = value.cast("double")
    return (F.count(value) >= 2) & (F.min(value) == F.max(value)) & (F.abs(F.max(value)) < F.lit(float("inf")))


def zero_variance_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    rows = _long(df, features, {"constant": lambda f: _constant(F.col(f))}).filter("constant").orderBy("ord").collect()
    return [r["feature"] for r in rows]


def drop_zero_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """P10: constant features go. The data decide the schema, so this runs a job."""
    return df.drop(*zero_variance_columns(df, features))


def _report_stats(features: Sequence[str]) -> list[Column]:
    """Row counts, and which features are constant in the complete rows, as aggregates of one pass."""
    missing = _any_missing(features)
    return [F.count(F.lit(1)).alias("rows_in"), F.count_if(missing).alias("dropped_rows"),
            *[_constant(F.when(~missing, F.col(f))).alias(f"_constant_{i}") for i, f in enumerate(features)]]


def _report(stats: DataFrame, features: Sequence[str]) -> DataFrame:
    constant = F.array_compact(F.array(*[F.when(F.col(f"_constant_{i}"), F.lit(f)) for i, f in enumerate(features)]))
    return stats.select(
        "rows_in", "dropped_rows", (F.col("rows_in") - F.col("dropped_rows")).alias("remaining_rows"),
        F.array_join(constant, ",").alias("dropped_columns"),
        (F.lit(len(features)) - F.size(constant)).alias("remaining_features"))


def cleaning_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows dropped and remaining, columns dropped and remaining, in one row."""
    return _report(clean_columns(df, features).agg(*_report_stats(features)), features)


def write_complete(spark: SparkSession, read: Callable[[SparkSession], DataFrame],
                   features: Sequence[str], path: str) -> tuple[DataFrame, DataFrame]:
    """P8 and D7 in one pass: (complete rows, now at ``path``; the cleaning report of that write).

    ``read`` builds the table in the session it is given. That is one of its own, as Spark 4.1 fails
    to ship MLlib models that keep a training summary in a session where an observation has run.
    The counts are those of the tasks that wrote the files: the observation stands in the last
    stage, where a task that is run again after a lost executor counts once. An empty table
    gives a report of zeros.
    """
    own = spark.newSession()
    # Settings of the session that were made while it ran do not pass to a new one by themselves.
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    seen = Observation()
    df = clean_columns(read(own), features).observe(seen, *_report_stats(features))
    df.dropna("any", subset=list(features)).write.mode("overwrite").parquet(path)
    got = seen.get
    row = [got.get("rows_in", 0), got.get("dropped_rows", 0),
           *[got.get(f"_constant_{i}") for i in range(len(features))]]
    schema = "rows_in long, dropped_rows long" + "".join(f", _constant_{i} boolean" for i in range(len(features)))
    stats = spark.createDataFrame([tuple(row)], schema)
    return spark.read.schema(df.schema).parquet(path), _report(stats, features)


def fit_scaler(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature, in column order, one pass."""
    return _long(train, features, {
        "mean": lambda f: F.avg(F.col(f).cast("double")),
        "std_pop": lambda f: F.stddev_pop(F.col(f).cast("double"))})


def align_to_scaler(df: DataFrame, scaler_rows: Sequence, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the fitted features, in fitted order; a missing one is an error."""
    wanted = [r["feature"] for r in sorted(scaler_rows, key=lambda r: r["ord"])]
    absent = [f for f in wanted if f not in df.columns]
    if absent:
        raise ValueError(f"features missing from the table: {absent}")
    return df.select(*keep, *wanted)


def scale(df: DataFrame, scaler_rows: Sequence) -> DataFrame:
    """(x - mean) / std with a zero deviation taken as 1; other columns stay."""
    fitted = {r["feature"]: (r["mean"], r["std_pop"] or 1.0) for r in scaler_rows}
    return df.select(*[
        ((F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1])).alias(c) if c in fitted
        else F.col(c) for c in df.columns])


def feature_dictionary(spark: SparkSession, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, definition) table."""
    rows = [(f, meaning) for names, _, meaning in fixed.FEATURE_DEFINITIONS for f in names
            if features is None or f in features]
    return spark.createDataFrame(rows, "feature STRING, definition STRING")


def describe_features(df: DataFrame) -> DataFrame:
    """Definitions as column metadata."""
    for names, _, meaning in fixed.FEATURE_DEFINITIONS:
        for f in names:
            if f in df.columns:
                df = df.withMetadata(f, {"definition": meaning})
    return df
