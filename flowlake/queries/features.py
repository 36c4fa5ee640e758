"""Quality, pruning, scaling, sampling and splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.numeric import clean_columns, coerce_columns
from flowlake.operators import models, quality, sampling
from flowlake.queries.base import FEATURES, MATRIX_SQL, matrix, query
from flowlake.scratch import scratch_path

ROW = ["l_orderkey", "l_partkey", "l_linenumber", "price"]
KEY = ["key_text"]
_ROW = "l_orderkey, l_partkey, l_linenumber, price"


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_incomplete(matrix(spark, sf_dir), FEATURES)


@query("p5_inf_to_null", f"""WITH {MATRIX_SQL}
SELECT {_ROW}, CASE WHEN isfinite(unit_price) THEN unit_price END AS unit_price FROM matrix""")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (clean_columns(matrix(spark, sf_dir), FEATURES)
            .select(*ROW, "unit_price"))


@query("p6_coerce_numeric", """
SELECT l_orderkey, l_partkey, l_linenumber,
       CASE WHEN l_linenumber IN (1, 2) THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE)
            WHEN l_linenumber = 3 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) * 1000
            END AS amount
FROM lineitem""")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is a number, a padded number, an exponent, then text that is none."""
    m = matrix(spark, sf_dir)
    n = F.col("quantity").cast("int").cast("string")
    text = (F.when(F.col("l_linenumber") == 1, n)
            .when(F.col("l_linenumber") == 2, F.concat(F.lit(" "), n, F.lit(" ")))
            .when(F.col("l_linenumber") == 3, F.concat(n, F.lit("e3")))
            .when(F.col("l_linenumber") == 4, F.concat(n, F.lit("d")))
            .when(F.col("l_linenumber") == 5, F.lit("inf"))
            .when(F.col("l_linenumber") == 6, F.lit(""))
            .otherwise(F.lit("Flow Duration")))
    return coerce_columns(m.select("l_orderkey", "l_partkey", "l_linenumber", text.alias("amount")),
                          ["amount"])


@query("p7_drop_non_features", f"""WITH {MATRIX_SQL}
SELECT label, quantity, price, discount, tax, line, bwd_urg_flags FROM matrix""")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_non_features(
        matrix(spark, sf_dir).drop("l_orderkey", "l_partkey", "l_linenumber", "key_text", "unit_price"))


@query("p8_drop_incomplete", f"""WITH {MATRIX_SQL}
SELECT {_ROW}, unit_price, label FROM clean""")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select(*ROW, "unit_price", "label")


@query("p9_zero_fill", f"""WITH {MATRIX_SQL}
SELECT {_ROW}, CASE WHEN isfinite(unit_price) THEN unit_price ELSE 0 END AS unit_price FROM matrix""")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality.zero_fill(matrix(spark, sf_dir), FEATURES)
            .select(*ROW, "unit_price"))


@query("p10_drop_zero_variance", f"""WITH {MATRIX_SQL}
SELECT quantity, price, discount, tax, line, unit_price FROM clean""")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_zero_variance(_clean(spark, sf_dir).select(*FEATURES), FEATURES)


@query("d5_quality_profile", f"""WITH {MATRIX_SQL},
cells AS (
  {" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM matrix" for f in FEATURES)})
SELECT coalesce(feature, '*') AS feature, count(*) FILTER (isinf(v)) AS infinite,
       count(*) FILTER (v IS NULL) AS missing
FROM cells GROUP BY ROLLUP (feature)""")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_profile(matrix(spark, sf_dir), FEATURES)


def _per_feature(select: str) -> str:
    return " UNION ALL ".join(select.format(f=f, i=i) for i, f in enumerate(FEATURES))


@query("d6_column_variance", f"""WITH {MATRIX_SQL}
{_per_feature("SELECT CAST({i} AS INTEGER) AS ord, '{f}' AS feature, round(var_samp({f}), 4) AS variance FROM clean")}""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality.column_variance(_clean(spark, sf_dir), FEATURES)
            .withColumn("variance", F.round("variance", 4)))


@query("d7_cleaning_report", f"""WITH {MATRIX_SQL}
SELECT (SELECT count(*) FROM matrix) AS rows_in,
       (SELECT count(*) FROM matrix) - count(*) AS dropped_rows, count(*) AS remaining_rows,
       'bwd_urg_flags' AS dropped_columns, CAST(6 AS INTEGER) AS remaining_features FROM clean""")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cleaning_report(matrix(spark, sf_dir), FEATURES)


@query("p8_write_complete", f"""WITH {MATRIX_SQL}
SELECT (SELECT count(*) FROM matrix) AS rows_in,
       (SELECT count(*) FROM matrix) - count(*) AS dropped_rows, count(*) AS remaining_rows,
       'bwd_urg_flags' AS dropped_columns, CAST(6 AS INTEGER) AS remaining_features,
       count(*) AS written_rows, CAST(sum(l_orderkey) AS BIGINT) AS written_orders,
       round(sum(unit_price), 2) AS written_prices FROM clean""")
def p8_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that the write observed, beside what was written."""
    cleaned, report = quality.write_complete(
        spark, lambda own: matrix(own, sf_dir), FEATURES, scratch_path(spark, "complete"))
    written = cleaned.agg(F.count("*").alias("written_rows"), F.sum("l_orderkey").alias("written_orders"),
                          F.round(F.sum("unit_price"), 2).alias("written_prices"))
    return report.join(F.broadcast(written), F.lit(True))


@query("d8_fit_scaler", f"""WITH {MATRIX_SQL}
{_per_feature("SELECT CAST({i} AS INTEGER) AS ord, '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std_pop FROM clean")}""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_scaler(_clean(spark, sf_dir), FEATURES).select(
        "ord", "feature", F.round("mean", 6).alias("mean"), F.round("std_pop", 6).alias("std_pop"))


_SCALED = ", ".join(
    f"round(({f} - (SELECT avg({f}) FROM clean)) / "
    f"coalesce(nullif((SELECT stddev_pop({f}) FROM clean), 0), 1), 6) + 0 AS {f}" for f in FEATURES)


@query("p13_scale", f"WITH {MATRIX_SQL} SELECT l_orderkey, l_partkey, label, {_SCALED} FROM clean")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _clean(spark, sf_dir)
    rows = quality.fit_scaler(clean, FEATURES).collect()
    scaled = quality.scale(clean, rows)
    return scaled.select("l_orderkey", "l_partkey", "label",
                         *[(F.round(f, 6) + 0).alias(f) for f in FEATURES])


@query("p11_align_to_scaler", f"""WITH {MATRIX_SQL}
SELECT label, quantity, price, discount, tax, line FROM matrix""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    fitted = quality.fit_scaler(m, [f for f in FEATURES if f not in ("bwd_urg_flags", "unit_price")])
    return quality.align_to_scaler(m, fitted.select("ord", "feature").collect(), ["label"])


@query("m5_assemble", f"""WITH {MATRIX_SQL}
SELECT l_orderkey, l_partkey, label, quantity AS v0, price AS v1, discount AS v2, tax AS v3, line AS v4
FROM clean""")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["quantity", "price", "discount", "tax", "line"]
    ready = models.assemble(_clean(spark, sf_dir), names)
    v = vector_to_array(models.VECTOR)
    return ready.select("l_orderkey", "l_partkey", "label", *[v[i].alias(f"v{i}") for i in range(5)])


# --- sampling ----------------------------------------------------------------------------------
@query("r1_union_classes", f"""WITH {MATRIX_SQL}
SELECT {_ROW}, label FROM matrix""")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes apart, with different column orders, then together by name."""
    m = matrix(spark, sf_dir).select(*ROW, "label")
    return m.filter("label = 1").unionByName(m.filter("label = 0").select("label", *reversed(ROW)))


_RANKED = f"""{MATRIX_SQL},
n AS (SELECT count(*) FILTER (label = 0) AS good, count(*) FILTER (label = 1) AS bad FROM matrix),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, price) AS rn FROM matrix)"""


@query("r2_undersample", f"""WITH {_RANKED}
SELECT {_ROW}, label FROM ranked WHERE label = 0 OR rn <= (SELECT least(good, bad) FROM n)""")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(matrix(spark, sf_dir), ratio=1, key_columns=KEY).select(*ROW, "label")


_DRAWN = f"""{MATRIX_SQL},
bad AS (SELECT *, row_number() OVER (ORDER BY h, price) - 1 AS idx FROM matrix WHERE label = 1),
good AS (SELECT * FROM matrix WHERE label = 0),
draws AS (SELECT ('0x' || substr(md5('42|' || i), 1, 15))::BIGINT % (SELECT count(*) FROM bad) AS idx,
                 count(*) AS k
          FROM range((SELECT count(*) FROM good)) AS r(i) GROUP BY 1)"""


@query("r3_bootstrap", f"""WITH {_DRAWN}
SELECT {_ROW} FROM bad JOIN draws USING (idx), range(k) UNION ALL
SELECT {_ROW} FROM good""")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balance(matrix(spark, sf_dir), ratio=1, key_columns=KEY,
                            mode="bootstrap").select(*ROW)


@query("r4_bootstrap_squared", f"""WITH {_DRAWN}
SELECT {_ROW} FROM bad JOIN draws USING (idx), range(k * k) UNION ALL
SELECT {_ROW} FROM good""")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balance(matrix(spark, sf_dir), ratio=1, key_columns=KEY,
                            mode="squared").select(*ROW)


@query("r5_shuffle", f"""WITH {MATRIX_SQL} SELECT {_ROW} FROM matrix""")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffle(matrix(spark, sf_dir), key_columns=KEY).select(*ROW)


@query("r5_index_rows", f"""WITH {MATRIX_SQL}
SELECT {_ROW}, row_number() OVER (ORDER BY h, price) - 1 AS row_idx FROM matrix""")
def r5_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.index_rows(matrix(spark, sf_dir), key_columns=KEY).select(*ROW, "row_idx")


_SPLIT_SIZES = """sizes AS (
  SELECT bad + good AS total, CAST(ceil(round((bad + good) * 0.2, 9)) AS BIGINT) AS test,
         good, bad FROM n),
trains AS (
  SELECT total - test AS train, good * (total - test) / total::DOUBLE AS g,
         bad * (total - test) / total::DOUBLE AS b, good, bad FROM sizes),
tests AS (
  SELECT good - floor(g) - CASE WHEN train - floor(g) - floor(b) > 0 AND g - floor(g) >= b - floor(b) THEN 1 ELSE 0 END AS t0,
         bad - floor(b) - CASE WHEN train - floor(g) - floor(b) > 0 AND g - floor(g) < b - floor(b) THEN 1 ELSE 0 END AS t1
  FROM trains)"""


@query("r6_stratified_split", f"""WITH {_RANKED}, {_SPLIT_SIZES}
SELECT {_ROW}, label, CASE WHEN rn <= (SELECT CASE WHEN label = 1 THEN t1 ELSE t0 END FROM tests)
  THEN 'test' ELSE 'train' END AS split FROM ranked""")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sampling.stratified_split(matrix(spark, sf_dir), key_columns=KEY)
            .select(*ROW, "label", "split"))


@query("d15_split_balance", f"""WITH {_RANKED}, {_SPLIT_SIZES}
SELECT CASE WHEN rn <= (SELECT CASE WHEN label = 1 THEN t1 ELSE t0 END FROM tests)
  THEN 'test' ELSE 'train' END AS split, label, count(*) AS rows FROM ranked GROUP BY ALL""")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_balance(sampling.stratified_split(matrix(spark, sf_dir), key_columns=KEY))


@query("r7_leak_free_split", f"""WITH {MATRIX_SQL}
SELECT {_ROW}, CASE WHEN ('0x' || substr(md5('42|' || l_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2
  THEN 'test' ELSE 'train' END AS split FROM matrix""")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of an order on one side."""
    return sampling.leak_free_split(matrix(spark, sf_dir), ["l_orderkey"]).select(*ROW, "split")
