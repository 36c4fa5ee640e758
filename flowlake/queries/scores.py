"""Evaluation of deterministic scores (D10-D13, W5, W6, S13) and alert texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import fixed
from flowlake.functions.text import definitions_text, feature_text, preview
from flowlake.operators import alerts, evaluation, labeling, quality, sampling
from flowlake.queries.base import (LABELED_SQL, MATRIX_SQL, MODELS, PREDICTIONS_SQL, labeled, matrix,
                                   predictions, query)
from flowlake.scratch import scratch_path
from flowlake.sources import sinks

_CELLS = f"""{PREDICTIONS_SQL},
cells AS (SELECT model, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
                 count(*) FILTER (label = 0 AND prediction = 1) AS fp,
                 count(*) FILTER (label = 1 AND prediction = 0) AS fn,
                 count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM predictions GROUP BY model)"""


@query("d10_confusion_matrix", f"""WITH {_CELLS}
SELECT model, 0 AS actual, 0 AS predicted, tn AS rows FROM cells UNION ALL
SELECT model, 0, 1, fp FROM cells UNION ALL SELECT model, 1, 0, fn FROM cells UNION ALL
SELECT model, 1, 1, tp FROM cells""")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_matrix(predictions(spark, sf_dir))


_RATES = f"""{_CELLS},
rates AS (SELECT model, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM cells)"""
_AUC = """groups AS (SELECT model, score, count(*) FILTER (label = 1) AS pos,
                 count(*) FILTER (label = 0) AS neg FROM predictions GROUP BY model, score),
curve AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
                 sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
          FROM groups WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
auc AS (SELECT model, sum(neg * (tps - pos + pos / 2::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS roc_auc
        FROM curve GROUP BY model)"""


@query("d11_binary_metrics", f"""WITH {_RATES}
SELECT model, metric, round(value, 6) AS value
FROM rates UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))""")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.binary_metrics(predictions(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("d12_roc_auc", f"""WITH {PREDICTIONS_SQL}, {_AUC}
SELECT model, 'roc_auc' AS metric, round(roc_auc, 6) AS value FROM auc""")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_auc(predictions(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("d13_model_comparison", f"""WITH {_RATES}, {_AUC}
SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc
FROM rates JOIN auc USING (model)""")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = evaluation.model_comparison(evaluation.all_metrics(predictions(spark, sf_dir)))
    return wide.select("model", *[F.round(m, 6).alias(m) for m in fixed.METRIC_ORDER])


@query("w5_roc_points", f"""WITH {PREDICTIONS_SQL}, {_AUC}
SELECT model, score, tps::BIGINT AS tps, fps::BIGINT AS fps, round(tps / p::DOUBLE, 6) AS tpr,
       round(fps / n::DOUBLE, 6) AS fpr FROM curve
UNION ALL SELECT DISTINCT model, NULL, 0, 0, 0, 0 FROM curve""")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_points(predictions(spark, sf_dir)).select(
        "model", "score", "tps", "fps", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("w5_roc_corners", f"""WITH {PREDICTIONS_SQL}, {_AUC},
steps AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS i
          FROM curve WINDOW w AS (PARTITION BY model ORDER BY score DESC))
SELECT model, score, tps::BIGINT AS tps, fps::BIGINT AS fps FROM steps
WHERE np IS NULL OR np <> pos OR nn <> neg OR i = 1
UNION ALL SELECT DISTINCT model, NULL, 0, 0 FROM curve""")
def w5_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_points(predictions(spark, sf_dir), drop_collinear=True).select(
        "model", "score", "tps", "fps")


@query("w6_best_model", f"""WITH {_RATES}
SELECT arg_max(model, f1) AS model, round(max(f1), 6) AS f1 FROM rates""")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = evaluation.best_model(evaluation.binary_metrics(predictions(spark, sf_dir)), MODELS)
    return best.withColumn("f1", F.round("f1", 6))


_HEAD = ["# Model Evaluation Report", "", "## Dataset", "", "- Features: 7",
         "- Classes: Benign (0), Malicious (1)", "", "## Results Summary", "",
         "| Model | Accuracy | Precision | Recall | F1 | ROC-AUC |",
         "|-------|----------|-----------|--------|----|---------|",
         "", "## Attack Scenario Coverage", "", "", "| Scenario | Flows |", "|----------|-------|"]
_UNIT = "('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2"


@query("s13_evaluation_report", f"""WITH {_RATES}, {_AUC},
{LABELED_SQL},
counts AS (SELECT scenario, count(*) AS flows FROM labeled WHERE scenario <> '' GROUP BY scenario)
SELECT * FROM (VALUES {", ".join(f"('{line}')" for line in _HEAD)}) AS v(value) UNION ALL
SELECT '- Test samples: ' || format('{{:,}}', count(*)) FROM matrix WHERE {_UNIT} UNION ALL
SELECT '- Training samples: ' || format('{{:,}}', count(*)) FROM matrix WHERE NOT ({_UNIT}) UNION ALL
SELECT 'The model was trained on traffic from ' || count(*) || ' attack scenarios:' FROM counts UNION ALL
SELECT '| ' || scenario || ' | ' || format('{{:,}}', flows) || ' |' FROM counts UNION ALL
SELECT printf('| %s | %.4f | %.4f | %.4f | %.4f | %.4f |', model, accuracy, precision, recall, f1, roc_auc)
FROM rates JOIN auc USING (model)""")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines as written; counts come from the tables."""
    comparison = evaluation.model_comparison(evaluation.all_metrics(predictions(spark, sf_dir)))
    split = sampling.approximate_split(matrix(spark, sf_dir), key_columns=["key_text"])
    path = scratch_path(spark, "s13")
    sinks.write_report(evaluation.evaluation_report(
        comparison, labeling.scenario_counts(labeled(spark, sf_dir)), sampling.split_balance(split),
        7, MODELS), path)
    return spark.read.text(path)


# --- alerts ---------------------------------------------------------------------------------------
_SCORED = f"""{LABELED_SQL},
scored AS (SELECT *, round(k / 100.0::DOUBLE, 1) AS confidence,
             CASE WHEN k % 3 = 0 THEN NULL ELSE value * 10000 END AS flow_duration,
             CAST(k AS DOUBLE) AS tot_fwd_pkts, k / 7::DOUBLE AS down_up_ratio,
             CASE WHEN k % 4 = 0 THEN 0 ELSE value END AS flow_byts_s
           FROM labeled WHERE label = 1)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return labeled(spark, sf_dir).filter("label = 1").select(
        "*", F.round(k / F.lit(100.0), 1).alias("confidence"),
        F.when(k % 3 != 0, F.col("value") * 10000).alias("flow_duration"),
        k.cast("double").alias("tot_fwd_pkts"), (k / F.lit(7.0)).alias("down_up_ratio"),
        F.when(k % 4 == 0, 0.0).otherwise(F.col("value")).alias("flow_byts_s"))


_TOP = f"""{_SCORED},
top AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY confidence DESC, flow_id) AS place
        FROM scored QUALIFY place <= 2),
names AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(fixed.SCENARIO_TEXT.items()))})
          AS v(scenario, description, o)),
numbered AS (SELECT t.*, description, o, row_number() OVER (ORDER BY o, place) AS flow_num
             FROM top t JOIN names USING (scenario))"""


@query("w1_top_alerts", f"WITH {_TOP} SELECT scenario, place, flow_id, confidence FROM top")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (alerts.top_alerts(_scored(spark, sf_dir))
            .select("scenario", F.col("place").cast("bigint").alias("place"), "flow_id", "confidence"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.number_alerts(alerts.top_alerts(_scored(spark, sf_dir)),
                                alerts.scenario_dimension(spark))


@query("w2_flow_numbers", f"WITH {_TOP} SELECT flow_num, scenario, flow_id FROM numbered")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select(F.col("flow_num").cast("bigint").alias("flow_num"),
                                           "scenario", "flow_id")


@query("w7_scenario_leaderboard", f"""WITH {_SCORED}
SELECT scenario, count(*) AS flows, max(confidence) AS max_confidence FROM scored GROUP BY scenario""")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.scenario_leaderboard(_scored(spark, sf_dir))


def _text_sql(f: str) -> str:
    return (f"CASE WHEN {f} IS NOT NULL AND {f} <> 0 THEN '  - {f}: ' || CASE WHEN abs({f}) > 1000 "
            f"THEN format('{{:,.0f}}', {f}) ELSE printf('%.4f', {f}) END END")


_FEATURE_SQL = ("coalesce(nullif(concat_ws(chr(10), " + ", ".join(
    _text_sql(f) for f in ("flow_duration", "tot_fwd_pkts", "flow_byts_s", "down_up_ratio"))
    + f"), ''), '{fixed.NO_FEATURES_TEXT}')")


@query("p14_feature_text", f"WITH {_SCORED} SELECT flow_id, {_FEATURE_SQL} AS features FROM scored")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("flow_id", feature_text(s.columns).alias("features"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PROMPT_SQL = " || ".join([
    _quoted(fixed.PROMPT_OPENING), "description", _quoted(fixed.PROMPT_AFTER_SCENARIO), "flow_num",
    _quoted(fixed.PROMPT_AFTER_NUMBER), "printf('%.1f%%', confidence * 100)",
    _quoted(fixed.PROMPT_AFTER_CONFIDENCE), _FEATURE_SQL,
    _quoted(fixed.PROMPT_BEFORE_DEFINITIONS + definitions_text() + fixed.PROMPT_QUESTIONS),
    "scenario", _quoted(fixed.PROMPT_CLOSING)])


@query("p15_prompts", f"WITH {_TOP} SELECT flow_num, {_PROMPT_SQL} AS prompt FROM numbered")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_prompts(_numbered(spark, sf_dir)).select(
        F.col("flow_num").cast("bigint").alias("flow_num"), "prompt")


@query("p16_preview", r"""SELECT doc_id, replace(substr(text, 1, 120), chr(10), ' ') AS preview FROM documents""")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", preview(F.col("text")).alias("preview"))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for the alerts: the documents, by number."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("int").alias("flow_num"), F.col("text").alias("explanation"))
    return alerts.attach_explanations(_numbered(spark, sf_dir), texts)


_EXPLAINED = f"""{_TOP},
explained AS (SELECT n.*, d.text AS explanation FROM numbered n LEFT JOIN documents d ON d.doc_id = n.flow_num)"""


@query("j6_attach_explanations", f"""WITH {_EXPLAINED}
SELECT flow_num, scenario, flow_id, md5(explanation) AS text_md5,
       replace(substr(explanation, 1, 120), chr(10), ' ') AS preview FROM explained""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).select(
        F.col("flow_num").cast("bigint").alias("flow_num"), "scenario", "flow_id",
        F.md5("explanation").alias("text_md5"), "preview")


@query("d14_explained_counts", f"""WITH {_EXPLAINED}
SELECT coalesce(scenario, '*') AS scenario, count(explanation) AS explained FROM explained
GROUP BY ROLLUP (scenario)""")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.explained_counts(_explained(spark, sf_dir))


_SUMMARY = ["- Classifier: by value", "- LLM: documents", "- Flows per scenario: 2", "", "---", "",
            "## Summary", "", "| Scenario | Flows Explained |", "|----------|-----------------|"]


@query("s14_explanation_report", f"""WITH {_EXPLAINED},
known AS (SELECT * FROM explained WHERE explanation IS NOT NULL),
parts AS (
  SELECT unnest(string_split('## ' || scenario || chr(10) || chr(10) || '**Attack type:** ' || description
    || chr(10), chr(10))) AS value FROM (SELECT DISTINCT scenario, description FROM known) UNION ALL
  SELECT unnest(string_split(printf('### Flow #%d -- Confidence: %.1f%%', flow_num, confidence * 100)
    || chr(10) || chr(10) || explanation || chr(10), chr(10))) FROM known UNION ALL
  SELECT unnest(['---', '']) FROM (SELECT DISTINCT scenario FROM known) UNION ALL
  SELECT '| ' || scenario || ' | ' || count(*) || ' |' FROM known GROUP BY scenario UNION ALL
  SELECT unnest(['', '**Total flows explained: ' || count(*) || '**']) FROM known UNION ALL
  SELECT * FROM (VALUES {", ".join(f"('{line}')" for line in _SUMMARY)}) AS v(value))
SELECT value FROM parts""")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "s14")
    sinks.write_report(alerts.explanation_report(
        _explained(spark, sf_dir), "by value", "documents"), path)
    return spark.read.text(path)


@query("p19_feature_dictionary", f"""WITH {_SCORED},
dictionary AS (SELECT * FROM (VALUES {", ".join(
    f"('{n}', '{m}')" for names, _, m in fixed.FEATURE_DEFINITIONS for n in names)}) AS v(feature, definition)),
cells AS (SELECT 'flow_duration' AS feature, flow_duration AS v FROM scored UNION ALL
          SELECT 'tot_fwd_pkts', tot_fwd_pkts FROM scored UNION ALL
          SELECT 'flow_byts_s', flow_byts_s FROM scored UNION ALL
          SELECT 'down_up_ratio', down_up_ratio FROM scored)
SELECT feature, definition, count(v) AS present FROM cells JOIN dictionary USING (feature) GROUP BY ALL""")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions beside how often each described feature of the flows is present."""
    s = quality.describe_features(_scored(spark, sf_dir))
    described = [f.name for f in s.schema.fields if "definition" in f.metadata]
    counts = s.agg(*[F.count(f).alias(f) for f in described]).unpivot(
        [], described, "feature", "present")
    return counts.join(F.broadcast(quality.feature_dictionary(spark, described)), "feature").select(
        "feature", "definition", "present")
