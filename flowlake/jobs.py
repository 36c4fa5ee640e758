"""The four jobs: label, train, explain, ids.

    spark-submit flowlake/jobs.py label --flows DIR --sessions CSV --out DIR
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import fixed
from flowlake.functions.numeric import clean_columns
from flowlake.functions.times import with_flow_time
from flowlake.operators import alerts, evaluation, ids, labeling, models, quality, sampling
from flowlake.scratch import materialize
from flowlake.session import build_session, shuffle_partitions
from flowlake.sources import sinks
from flowlake.sources.flows import read_flows
from flowlake.sources.ids import read_ids_events
from flowlake.sources.sessions import read_sessions


@dataclass(frozen=True)
class JobParams:
    """What a configuration file would hold."""

    offset_hours: int = 0
    ratio: int = fixed.UNDERSAMPLE_RATIO
    test_share: float = fixed.TEST_SHARE
    seed: int = fixed.SEED
    per_scenario: int = fixed.FLOWS_PER_SCENARIO
    balance_mode: str = "undersample"
    models: models.ModelParams = field(default_factory=models.ModelParams)


def label_job(spark: SparkSession, flows_path: str, sessions_path: str, out: str,
              params: JobParams = JobParams()) -> DataFrame:
    """Files to labeled dataset; returns the report of matches per window."""
    sessions = read_sessions(spark, sessions_path, params.offset_hours)
    flows = with_flow_time(read_flows(spark, flows_path))
    flows = flows.withColumn("flow_id", F.xxhash64(*flows.columns))
    labeled = labeling.label_flows(flows, sessions)
    sinks.write_dataset(clean_columns(labeled), out)
    return labeling.session_match_report(spark.read.parquet(out), sessions)


def prepare(labeled: DataFrame, params: JobParams = JobParams()) -> tuple[DataFrame, list[str]]:
    """Coerce, clean, prune, split without leaks, balance each side.

    ``flow_id`` is a hash of the whole row, so copies of a flow share it and its side.
    """
    table = labeled if "flow_id" in labeled.columns else labeled.withColumn(
        "flow_id", F.xxhash64(*labeled.columns))
    not_features = {*fixed.NON_FEATURES, "flow_id", "ts"}
    features = [c for c in table.columns if c not in not_features]
    typed = quality.coerce_columns(table, features).select("flow_id", "label", *features)
    clean = materialize(quality.drop_incomplete(typed, features), "clean")
    constant = set(quality.zero_variance_columns(clean, features))
    features = [f for f in features if f not in constant]
    split = sampling.leak_free_split(clean.drop(*constant), ["flow_id"], params.test_share,
                                     params.seed)
    sides = [sampling.balance(split.filter(F.col("split") == side), params.ratio, params.seed,
                              mode=params.balance_mode) for side in ("train", "test")]
    return materialize(sides[0].unionByName(sides[1]), "balanced"), features


def train_job(spark: SparkSession, labeled_path: str, out: str,
              params: JobParams = JobParams()) -> DataFrame:
    """Labeled dataset to scaler, models, metrics and report under ``out``."""
    labeled = spark.read.parquet(labeled_path)
    balanced, features = prepare(labeled, params)
    train, test = (balanced.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    scaler = quality.fit_scaler(train, features)
    sinks.save_scaler(scaler, f"{out}/scaler")
    rows = sinks.load_scaler(spark, f"{out}/scaler").collect()
    sinks.write_dataset(quality.scale(train, rows), f"{out}/train")
    sinks.write_dataset(quality.scale(test, rows), f"{out}/test")
    fitted = models.fit_models(spark.read.parquet(f"{out}/train"), features, params.models)
    for name, model in fitted.items():
        sinks.save_model(model, f"{out}/models/{name}")
    predictions = materialize(
        models.score_all(fitted, spark.read.parquet(f"{out}/test")), "predictions")
    metrics = materialize(evaluation.all_metrics(predictions), "metrics")
    metrics.write.mode("overwrite").parquet(f"{out}/metrics")
    evaluation.roc_points(predictions).write.mode("overwrite").parquet(f"{out}/roc")
    evaluation.confusion_matrix(predictions).write.mode("overwrite").parquet(f"{out}/confusion")
    models.feature_importance(fitted["random_forest"], features, spark) \
        .write.mode("overwrite").parquet(f"{out}/importance")
    sinks.write_report(
        evaluation.evaluation_report(
            evaluation.model_comparison(metrics), labeling.scenario_counts(labeled),
            sampling.split_balance(balanced), len(features), models.MODEL_ORDER),
        f"{out}/evaluation_report")
    return metrics


def explain_job(spark: SparkSession, labeled_path: str, trained: str, out: str,
                explanations: DataFrame | None = None,
                params: JobParams = JobParams()) -> DataFrame:
    """Most confident flows per scenario with prompts; with texts given, also the report."""
    rows = sinks.load_scaler(spark, f"{trained}/scaler").collect()
    model = sinks.load_model(f"{trained}/models/random_forest")
    names = [r["feature"] for r in rows]
    bad = (spark.read.parquet(labeled_path).filter(F.col("label") == 1)
           .filter(F.col("scenario").isin(list(fixed.SCENARIO_TEXT))))
    bad = quality.coerce_columns(bad, names)
    scored = models.rescore(bad, rows, model, ["flow_id", "scenario"])
    dimension = alerts.scenario_dimension(spark)
    top = alerts.top_alerts(scored.withColumnRenamed("score", "confidence")
                            .select("flow_id", "scenario", "confidence"), params.per_scenario)
    # The alert side is at most n rows per dictionary entry. Copies of a flow share its id.
    numbered = (quality.zero_fill(bad, names).select("flow_id", *names)
                .join(F.broadcast(alerts.number_alerts(top, dimension)), "flow_id")
                .dropDuplicates(["flow_num"]))
    prompts = materialize(alerts.alert_prompts(numbered), "prompts")
    prompts.write.mode("overwrite").parquet(f"{out}/prompts")
    if explanations is not None:
        explained = alerts.attach_explanations(prompts, explanations)
        sinks.write_report(alerts.explanation_report(
            explained, f"Random Forest ({len(names)} features)", "given texts",
            params.per_scenario), f"{out}/explanations")
    return prompts


def ids_job(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """IDS files to one kept run of events; returns counts per type."""
    events = read_ids_events(spark, paths)
    sinks.append_run(events, out)
    return ids.ids_event_counts(sinks.latest_run(spark, out))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    label = jobs.add_parser("label")
    label.add_argument("--flows", required=True)
    label.add_argument("--sessions", required=True)
    label.add_argument("--offset-hours", type=int, default=0)
    train = jobs.add_parser("train")
    train.add_argument("--labeled", required=True)
    explain = jobs.add_parser("explain")
    explain.add_argument("--labeled", required=True)
    explain.add_argument("--trained", required=True)
    events = jobs.add_parser("ids")
    events.add_argument("--events", nargs="+", required=True)
    for job in (label, train, explain, events):
        job.add_argument("--out", required=True)
        job.add_argument("--input-gb", type=int, default=0,
                         help="size of the input, for the number of shuffle partitions")
    args = parser.parse_args()
    parts = shuffle_partitions(args.input_gb << 30)
    spark = build_session(f"flowlake-{args.job}", **{"spark.sql.shuffle.partitions": str(parts)})
    if args.job == "label":
        label_job(spark, args.flows, args.sessions, args.out,
                  JobParams(offset_hours=args.offset_hours)).show(1000, truncate=False)
    elif args.job == "train":
        train_job(spark, args.labeled, args.out).show(truncate=False)
    elif args.job == "explain":
        explain_job(spark, args.labeled, args.trained, args.out).show(1000)
    else:
        ids_job(spark, args.events, args.out).show()


if __name__ == "__main__":
    main()
