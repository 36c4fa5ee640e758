"""Most confident flows per scenario and their texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.functions import fixed
from flowlake.functions.text import feature_text, percent_text, preview, prompt_text


def scenario_dimension(spark: SparkSession,
                       texts: Mapping[str, str] = fixed.SCENARIO_TEXT) -> DataFrame:
    """(scenario, description, scenario_ord): a few rows, in report order."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(texts.items())],
                                 "scenario STRING, description STRING, scenario_ord INT")


def describe_scenarios(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Adds ``description``; a scenario without one is described by its key.

    ``dimension`` is the literal dictionary, whose size is that of the program text.
    """
    return (df.join(F.broadcast(dimension), "scenario", "left")
            .withColumn("description", F.coalesce("description", "scenario")))


def top_alerts(scored: DataFrame, n: int = fixed.FLOWS_PER_SCENARIO,
               tiebreak: Sequence[str] = ("flow_id",)) -> DataFrame:
    """The ``n`` highest ``confidence`` flows per scenario, ties by ``tiebreak``.

    Spark trims each task to ``n`` rows per scenario before the shuffle (window group
    limit), so a scenario with most of the flows is no hot spot.
    """
    best = Window.partitionBy("scenario").orderBy(F.desc("confidence"), *tiebreak)
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


def number_alerts(top: DataFrame, dimension: DataFrame) -> DataFrame:
    """Running number over known scenarios in dictionary order, then by place.

    The input is W1's result, at most ``n`` rows per dictionary entry, so one task is enough.
    """
    known = top.join(F.broadcast(dimension), "scenario")
    return known.withColumn(
        "flow_num", F.row_number().over(Window.orderBy("scenario_ord", "place")))


def scenario_leaderboard(scored: DataFrame) -> DataFrame:
    """Flows and highest confidence per scenario."""
    return scored.groupBy("scenario").agg(F.count("*").alias("flows"),
                                          F.max("confidence").alias("max_confidence"))


def alert_features(df: DataFrame, out: str = "features") -> DataFrame:
    """P14 as a column."""
    return df.withColumn(out, feature_text(df.columns))


def alert_prompts(numbered: DataFrame) -> DataFrame:
    """(scenario, flow_num, confidence, prompt) from numbered, described alerts."""
    return alert_features(numbered).withColumn("prompt", prompt_text(
        F.col("scenario"), F.col("description"), F.col("flow_num"), F.col("confidence"),
        F.col("features")))


def attach_explanations(alerts: DataFrame, explanations: DataFrame) -> DataFrame:
    """(flow_num, explanation) joined to the alerts, with a one-line preview."""
    return (alerts.join(explanations.select("flow_num", "explanation"), "flow_num", "left")
            .withColumn("preview", preview(F.col("explanation"))))


def explained_counts(explained: DataFrame) -> DataFrame:
    """Explanations per scenario and overall ('*')."""
    return (explained.rollup("scenario").agg(F.count("explanation").alias("explained"))
            .withColumn("scenario", F.coalesce("scenario", F.lit("*"))))


def explanation_report(explained: DataFrame, classifier: str, writer: str,
                       per_scenario: int = fixed.FLOWS_PER_SCENARIO,
                       title: Sequence[str] = ()) -> DataFrame:
    """(ord, line): a section per scenario, then the summary.

    Input: W2's bounded rows with description and explanation. ``title`` lines come first.
    """
    spark = explained.sparkSession
    known = explained.filter(F.col("explanation").isNotNull())
    key = "STRUCT<block: INT, scenario_ord: INT, flow_num: INT, part: INT>"

    def at(block: int, scenario_ord, flow_num, part: int):
        return F.struct(F.lit(block).alias("block"), scenario_ord.cast("int").alias("scenario_ord"),
                        flow_num.cast("int").alias("flow_num"), F.lit(part).alias("part"))

    zero, last = F.lit(0), F.lit(2**31 - 1)
    order = F.col("scenario_ord")
    per = known.groupBy("scenario", "description", "scenario_ord").agg(F.count("*").alias("n"))
    heads = per.select(at(1, order, zero, 0).alias("ord"), F.concat(
        F.lit("## "), "scenario", F.lit("\n\n**Attack type:** "), "description", F.lit("\n"))
        .alias("line"))
    flows = known.select(at(1, order, F.col("flow_num"), 1).alias("ord"), F.concat(
        F.lit("### Flow #"), F.col("flow_num").cast("string"), F.lit(" -- Confidence: "),
        percent_text(F.col("confidence")), F.lit("\n\n"), "explanation", F.lit("\n"))
        .alias("line"))
    rules = per.select(at(1, order, last, 2).alias("ord"), F.lit("---\n").alias("line"))
    summary = per.select(at(3, order, zero, 0).alias("ord"), F.concat(
        F.lit("| "), "scenario", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))
    total = known.agg(F.count("*").alias("n")).select(at(4, zero, zero, 0).alias("ord"), F.concat(
        F.lit("\n**Total flows explained: "), F.col("n").cast("string"), F.lit("**")).alias("line"))
    fixed_lines = [((0, 0, 0, i), line) for i, line in enumerate([
        *title, f"- Classifier: {classifier}", f"- LLM: {writer}",
        f"- Flows per scenario: {per_scenario}", "", "---", ""])]
    fixed_lines += [((2, 0, 0, i), line) for i, line in enumerate([
        "## Summary", "", "| Scenario | Flows Explained |", "|----------|-----------------|"])]
    frame = spark.createDataFrame(fixed_lines, f"ord {key}, line STRING")
    for part in (heads, flows, rules, summary, total):
        frame = frame.union(part)
    return frame
