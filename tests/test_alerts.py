"""Top alerts, texts, prompts and the explanation report."""

from pyspark.sql import functions as F

from flowlake.functions.text import feature_text, percent_text, preview
from flowlake.operators import alerts


def scored(spark, rows):
    return spark.createDataFrame(rows, "scenario STRING, flow_id BIGINT, confidence DOUBLE")


def test_ties_go_by_flow_id(spark):
    df = scored(spark, [("c2_beacon", i, .9) for i in (3, 1, 2)])
    top = alerts.top_alerts(df, 2).orderBy("place").collect()
    assert [r["flow_id"] for r in top] == [1, 2]


def test_top_is_trimmed_before_the_shuffle(spark, sf_dir):
    from flowlake.queries.base import labeled
    df = labeled(spark, sf_dir).withColumn("confidence", F.col("value"))
    plan = alerts.top_alerts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_numbers_follow_the_dictionary(spark):
    df = scored(spark, [("metasploit_ms17010", 1, .5), ("nmap_syn_scan", 2, .4), ("nmap_syn_scan", 3, .6),
                        ("unlisted", 4, .9)])
    got = alerts.number_alerts(alerts.top_alerts(df), alerts.scenario_dimension(spark))
    assert [(r["flow_num"], r["flow_id"]) for r in got.orderBy("flow_num").collect()] == [(1, 3), (2, 2), (3, 1)]
    described = alerts.describe_scenarios(df, alerts.scenario_dimension(spark))
    assert described.filter("scenario = 'unlisted'").first()["description"] == "unlisted"
    board = alerts.scenario_leaderboard(df).filter("scenario = 'nmap_syn_scan'").first()
    assert (board["flows"], board["max_confidence"]) == (2, .6)


def test_feature_text(spark):
    df = spark.createDataFrame([(1510673.0, 4.0, 0.0, None, -2500.4, 1000.0)],
                               "flow_duration DOUBLE, tot_fwd_pkts DOUBLE, tot_bwd_pkts DOUBLE,"
                               " flow_byts_s DOUBLE, fwd_iat_mean DOUBLE, down_up_ratio DOUBLE")
    assert df.select(feature_text(df.columns)).first()[0] == (
        "  - flow_duration: 1,510,673\n  - tot_fwd_pkts: 4.0000\n  - fwd_iat_mean: -2,500\n"
        "  - down_up_ratio: 1000.0000")
    empty = spark.createDataFrame([(0.0,)], "flow_duration DOUBLE")
    assert empty.select(feature_text(empty.columns)).first()[0] == "  (no significant feature values)"


def test_number_text_rounds_like_exact_decimals(spark):
    values = [0.00005, 0.12345, 2.00005, 0.5, 999.99996, 1234.5, 1235.5]
    df = spark.createDataFrame([(v,) for v in values], "down_up_ratio DOUBLE")
    got = [r[0].split(": ")[1] for r in df.select(feature_text(df.columns)).collect()]
    assert got == [f"{v:,.0f}" if v > 1000 else f"{v:.4f}" for v in values]
    assert [r[0] for r in df.select(percent_text(F.lit(0.9235))).collect()][0] == f"{0.9235:.1%}"


def test_prompt_text(spark):
    row = spark.createDataFrame([("c2_beacon", "Simulated", 7, 0.9876, 12.0)],
                                "scenario STRING, description STRING, flow_num INT, confidence DOUBLE,"
                                " tot_fwd_pkts DOUBLE")
    text = alerts.alert_prompts(row).first()["prompt"].split("\n")
    assert text[2] == 'ATTACK CONTEXT: This flow was generated during a "Simulated" attack.'
    assert text[4] == "Flow #7 was classified as MALICIOUS with 98.8% confidence."
    assert text[6:10] == ["Key network flow features:", "  - tot_fwd_pkts: 12.0000", "", "Feature definitions:"]
    assert text[10] == "- flow_duration: total flow duration in microseconds"
    assert text[17] == "- down_up_ratio: ratio of download to upload bytes"
    assert text[20] == '1. What specific attack behavior these features reveal for a "c2_beacon" attack'
    assert text[-1] == "Be specific, technical, and reference the actual feature values."
    assert len(text) == 25


def test_explanations_and_report(spark):
    df = scored(spark, [("c2_beacon", 1, 1.0), ("c2_beacon", 2, .5), ("nmap_syn_scan", 3, .25)])
    numbered = alerts.number_alerts(alerts.top_alerts(df), alerts.scenario_dimension(spark))
    texts = spark.createDataFrame([(1, "one\ntwo"), (2, "x" * 200)], "flow_num INT, explanation STRING")
    explained = alerts.attach_explanations(numbered, texts)
    shown = {r["flow_num"]: r["preview"] for r in explained.collect()}
    assert shown == {1: "one two", 2: "x" * 120, 3: None}
    counts = {r["scenario"]: r["explained"] for r in alerts.explained_counts(explained).collect()}
    assert counts == {"nmap_syn_scan": 1, "c2_beacon": 1, "*": 2}
    text = "\n".join(r["line"] for r in alerts.explanation_report(
        explained, "forest", "analyst").orderBy("ord").collect())
    assert text.startswith("- Classifier: forest\n- LLM: analyst\n- Flows per scenario: 2\n\n---\n\n## nmap_syn_scan\n\n")
    assert "### Flow #1 -- Confidence: 25.0%\n\none\ntwo\n\n---\n\n## c2_beacon" in text
    assert text.endswith("| nmap_syn_scan | 1 |\n| c2_beacon | 1 |\n\n**Total flows explained: 2**")
    assert spark.range(1).select(preview(F.lit("a\nb"))).first()[0] == "a b"
