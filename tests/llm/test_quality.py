"""Quality rules: counts against a plain reading, estimates against contaminated samples."""

import random
from collections import Counter

import numpy as np
import pytest

from flowlake.llm import quality as q
from flowlake.llm.queries import op6_quality_rules
from flowlake.llm.quality import chi2_quantile, consistency, fit, keep_quality, quality
from helpers_llm import clashing, given, table, words


def counts(text):
    w = words(text)
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, inside = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            inside.update(range(i, i + 5))
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            copies += line in seen
            seen.add(line)
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), copies, len(inside))


def check(rows, texts):
    for r in rows:
        n = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)


def test_query(spark, sf_dir):
    docs = given(sf_dir)
    rows = op6_quality_rules(spark, sf_dir).collect()
    check(rows, {d: r[1] for d, r in docs.items()})
    assert sorted(r.doc_id for r in rows) == sorted(docs)


def test_labelled_documents_of_quality_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op6_quality_rules(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [rows[r.doc_id].kept or rows[r.doc_id].base_failed for r in labels if r.quality == 1]
    poor = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(poor) / len(poor) < 0.5


def test_odd_rows(spark):
    rng = random.Random(1)
    plain = {i: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(60)) for i in range(100, 260)}
    texts = {1: None, 2: "", 3: "a b c", 4: "x y z\n" * 400, 5: "$%& ###* " * 30, 6: "é ü\x0b" * 20_000, 7: " \n\n \t\n", **plain}
    rows = [(d, t, *rng.choice([("en", "s"), (None, None), ("", "s"), ("en", None)])) for d, t in texts.items()]
    got = quality(clashing(table(spark, [*rows, rows[9], (None, rows[9][1], "en", "s")]))).collect()
    assert len(got) == len(rows) + 2
    check([r for r in got if r.doc_id is not None], texts)
    assert all(r.kept for r in got if r.doc_id in plain)
    assert quality(table(spark, [])).collect() == []


def test_few_documents_are_judged_by_the_rules_alone(spark):
    texts = {i: f"one two three four five six seven eight nine ten {i} $$$$ ####" for i in range(5)}
    got = quality(table(spark, list(texts.items()))).collect()
    check(got, texts)
    assert all(r.kept and r.distance == 0 for r in got)


def test_junk_in_a_source_does_not_move_its_estimate(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(120))
    good = {i: prose() for i in range(300)}
    junk = {i: prose().replace(" ", "%%% ") for i in range(1000, 1080)}
    rows = [(d, t, "en", "s0") for d, t in {**good, **junk}.items()]
    docs = clashing(table(spark, rows))
    kept = {r.doc_id for r in quality(docs).filter("kept").collect()}
    assert kept == set(good)
    stage = keep_quality(docs)
    assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.collect()} == kept


@pytest.mark.parametrize("junk", [26, 30, 40])
def test_much_junk_in_a_source_is_rejected(spark, junk):
    rng = random.Random(junk)
    prose = lambda: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(120))
    good = {i: prose() for i in range(500 - 5 * junk)}
    bad = {1000 + i: prose().replace(" ", rng.choice(["%%% ", "##$ ", "&& "])) for i in range(5 * junk)}
    got = {r.doc_id for r in quality(table(spark, [(d, t, "en", "s0") for d, t in {**good, **bad}.items()])).filter("kept").collect()}
    assert got == set(good)


def test_estimate_against_numpy(spark):
    """A fifth of the rows lie far away; centre and spread are those of the rest."""
    rng = np.random.RandomState(0)
    spread = np.array([0.4, 0.7, 0.5, 0.9])
    rest = rng.randn(4000, q.P) * spread + np.array([1.0, 2.0, 3.0, 4.0])
    away = rng.randn(800, q.P) * 0.2 + np.array([9.0, 9.0, 9.0, 9.0])
    rows = [(["g"], [float(v) for v in x]) for x in np.vstack([rest, away])]
    got = fit(spark.createDataFrame(rows, "keys array<string>, x array<double>")).collect()
    assert len(got) == 1
    assert np.allclose(got[0]["mean"], rest.mean(axis=0), atol=0.06)
    inverse = np.array(got[0]["inverse"]).reshape(q.P, q.P)
    want = np.diag(1 / (spread ** 2 + np.square(q.FLOOR)))
    assert np.allclose(np.diag(inverse), np.diag(want), rtol=0.35)


def test_small_groups_fall_back(spark):
    df = spark.createDataFrame([("en", "s"), (None, "s"), ("en", None)], "lang string, source string").select(q.keys().alias("k"))
    keys = [r.k for r in df.collect()]
    assert len({k[0] for k in keys}) == 3 and [k[1] for k in keys] == ["=en", "-", "=en"] and {k[2] for k in keys} == {""}


def test_chi_squared():
    assert chi2_quantile(0.05) == pytest.approx(9.4877, abs=1e-3)
    assert consistency(0.75) == pytest.approx(1.486, abs=5e-3)
