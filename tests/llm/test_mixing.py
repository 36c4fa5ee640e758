"""Mixing: targets against plain sharing, totals near targets, and rounding that keeps words."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlake.llm.mixing import mix, settle, take
from flowlake.llm.queries import op1_source_mixing
from helpers_llm import clashing, given, table, words


def shared(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Targets by sharing the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    total = share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0.0
        target = {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        above = {s for s in rest if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def check(rows, texts):
    sizes, taken, source = defaultdict(int), defaultdict(int), {}
    for r, (d, t, s) in zip(rows, texts):
        assert r.size == len(words(t)) and r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        sizes[s] += r.size
        taken[s] += r.taken
        source[s] = r
    for s, want in shared(sizes).items():
        assert source[s].source_size == sizes[s]
        assert source[s].target == pytest.approx(want, rel=1e-9, abs=1e-9)
        largest = max(len(words(t)) for _, t, o in texts if o == s)
        assert abs(taken[s] - want) <= largest / 2 + 1e-6


def test_query(spark, sf_dir):
    docs = given(sf_dir)
    rows = sorted(op1_source_mixing(spark, sf_dir).collect())
    check(rows, [(d, docs[d][1], docs[d][3]) for d in sorted(docs)])
    assert sorted(op1_source_mixing(spark, sf_dir).collect()) == rows


def test_many_buckets_and_a_hot_source(spark):
    rng = np.random.RandomState(4)
    rows = [(i, " ".join(["w"] * int(rng.pareto(1.5) * 10 + 1)), None, "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    got = sorted(mix(table(spark, rows), bucket=5).collect())
    check(got, [(d, t, s) for d, t, _, s in rows])


def test_odd_rows(spark):
    rows = [(1, "a b c", None, None), (2, None, None, "é"), (3, "", None, "z"), (4, " \n", None, "Z"), (None, "x y", None, "z"),
            (5, "k " * 5000, None, "Z"), (6, "a", None, ""), (7, "a b", None, "z"), (7, "a b", None, "z")]
    got = mix(clashing(table(spark, rows))).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    sizes = {"": 1, "Z": 5000, "z": 6, "é": 0, None: 3}
    want = shared(sizes)
    for d, s in ((1, None), (2, "é"), (3, "z"), (5, "Z"), (6, "")):
        assert by[d][0].target == pytest.approx(want[s])
    assert by[2][0].taken == by[3][0].taken == by[4][0].taken == 0
    assert mix(table(spark, [])).collect() == []
    nothing = mix(table(spark, [(1, "", None, "a"), (2, None, None, "b")])).collect()
    assert {(r.size, r.target, r.taken) for r in nothing} == {(0, 0.0, 0)}


def test_take_repeats_documents(spark):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), "en", f"s{i % 4}") for i in range(120)]
    rows += [(3, "other text", "en", "s1"), (3, "other text", "en", "s1"), (None, "no id here", None, "s2"), (200, None, None, "s2")]
    docs = clashing(table(spark, rows))
    got = take(docs, bucket=16)
    assert got.columns == docs.columns
    have, want = Counter(), Counter()
    for r in got.collect():
        have[r.doc_id, len(words(r.text))] += 1
        assert (r.doc_id, r.text) in {(d, t) for d, t, _, _ in rows}
    for r in mix(docs, bucket=16).collect():
        want[r.doc_id, r.size] += r.copies
    assert have == +want


def test_rounding_keeps_words_and_chances():
    rng = np.random.RandomState(1)
    size = np.array([50, 20, 20, 7, 3, 1])
    part = np.array([0.3, 0.5, 0.9, 0.25, 0.6, 0.5])
    times = np.zeros(len(size))
    for _ in range(4000):
        out, held = settle(size, part, rng.rand(len(size)))
        assert (out * size).sum() == pytest.approx((part * size).sum())
        assert all(v in (0.0, 1.0) for i, v in enumerate(out) if i != held)
        times += out
    assert np.allclose(times / 4000, part, atol=0.04)
