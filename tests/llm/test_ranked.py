"""Ranked search against scores of all documents, in whole Python numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowlake.llm import ranked
from flowlake.llm.ranked import Best, Bucket, search, slices, terms
from helpers_llm import clashing, table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, best=50):
    """[(item_id, rank, doc_id, score)], sorted; null ids last among equals."""
    held = [(d, Counter(cut(t))) for d, t in docs if cut(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=str)


def gotten(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(n, seed, vocabulary=120):
    rng = random.Random(seed)
    word = [f"{c}{i}" for i in range(vocabulary // 4) for c in ("a", "É", "ß", "Zz")]
    draw = lambda k: " ".join(word[min(int(rng.expovariate(0.05)), len(word) - 1)] for _ in range(k))
    return [(i, draw(rng.choice([1, 3, 10, 40, 200]))) for i in range(n)], draw


def test_as_plain(spark):
    docs, draw = corpus(900, 3)
    items = [(i, draw(12)) for i in range(25)] + [(90, "nowhere to_be-found"), (91, docs[7][1])]
    got = gotten(search(table(spark, docs), spark.createDataFrame(items, ITEMS)))
    assert got == plain(docs, items) and len(got) > 1000


def test_ties_and_copies(spark):
    """A third of the rows are copies: equal scores go by id, over the border of rank 50."""
    docs, draw = corpus(300, 4)
    docs = [(1000 - i, t) for i, (_, t) in enumerate(docs)] + [(i, "a0 a1 É2 the same") for i in range(150)]
    items = [(1, "a0 a1 É2"), (2, "same same SAME"), (2, "same"), (None, "É2")]
    assert gotten(search(table(spark, docs), spark.createDataFrame(items, ITEMS))) == plain(docs, items)


def test_slices_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SLICE_ITEMS", 4)
    docs, draw = corpus(200, 5)
    items = [(i, draw(8)) for i in range(10)]
    given = spark.createDataFrame(items, ITEMS)
    assert [len(s.ids) for s in slices(given)] == [4, 4, 2]
    monkeypatch.setattr(ranked, "SLICE_BYTES", 1)
    assert [len(s.ids) for s in slices(given)] == [1] * 10
    monkeypatch.setattr(ranked, "SLICE_BYTES", 1 << 20)
    assert gotten(search(table(spark, docs), given)) == plain(docs, items)


def test_odd_rows(spark):
    long = "word " * 300_000 + "rare " + "x" * 2_000_000
    docs = [(1, None), (2, ""), (3, " .,;\n\t_-"), (4, long), (4, long), (5, "Word, WORD\x00word"), (None, "word rare"), (6, "wörd WöRD"), (7, "rare" * 3), (8, "other")]
    items = [(1, "word rare"), (2, None), (3, ""), (4, "_"), (5, "wörd"), (None, "x" * 2_000_000), (6, "word " * 1000)]
    given = spark.createDataFrame(items, ITEMS)
    for name in ("item", "rank", "score", "salt", "slice", "term"):
        given = given.withColumn(name, given.text)
    got = gotten(search(clashing(table(spark, docs)), given))
    assert got == plain(docs, items)
    assert search(table(spark, []), given).collect() == []
    assert search(table(spark, docs), given.limit(0)).collect() == []
    assert search(table(spark, docs[:3]), given).collect() == []


def test_terms_in_blocks(monkeypatch):
    text = "Ab-cd éÀ  Z9_" * 50 + "long" * 40
    whole = [t.encode() for t in cut(text)]
    for size in (1, 2, 7, 64, 1 << 20):
        monkeypatch.setattr(ranked, "BLOCK", size)
        assert [t for block in terms(text) for t in block] == whole


@pytest.mark.parametrize("least", [1, 10, 1000, 40_000, 90_000, 200_000, 10 ** 9])
def test_bucket_loses_nothing(least):
    rng = np.random.default_rng(6)
    impact = np.where(rng.random((400, 60)) < 0.15, rng.integers(1, 30_000, (400, 60)), 0)
    impact[:, 3] *= 5
    row, term = np.nonzero(impact)
    bucket = Bucket(np.sqrt((impact.astype(float) ** 2).sum(axis=1)), term, row, impact[row, term])
    for _ in range(40):
        item = np.sort(rng.choice(70, rng.integers(1, 20), replace=False))
        want = impact[:, item[item < 60]].sum(axis=1)
        at, score = bucket.search(item, least)
        order = np.argsort(at)
        assert at[order].tolist() == np.flatnonzero(want >= least).tolist() and score[order].tolist() == want[want >= least].tolist()


def test_best_keeps_equal_scores_with_smaller_ids():
    best = Best(0, 3)
    best.add(np.array([5, 5, 7, 5]), np.array([9, 8, 7, 6]), np.zeros(4, bool))
    assert best.least == 5 and sorted(best.ids.tolist()) == [6, 7, 8]
    best.add(np.array([5, 5]), np.array([0, 1]), np.array([True, False]))
    assert sorted(best.ids.tolist()) == [1, 6, 7]
