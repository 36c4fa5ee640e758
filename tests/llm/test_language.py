"""Language: held-out accuracy, families, and odd rows."""

import random
import zlib

import numpy as np

from flowlake.llm.language import CLOSE, FAMILY, Model, families, features, languages, learn, sample
from flowlake.llm.queries import op9_language
from helpers_llm import clashing, given, table

SF = "/root/testdata/sf0.01"


def test_query_held_out(spark):
    docs = given(SF)
    rows = op9_language(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id][2] for r in held) / len(held) > 0.98


def corpus(n=600):
    rng = random.Random(4)
    stock = {"aa": ["ka", "lo", "mi", "tu"], "ab": ["ka", "lo", "mi", "to"], "zz": ["strk", "pfl", "schw", "grn"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(stock))
        out.append((i, " ".join("".join(rng.choices(stock[lang], k=3)) for _ in range(30)), lang))
    return out


def test_close_languages_are_one_family(spark):
    rows = corpus()
    model = learn(table(spark, rows))
    family = dict(zip(model.names, model.family))
    assert family["aa"] == family["ab"] != family["zz"]
    got = {r.doc_id: r for r in languages(table(spark, rows)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[d].lang_pred == g for d, _, g in held) / len(held) > 0.97


def test_prediction_sees_the_text_alone(spark):
    rows = corpus(300)
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages(table(spark, rows)).collect()}
    model = learn(table(spark, rows))
    for d, text, _ in rows[:50]:
        lang, score = model.predict([text])
        assert lang[0] == got[d][0] and abs(score[0] - got[d][1]) < 1e-4
    # Labels of held-out rows change nothing.
    odd = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else g) for d, t, g in rows]
    assert {r.doc_id: (r.lang_pred, r.score) for r in languages(table(spark, odd)).collect()} == got


def test_odd_rows(spark):
    rows = corpus(200) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", None), (1003, "👍 — …", "zz"), (None, "kaloka mituka", "aa"),
                          (1004, "kalomi " * 40_000, None), (5, "kalolo", "aa"), (5, "kalolo", "aa"), (1005, "strkpfl", None)]
    got = languages(clashing(table(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in range(1000, 1004))
    assert by[1004].lang_pred in ("aa", "ab") and by[1005].lang_pred == "zz" and not by[None].held_out
    assert languages(table(spark, [])).collect() == []
    unlabelled = languages(table(spark, [(1, "abc", None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
    single = languages(table(spark, [(i, "kalo mi", "aa") for i in range(8)])).collect()
    assert {r.lang_pred for r in single} == {"aa"}


def test_sample_is_bounded(spark):
    assert 20 < sample(table(spark, corpus()), per_language=20).count() < 120
    # One document repeated over and over is one row of it.
    assert sample(table(spark, [(5, "kalo mi", "aa")] * 3000)).count() <= 1


def test_no_families():
    x = features(["abc", "abd"])
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-3)
    assert Model([], [], []).predict(["abc", None]) == (["und", "und"], [0.0, 0.0])
    assert families(np.zeros((0, 4))) == [] and families(np.ones((1, 4))) == [0]


def plain_families(means):
    """Families by a plain loop over all pairs of groups."""
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    groups = [[i] for i in range(len(unit))]
    while True:
        near = [(float(np.mean([unit[i] @ unit[j] for i in a for j in b])), -k, -m)
                for k, a in enumerate(groups) for m, b in enumerate(groups) if k < m and len(a) + len(b) <= FAMILY]
        if not near or max(near)[0] < CLOSE:
            return groups
        _, k, m = max(near)
        groups[-k] = groups[-k] + groups.pop(-m)


def test_families_by_a_plain_loop():
    rng = np.random.RandomState(3)
    for spread in (0.2, 1.0, 2.0):
        means = np.abs(np.repeat(rng.randn(4, 12), 9, axis=0) * 2 + spread * rng.randn(36, 12))
        got = families(means)
        assert sorted(sorted(i for i in range(36) if got[i] == f) for f in set(got)) == sorted(sorted(g) for g in plain_families(means))
        assert sorted(set(got)) == list(range(len(set(got)))) and max(np.bincount(got)) <= FAMILY


def plain_decision(model, x):
    """Language and narrowest decision of one vector, machine by machine."""
    margin = lambda w: float(x @ w[:-1] + w[-1])
    narrow, f = [], 0
    if len(model.members) > 1:
        apart = [margin(model.apart[:, k]) for k in range(model.apart.shape[1])]
        f = apart.index(max(apart))
        narrow.append(sorted(apart)[-1] - sorted(apart)[-2])
    votes, part = {i: 0.0 for i in model.members[f]}, {}
    for (a, b), w in zip(model.pairs[f], model.within[f].T):
        a, b, m = model.members[f][a], model.members[f][b], margin(w)
        votes[a] += (m >= 0) + 1e-3 * np.tanh(m)
        votes[b] += (m < 0) - 1e-3 * np.tanh(m)
        part[a, b] = abs(m)
    best = max(votes, key=votes.get)
    return best, min(narrow + [v for pair, v in part.items() if best in pair])


def test_250_languages(spark):
    """Every language is learned: 50 groups of five that share three of four syllables."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllable = lambda: "".join(rng.choices(letters, k=3))
    stock = {}
    for g in range(50):
        common = [syllable() for _ in range(3)]
        stock.update({f"g{g:02}{v}": [*common, syllable()] for v in "abcde"})
    rows = [(len(stock) * k + i, " ".join("".join(rng.choices(stock[lang], k=3)) for _ in range(60)), lang)
            for k in range(12) for i, lang in enumerate(sorted(stock))]
    docs = table(spark, rows)
    model = learn(docs, per_language=6)
    assert model.names == sorted(stock) and len(model.members) < 150
    assert sum(len(p) for p in model.pairs) == sum(len(m) * (len(m) - 1) // 2 for m in model.members) > 100
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    lang, score = model.predict([t for _, t, _ in held])
    right = [g == r[2] for g, r in zip(lang, held)]
    assert sum(right) / len(held) > 0.95 and len(set(lang)) > 200
    for (_, text, _), g, s in list(zip(held, lang, score))[:60]:
        best, narrow = plain_decision(model, features([text])[0])
        assert g == model.names[best] and abs(s - 1 / (1 + np.exp(-8 * narrow))) < 1e-4
