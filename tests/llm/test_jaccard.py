"""Near copies against all pairs, and the parts they are made of."""

import random

import numpy as np
import pytest

from flowlake.llm import jaccard
from flowlake.llm.common import mix64
from flowlake.llm.components import components
from flowlake.llm.jaccard import Tree, keep_one, prefix, similar
from flowlake.llm.queries import op2_ngram_jaccard
from helpers_llm import clashing, given, linked, shingle_set, table


def test_query_against_all_pairs(spark, sf_dir):
    texts = {d: r[1] for d, r in given(sf_dir).items()}
    want = linked(texts)
    rows = op2_ngram_jaccard(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {d: (len(shingle_set(t)), want[d]) for d, t in texts.items()}


@pytest.fixture(scope="module")
def families():
    """Chains and stars of near copies around the threshold, with passages shared by many."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = rng.choices(vocabulary, k=40)
    texts = {}
    for f in range(60):
        base = rng.choices(vocabulary, k=rng.choice([6, 12, 40, 90, 300]))
        if f % 3 == 0:
            base = base[: len(base) // 2] + common + base[len(base) // 2:]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[len(texts) * 3 + 1] = " ".join(w)
            if rng.random() < 0.5:
                base = w
    return texts


def test_families(spark, families):
    want = linked(families)
    got = {r.doc_id: r.component_id for r in similar(table(spark, list(families.items()))).collect()}
    assert got == want
    assert 1 < len(set(want.values())) < len(want)


def test_small_trees_and_frequent_tokens(spark, families, monkeypatch):
    """Tiles, tiny pages, frequent tokens and joins without broadcasts give the same classes."""
    for name, value in (("TREE", 3), ("PAGE", 2), ("FREQUENT", 2), ("TREE_BYTES", 4000)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "_few", lambda df: False)
    got = {r.doc_id: r.component_id for r in similar(table(spark, list(families.items()))).collect()}
    assert got == linked(families)


def test_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text), (3, text.upper()), (9, None), (8, ""), (7, " \n\t"), (6, "One two"), (4, "one\ntwo"), (2, "two one"),
            (None, text), (11, text), (11, text), (12, "x " * 5000)]
    got = sorted(similar(clashing(table(spark, rows))).collect(), key=str)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(rows)
    assert by == {5: (26, 3), 3: (26, 3), 11: (26, 3), 9: (0, 9), 8: (0, 8), 7: (0, 7), 6: (1, 4), 4: (1, 4), 2: (1, 2), None: (26, None), 12: (1, 12)}
    assert similar(table(spark, [])).collect() == []


def test_threshold_is_met_exactly(spark):
    """8 of 10 shingles shared is a link, one less is none."""
    base = [f"t{i}" for i in range(13)]           # 9 shingles
    longer = base + ["u"]                         # 10, 9 shared of 10
    short = base[:12]                             # 8 of 10 with the longer one
    shorter = base[:11]                           # 7 of 10 with the longer one, 7 of 8 with the short one
    texts = {1: " ".join(longer), 2: " ".join(short)}
    assert {r.component_id for r in similar(table(spark, list(texts.items()))).collect()} == {1}
    texts = {1: " ".join(longer), 2: " ".join(shorter)}
    assert {r.component_id for r in similar(table(spark, list(texts.items()))).collect()} == {1, 2}


def test_keep_one(spark, families):
    want = linked(families)
    docs = clashing(table(spark, [*families.items(), (None, "a b")]))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.filter("doc_id is null").count() == 1


def test_tree_finds_what_the_bound_allows():
    rng = np.random.RandomState(3)
    points = rng.poisson(3, (700, 16))
    points[100:200] = points[0] + (rng.rand(100, 16) < 0.05)
    size = points.sum(axis=1)
    for p in (0, 150, 300):
        tree = Tree(size, points)
        got = set(tree.order[tree.reached(int(size[p]), points[p], False)].tolist())
        overlap = np.minimum(points, points[p]).sum(axis=1)
        want = (180 * overlap >= 80 * (size + size[p])) & (100 * np.minimum(size, size[p]) >= 80 * np.maximum(size, size[p]))
        assert got == set(np.flatnonzero(want).tolist())
    found = Tree(size, points).links()
    assert len(found) <= len(points) - 1
    for i in range(1, 400):
        pair = np.array([0, i])
        assert jaccard.tree_links(size[pair], points[pair], 80) == Tree(size[pair], points[pair]).links()


def test_points_fold():
    rng = np.random.RandomState(4)
    tokens = np.unique(mix64(rng.randint(0, 10**9, 3000).astype(np.uint64)))
    wide, narrow = (jaccard.point(tokens, g).astype(np.uint8).tobytes() for g in (512, 64))
    assert jaccard.folded([wide, narrow])[0].tolist() == jaccard.point(tokens, 64).tolist()
    sizes = [jaccard.groups_for(n) for n in (1, 50, 600, 5000, 10**6)]
    assert sizes == sorted(sizes) and sizes[0] == 64 and sizes[-1] == 4096 and sizes[3] >= 5000 / 16


def test_prefixes_of_links_meet():
    rng = np.random.RandomState(5)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = np.unique(mix64(rng.randint(0, 10**9, n).astype(np.uint64)))
        b = np.unique(np.concatenate([a[rng.rand(len(a)) < 0.9], mix64(rng.randint(0, 10**9, 3).astype(np.uint64))]))
        often = np.sort(a[rng.rand(len(a)) < 0.5])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(prefix(a, often), prefix(b, often)))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (7, 8), (8, 8), (20, 19), (19, 18), (18, 17), (17, 16), (16, 15), (2, 1), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, **{i: 15 for i in range(15, 21)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    chain = [(i, i + 1) for i in range(40)]
    assert {r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def test_components_plan_one_pass_at_a_time(spark, monkeypatch):
    """A written pass joins its links once; passes planned on top of each other read the links again for each."""
    from flowlake.llm import components as module

    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return module_materialize(df, name)

    module_materialize = module.materialize
    monkeypatch.setattr(module, "materialize", written)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4), (20, 21)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 20: 20, 21: 20}
    assert len(plans) > 2 and max(p.count("Join ") for p in plans) == 1
