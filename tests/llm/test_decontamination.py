"""Benchmark passages: planted ones with edits, and the alignment against a plain one."""

import random
import time

import numpy as np
import pytest

from flowlake.llm import decontamination as d
from flowlake.llm.decontamination import Benchmark, align, grams, passages, points, without_passages
from flowlake.llm.queries import op3_decontamination
from helpers_llm import clashing, given, table


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_query_finds_every_whole_item(spark, sf_dir):
    docs = given(sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    rows = op3_decontamination(spark, sf_dir).collect()
    want = {(i, b.item_id) for i, r in docs.items() for b in bench if r[1] and b.text in r[1]}
    assert {(r.doc_id, r.item_id) for r in rows if r.edits == 0} == want
    text = {b.item_id: b.text for b in bench}
    for r in rows:
        if r.edits == 0:
            assert docs[r.doc_id][1][r.start:r.stop].split() == text[r.item_id].split()


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(2, 8))) for _ in range(n))


def edited(rng, text, k):
    c = list(text)
    for _ in range(k):
        at = rng.randrange(len(c))
        what = rng.randrange(3)
        c[at:at + (what != 1)] = [] if what == 0 else [rng.choice("uvwxyz")]
    return "".join(c)


def test_planted_edits(spark):
    rng = random.Random(5)
    bench = [(i, prose(rng, rng.randrange(15, 60))) for i in range(40)]
    docs, want = [], set()
    for i in range(200):
        item, text = rng.choice(bench)
        most = int(len(text) * d.EDITS)
        k = rng.choice([0, 1, most // 2, most, 4 * most + 20])
        part = edited(rng, text, k)
        if rng.random() < 0.3:
            part = part.upper().replace(" ", "\n")
        docs.append((i, f"{prose(rng, rng.randrange(0, 80))} {part} {prose(rng, rng.randrange(0, 80))}"))
        if k <= most:
            want.add((i, item))
    got = passages(table(spark, docs), items(spark, bench)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert want <= found
    # What was edited more may by chance be near enough; a plain alignment tells.
    text, by = dict(bench), dict(docs)
    for r in got:
        assert r.edits <= int(len(text[r.item_id]) * d.EDITS)
        assert distance(points(text[r.item_id]), points(by[r.doc_id])[r.start:r.stop]) == r.edits
    kept = {r.doc_id for r in without_passages(table(spark, docs), items(spark, bench)).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.tolist(), 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b.tolist(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best(item, text):
    """Edits of the best part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item.tolist(), 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text.tolist(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_alignment():
    rng = random.Random(8)
    for _ in range(200):
        item = "".join(rng.choices("abc", k=rng.randrange(5, 30)))
        before = "".join(rng.choices("abc", k=rng.randrange(0, 10)))
        text = before + edited(rng, item, rng.randrange(0, 6)) + "".join(rng.choices("abc", k=rng.randrange(0, 10)))
        a, b = points(item), points(text)
        got = align(a, b, -8, len(b), 6)
        want = best(a, b)
        if want <= 6:
            assert got and got[2] == want
            assert distance(a, b[got[0]:got[1]]) == want
        else:
            assert got is None


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from the old grey house"
    bench = items(spark, [(1, item), (2, item), (3, None), (4, ""), (5, "short"), (6, "long " * 300)])
    rows = [(1, None), (2, ""), (3, item), (4, f"é {item.upper()} x {item}"), (5, "short"), (6, "nothing here " * 20_000), (None, item), (3, item)]
    docs = clashing(table(spark, rows))
    got = passages(docs, bench).collect()
    assert sorted((r.item_id, r.start) for r in got if r.doc_id == 4) == [(i, s) for i in (1, 2) for s in (2, 5 + len(item))]
    assert sorted(r.item_id for r in got if r.doc_id == 3) == [1, 1, 2, 2]
    assert {r.doc_id for r in got if r.item_id != 5} == {3, 4, None}
    assert [(r.start, r.stop, r.edits) for r in got if r.doc_id == 5] == [(0, 5, 0)]
    clean = without_passages(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 5, 6]
    assert passages(table(spark, []), bench).collect() == []
    nothing = items(spark, [])
    assert passages(docs, nothing).collect() == []
    assert without_passages(docs, nothing).count() == len(rows)


def test_parts_of_items(spark):
    """Cut off at the end or the start, and a long passage out of the middle, with few edits or none."""
    rng = random.Random(9)
    item, short = prose(rng, 400), prose(rng, 25)
    around = lambda text: f"{prose(rng, 30)} {text} {prose(rng, 30)}"
    parts = {1: item[:int(len(item) * 0.9)], 2: item[300:], 3: item[500:900], 4: short[:int(len(short) * 0.9)], 5: item[777:840]}
    docs = {i: around(p) for i, p in parts.items()}
    docs[6] = around(edited(rng, item[400:1000], 12))
    docs[7] = around(item[100:130])
    docs[8] = around(item[100:400] + " " + prose(rng, 20) + " " + item[700:1000])
    got = passages(table(spark, list(docs.items())), items(spark, [(1, item), (2, short)])).collect()
    for i, p in parts.items():
        spans = [(r.item_id, r.start, r.stop, r.edits) for r in got if r.doc_id == i]
        assert len(spans) == 1 and spans[0][0] == (2 if i == 4 else 1), (i, spans)
        begin = docs[i].index(p)
        assert abs(spans[0][1] - begin) < 20 and abs(spans[0][2] - begin - len(p)) < 20, (i, spans, begin, len(p))
    assert {r.item_id for r in got if r.doc_id == 6} == {1}
    assert not [r for r in got if r.doc_id == 7]
    assert len([r for r in got if r.doc_id == 8]) == 2
    clean = without_passages(table(spark, list(docs.items())), items(spark, [(1, item), (2, short)])).collect()
    assert [r.doc_id for r in clean] == [7]


def test_slices_of_the_benchmark_find_the_same(spark, sf_dir, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    once = sorted(passages(docs, bench).collect())
    monkeypatch.setattr(d._slices, "__defaults__", (3000,))
    assert len(d._slices(bench)) > 1
    assert sorted(passages(docs, bench).collect()) == once


@pytest.mark.parametrize("q", [1, 2, 3, 7, 12, 16])
def test_grams(q):
    c = points("abcabcabc abcabcabc abcabc")
    h = grams(c, q)
    parts = [tuple(c[i:i + q]) for i in range(len(c) - q + 1)]
    assert len(h) == len(parts) and len(set(h.tolist())) == len(set(parts))
    assert [h[i] == h[0] for i in range(len(h))] == [p == parts[0] for p in parts]


def test_bound_of_the_count():
    bench = Benchmark.of([(1, "x" * 12), (2, "abcdefghij" * 20), (3, "tiny")])
    assert bench.ids == [1, 2] and bench.edits.tolist() == [0, 10] and (bench.least >= 1).all()
    assert bench.search(np.empty(0, np.uint32)) == []


def test_repeated_characters_take_linear_time():
    """Rules and tables in items, against texts of a million such characters."""
    rng = random.Random(4)
    rule, cells = "-" * 100, "| yes | no " * 30
    rows = [(1, f"{prose(rng, 40)} {rule} {prose(rng, 40)}"), (2, cells), (3, rule), (4, f"{prose(rng, 20)} {'=' * 12} {prose(rng, 20)}")]
    bench = Benchmark.of(rows)
    for text in ("-" * 1_000_000, "=" * 1_000_000, "| yes | no " * 90_000):
        begin = time.monotonic()
        got = bench.search(points(text))
        assert time.monotonic() - begin < 20
        assert {bench.name(i) for i, *_ in got} == ({3} if "-" in text else {2} if "|" in text else set())
    # A rule is no part of an item, an item with one is found.
    assert bench.search(points("see " + "-" * 80 + " there")) == []
    for i in (1, 4):
        assert [(bench.name(k), b - a) for k, a, b, e in bench.search(points("x " + dict(rows)[i] + " y")) if e == 0][0] == (i, len(dict(rows)[i]))


def test_short_items():
    bench = Benchmark.of([(1, "Tiny one"), (2, "é"), (3, "(a)"), (4, " \n"), (5, "")])
    text = "tiny one, tiny ones; É é (a)b"
    got = sorted((bench.name(i), text[a:b], e) for i, a, b, e in bench.search(points(text)))
    assert got == [(1, "tiny one", 0), (2, "é", 0), (3, "(a)", 0)]
    assert bench.search(points(text), short=False) == []


def test_windows_against_a_plain_search():
    """Every window with enough telling q-grams that stands in the text within the edits is covered by a passage."""
    rng = random.Random(12)
    stock = [prose(rng, 12) for _ in range(4)] + ["-" * 30, "ab" * 15, "yes no " * 8]
    for _ in range(25):
        item = " ".join(rng.choice(stock) for _ in range(rng.randrange(1, 5)))
        text = " ".join([prose(rng, 5), edited(rng, item[rng.randrange(20):], rng.randrange(3)), rng.choice(stock), prose(rng, 5)])
        a, b = points(item), points(text)
        bench = Benchmark.of([(1, item)])
        got = bench.search(b)
        tell = d.telling(a, grams(a))
        for s in range(0, len(a) - d.WINDOW + 1, d.STEP):
            if tell[s:s + d.WINDOW - d.Q + 1].sum() > bench.part_edits * d.Q and best(a[s:s + d.WINDOW], b) <= bench.part_edits:
                assert got, (item, text, s)
        for _, x, y, e in got:
            assert e > 0 or text[x:y].lower() in item.lower()


def test_parts_of_an_item_that_repeats_itself():
    """One passage of an item in twenty texts after each other: all places are found."""
    rng = random.Random(13)
    verse, refrain = [prose(rng, 14) for _ in range(20)], prose(rng, 14)
    item = " ".join(f"{v} {refrain}" for v in verse)
    text = " ".join(f"{prose(rng, 3)} {refrain}" for _ in range(20))
    got = Benchmark.of([(1, item)]).search(points(text))
    covered = np.zeros(len(text), bool)
    for _, a, b, _ in got:
        covered[a:b] = True
    begins = [i for i in range(len(text)) if text.startswith(refrain, i)]
    assert len(begins) == 20 and all(covered[i + 10:i + len(refrain) - 10].all() for i in begins)
