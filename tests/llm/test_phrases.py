"""Copied passages against a plain search, and the automata."""

import hashlib
import random

import numpy as np
import pytest

from flowlake.llm import common, phrases
from flowlake.llm.phrases import chosen_phrases, located, repeated_passages
from flowlake.llm.queries import op7_substring_dedup
from helpers_llm import clashing, given, removed, table, words


def digests(kept):
    return {d: hashlib.sha256(b" ".join(w)).hexdigest() for d, w in kept.items()}


def test_query(spark, sf_dir):
    texts = {d: r[1] for d, r in given(sf_dir).items()}
    kept = removed(texts)
    want = {d: (len(words(texts[d])), len(words(texts[d])) - len(kept[d]), h) for d, h in digests(kept).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op7_substring_dedup(spark, sf_dir).collect()} == want


@pytest.fixture(scope="module")
def mosaics():
    """Documents cut from one another, with repeats inside one and passages of 49, 50 and 51 words."""
    rng = random.Random(3)
    new = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    stock = [new(n) for n in (49, 50, 51, 60, 120, 300)] + [["la"] * 80, ["x", "y"] * 60]
    texts = {}
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(stock)
            a = rng.choice([0, 0, 5, 20])
            parts += rng.choice([new(rng.randrange(0, 30)), p[a:], p, p[:-3]])
        texts[i * 2] = " \n".join(parts)
    return texts


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_mosaics(spark, mosaics, monkeypatch, broadcast):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 5000)
    kept = removed(mosaics)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in repeated_passages(table(spark, list(mosaics.items()))).collect()}
    assert got == {d: (len(words(mosaics[d])) - len(kept[d]), h) for d, h in digests(kept).items()}


@pytest.mark.parametrize("broadcast", [1 << 20, 6])
def test_hot_phrases(spark, mosaics, monkeypatch, broadcast):
    """Runs that go by a phrase of many documents take the other way, to the same result."""
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    kept = removed(mosaics)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in repeated_passages(table(spark, list(mosaics.items()))).collect()}
    assert got == {d: (len(words(mosaics[d])) - len(kept[d]), h) for d, h in digests(kept).items()}


def test_equal_runs_are_flagged_alike():
    """A run is hot by its own phrase, whatever stands around it; a run that a text repeats comes once."""
    rng = random.Random(2)
    run = [f"r{i}".encode() for i in range(50)]
    at = int(chosen_phrases(run)[0])
    own = phrases.window_hashes(phrases.word_hashes(run[at:at + 10]), 10)
    flags = set()
    for _ in range(20):
        text = [f"{rng.randrange(99)}".encode() for _ in range(rng.randrange(40))]
        place, hashes, _, hot = phrases._runs(text + run + run + text, np.array([len(text) + at, len(text) + 50 + at]), own, 50, 10)
        flags.add(bool(hot[place.tolist().index(len(text))]))
        assert len(set(hashes.tolist())) == len(hashes)
    assert flags == {True}


def test_odd_rows(spark):
    run = " ".join(f"é{i}" for i in range(50))
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(2, run), (1, None), (3, "A " + run + " b"), (5, ""), (6, run.upper()), (7, run), (7, run), (8, run), (None, run), (None, "p " + run)]
    got = repeated_passages(clashing(table(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].n_removed == by[6].n_removed == by[5].n_removed == by[None].n_removed == 0
    assert by[1].kept_sha256 == by[5].kept_sha256 == by[7].kept_sha256 == empty
    assert (by[3].n_removed, by[3].kept_sha256) == (50, hashlib.sha256(b"A b").hexdigest())
    assert [r.n_removed for r in got if r.doc_id == 7] == [50, 50]
    assert repeated_passages(table(spark, [])).collect() == []


def test_every_run_holds_a_phrase_that_is_the_same_everywhere():
    rng = random.Random(9)
    text = [f"{rng.randrange(30)}".encode() for _ in range(400)]
    at = chosen_phrases(text)
    assert len(at) < 60
    for i in range(len(text) - 49):
        inside = [p - i for p in at if i <= p <= i + 40]
        assert inside
        alone = chosen_phrases(text[i:i + 50]).tolist()
        assert set(alone) <= set(inside)
    assert len(chosen_phrases(text[:49])) == 0


def test_automaton_finds_every_occurrence():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"aa", b"\xc3\xa9", b"b"]) for _ in range(200)] for _ in range(5)]
    wanted = [[b" ".join(t[i:i + 10]) for i in (3, 77, 120)] for t in texts]
    everything = {p for w in wanted for p in w}
    for t, got in zip(texts, located(texts, wanted)):
        assert sorted(got.tolist()) == [i for i in range(191) if b" ".join(t[i:i + 10]) in everything]
    assert [len(x) for x in located([[b"a"]], [[]])] == [0]
