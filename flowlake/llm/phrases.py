"""Substring dedup with repeated-phrase automata (operator 7).

A passage of ``SPAN`` words is a copy if the same words also start in a document with a smaller
doc_id. Looking at every run of 50 words of every document would shuffle them all, so:

1. Every document gives phrases: of the runs of 10 words inside each 50, the one with the
   smallest hash. Equal passages of 50 words give the same phrase, and about 5 words in a hundred
   begin one.
2. A phrase is *confirmed* when two documents have it, compared as text.
3. Documents get their confirmed phrases. Each Arrow batch is a shard: its phrases are compiled to
   one Aho-Corasick automaton, its documents are streamed through, and every occurrence is located.
4. Only the different runs of 50 words around an occurrence are then compared, by 96 bits of hash,
   with the smallest doc_id of each found by a window over equal hashes.
5. Words under a run whose first document is another are removed.

A run is in as many documents as its own phrase at most. So where a phrase is hot, the runs that go
by it do not meet in one task: their smallest doc_id comes from partial minima and is joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from flowlake.llm.common import BROADCAST_ROWS, bound_batches, hot_from, join_counted, pieces, window_hashes
from flowlake.scratch import materialize

SPAN = 50
PHRASE = 10
SHARD_BYTES = 2 << 20         # text that is streamed through one automaton


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum, by doubling."""
    n = len(h) - width + 1
    low, size = h, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[width - size:width - size + n])


def chosen_phrases(words: list[bytes], span: int = SPAN, k: int = PHRASE) -> np.ndarray:
    """Where the phrases of a text begin: the last smallest hash within each run of ``span`` words."""
    h = window_hashes(word_hashes(words), k)
    width = span - k + 1
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = _smallest(h, width)
    # Every place whose hash is the smallest of some run around it; equal hashes all count.
    # The largest minimum among the runs that hold a place is its own hash where it is chosen.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    high, size = padded, 1
    while 2 * size <= width:
        high = np.maximum(high[:-size], high[size:])
        size *= 2
    reach = np.maximum(high[:len(h)], high[width - size:width - size + len(h)])
    return np.flatnonzero(reach == h)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _phrases(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                cut = [(t or "").encode().split() for t in part.column("text").to_pylist()]
                phrases = [list({b" ".join(w[i:i + k]) for i in chosen_phrases(w, span, k).tolist()}) if len(w) >= span else [] for w in cut]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array([len(w) for w in cut], pa.int64()),
                     pa.array([_digest(w) for w in cut], pa.string()), pa.array(phrases, pa.list_(pa.binary()))],
                    ["doc_id", "text_key", "n_words", "whole", "phrases"])
    return run


def located(texts: list[list[bytes]], phrases: list[list[bytes]], k: int = PHRASE) -> list[np.ndarray]:
    """Words at which a phrase of the shard begins, for each text, by one automaton."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in set().union(*phrases):
        automaton.add_word(f" {p.decode()} ")
    if not len(automaton):
        return [np.empty(0, np.int64) for _ in texts]
    automaton.make_automaton()
    out = []
    for words in texts:
        text = f" {b' '.join(words).decode()} "
        # The blank after a phrase is the blank before the next word: words are counted by blanks.
        ends = np.array([e for e, _ in automaton.iter(text)], np.int64)
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        out.append(np.searchsorted(blanks, ends) - k)
    return out


RUNS = "doc_id long, text_key long, place int, hash long, more int, hot boolean"


def _runs(words: list[bytes], at: np.ndarray, hot: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """place, hash, more, hot of the different runs that hold a phrase beginning at one of ``at``, each where it comes first."""
    n, h = len(words) - span + 1, word_hashes(words)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(at - (span - k), 0), 1)
    np.add.at(step, np.minimum(at + 1, n), -1)
    near = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    whole = window_hashes(h, span)
    near = near[np.unique(whole[near], return_index=True)[1]]
    more = (window_hashes(h, span, 1)[near] >> np.uint64(33)).astype(np.int32)
    own = _smallest(window_hashes(h, k), span - k + 1)[near]
    return near.astype(np.int32), whole[near].view(np.int64), more, np.isin(own, hot)


def _windows(span: int, k: int):
    def shard(rows: pa.RecordBatch) -> pa.RecordBatch:
        cut = [t.encode().split() for t in rows.column("text").to_pylist()]
        found = located(cut, rows.column("phrases").to_pylist(), k)
        hot = {p for ps in rows.column("hot").to_pylist() for p in ps}
        hot = np.array([window_hashes(word_hashes(p.split()), k)[0] for p in hot], np.uint64)
        parts = []
        for d, key, words, at in zip(rows.column("doc_id").to_pylist(), rows.column("text_key").to_pylist(), cut, found):
            if len(words) >= span and len(at):
                run = _runs(words, at, hot, span, k)
                parts.append((np.full(len(run[0]), d), np.full(len(run[0]), key), *run))
        types = (np.int64, np.int64, np.int32, np.int64, np.int32, bool)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, t), *[p[i] for p in parts]]).astype(t)) for i, t in enumerate(types)],
                                          ["doc_id", "text_key", "place", "hash", "more", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, SHARD_BYTES):
                yield shard(part)
    return run


def _kept(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                removed, digests = [], []
                for t, places in zip(part.column("text").to_pylist(), part.column("places")):
                    words = t.encode().split()
                    # All places of the runs, of which each came with the first.
                    runs = window_hashes(word_hashes(words), span)
                    at = np.flatnonzero(np.isin(runs, runs[np.asarray(places.values, np.int64)]))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + span, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed.append(int(gone.sum()))
                    digests.append(_digest([w for w, g in zip(words, gone.tolist()) if not g]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                                 ["doc_id", "text_key", "n_removed", "kept_sha256"])
    return run


def _holding(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``texts`` with their columns of ``keys`` (one row a key, written). Texts without a key
    are left out before the shuffle where the keys are few enough to be broadcast."""
    on = ["doc_id", "text_key"]
    if keys.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(keys.select(on)), on, "left_semi")
    return texts.join(keys, on)


def repeated_passages(docs: DataFrame, span: int = SPAN, k: int = PHRASE) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A word goes if it stands in a run of ``span`` words that also starts in a document with a
    smaller doc_id, judged on the input. Kept words are joined by one blank for the digest. A null
    text has no words. A document of null doc_id keeps all and removes nothing elsewhere. Rows that
    share a doc_id remove nothing from each other. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "text_key", F.xxhash64(F.col("text")))
    each = materialize(texts.mapInArrow(_phrases(span, k), "doc_id long, text_key long, n_words long, whole string, phrases array<binary>"), "phrases")

    # Confirm: a phrase of two documents at least.
    own = each.filter("doc_id is not null").select("doc_id", "text_key", F.explode("phrases").alias("phrase"))
    same = materialize(own.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
                       .filter(F.col("first") < F.col("last")).select("phrase", "n"), "phrases-same")
    limit = hot_from(same.agg(F.sum("n")).first()[0] or 0)
    confirmed = (join_counted(own, same, ["phrase"], limit).groupBy("doc_id", "text_key")
                 .agg(F.collect_set("phrase").alias("phrases"), F.collect_set(F.when(F.col("n") > limit, F.col("phrase"))).alias("hot")))
    confirmed = materialize(confirmed, "phrases-confirmed")

    # Locate in texts that hold one, and compare the runs of words around.
    runs = materialize(_holding(texts.filter("doc_id is not null"), confirmed).select("doc_id", "text_key", "text", "phrases", "hot").mapInArrow(
        _windows(span, k), RUNS), "phrase-runs")
    hot, run = runs.filter("hot").drop("hot"), ["hash", "more"]
    firsts = materialize(hot.groupBy(*run).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
                         .filter(F.col("first") < F.col("last")).drop("last"), "phrase-firsts")
    both = (runs.filter("not hot").drop("hot").withColumn("first", F.min("doc_id").over(Window.partitionBy(*run)))
            .unionByName(join_counted(hot, firsts, run, hot_from(firsts.agg(F.sum("n")).first()[0] or 0)).drop("n")))
    copies = both.filter(F.col("first") < F.col("doc_id")).groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))
    copies = materialize(copies, "phrase-copies")

    # Remove.
    kept = _holding(texts.filter("doc_id is not null"), copies).select("doc_id", "text_key", "text", "places").mapInArrow(
        _kept(span), "doc_id long, text_key long, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "text_key"])
    return each.select("doc_id", "text_key", "n_words", "whole").join(kept, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
