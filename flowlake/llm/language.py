"""Language of each document: families first, then pairs of languages within one (operator 9).

Texts become vectors of hashed character pairs and triples. Languages whose mean vectors lie close
together are joined to families. One linear support vector machine per family tells it from the rest;
within a family one machine per pair of languages votes. Machines are fitted on a bounded sample
of labelled documents, a family a task; every document is predicted, from its whole text alone.
Every language is learned, however many there are: the driver gets one mean vector a language and
the machines, at most one a family and (FAMILY - 1) / 2 a language, and no document of the sample
but the ``REST`` ones that stand for the other families.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import BROADCAST_ROWS, bound_batches, pieces
from flowlake.scratch import materialize

BITS = 12
DIM = 2 << BITS               # pairs and triples, each hashed to 4096 places
PER_LANGUAGE = 400            # documents of a language in the sample, about
REST = 4000                   # documents, about, that stand for all other families beside a family's own
CLOSE = 0.45                  # mean cosine of mean vectors from which families are joined
FAMILY = 16                   # languages of a family at most; further close ones are families beside it
EPOCHS = 30
LAMBDA = 1e-4
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def features(texts: list[str]) -> np.ndarray:
    """A row a text: square roots of hashed n-gram shares, of unit length."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(f" {t} ".encode().lower(), np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
        out[i, :1 << BITS] = np.bincount((two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS), minlength=1 << BITS)
        out[i, 1 << BITS:] = np.bincount((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS), minlength=1 << BITS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights and bias of a linear machine with hinge loss (averaged subgradient steps).

    Classes weigh the same, however many rows each has.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w, mean, step = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    random = np.random.RandomState(seed)
    for epoch in range(EPOCHS):
        for rows in np.array_split(random.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            batch = x[rows].astype(np.float64)
            wrong = y[rows] * (batch @ w[:-1] + w[-1]) < 1
            rate = 1 / (LAMBDA * (step + 100))
            w *= 1 - rate * LAMBDA
            if wrong.any():
                push = (share[rows] * y[rows])[wrong]
                w[:-1] += rate * (push @ batch[wrong]) / len(rows)
                w[-1] += rate * push.sum() / len(rows)
            size = np.sqrt(LAMBDA) * np.linalg.norm(w)
            w /= max(size, 1.0)
            if epoch >= EPOCHS // 2:
                mean += w
    return (mean / max(np.linalg.norm(mean), 1e-12)).astype(np.float32)


def families(means: np.ndarray) -> list[int]:
    """Number of each language's family, from the languages' mean vectors in order of their names.

    The two closest families by the mean cosine between their languages are joined, as long as it is
    ``CLOSE`` or more and they have ``FAMILY`` languages at most. Ties go to the first by name.
    """
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    total, size = (unit @ unit.T).astype(np.float64), np.ones(len(unit))
    of = np.arange(len(unit))
    while len(unit) > 1:
        near = np.where(size[:, None] + size <= FAMILY, total / np.outer(size, size), -np.inf)
        near[np.tril_indices(len(size))] = -np.inf
        a, b = np.unravel_index(near.argmax(), near.shape)
        if near[a, b] < CLOSE:
            break
        total[a] += total[b]
        total[:, a] += total[:, b]
        size[a] += size[b]
        total, size = np.delete(np.delete(total, b, 0), b, 1), np.delete(size, b)
        of = np.where(of == b, a, of - (of > b))
    return of.tolist()


class Model:
    """Names of languages, the family of each, one machine a family, and those of each family's pairs.

    ``machines`` has a row for each: (family, a, b, weights), with a = b = -1 for the family's own.
    """

    def __init__(self, names: list[str], family: list[int], machines: list[tuple[int, int, int, np.ndarray]]):
        self.names, self.family = names, family
        stack = lambda ws: np.stack(ws, axis=1) if ws else np.zeros((DIM + 1, 0), np.float32)
        machines = sorted(machines, key=lambda m: m[:3])
        self.apart = stack([w for _, a, _, w in machines if a < 0])
        self.members, self.pairs, self.within = [], [], []
        for f in range(max(family, default=-1) + 1):
            members = [i for i, g in enumerate(family) if g == f]
            own = [(members.index(a), members.index(b), w) for g, a, b, w in machines if g == f and a >= 0]
            self.members.append(np.array(members))
            self.pairs.append(np.array([(a, b) for a, b, _ in own], np.int64).reshape(-1, 2))
            self.within.append(stack([w for _, _, w in own]))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and narrowest decision of each vector: its family first, then that family's pairs alone."""
        chosen, sure = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        if len(self.members) > 1:
            margins = x @ self.apart[:-1] + self.apart[-1]
            ranked = np.sort(margins, axis=1)
            chosen, sure = margins.argmax(axis=1), (ranked[:, -1] - ranked[:, -2]).astype(np.float64)
        lang = np.zeros(len(x), np.int64)
        for f in np.unique(chosen):
            rows, members, pairs = np.flatnonzero(chosen == f), self.members[f], self.pairs[f]
            margins = x[rows] @ self.within[f][:-1] + self.within[f][-1]
            sides = np.stack([pairs == i for i in range(len(members))])
            first, second = sides[:, :, 0].T, sides[:, :, 1].T
            lean = 1e-3 * np.tanh(margins)
            votes = ((margins >= 0) + lean) @ first + ((margins < 0) - lean) @ second
            best = votes.argmax(axis=1)
            lang[rows] = members[best]
            own = np.where((first | second)[:, best].T, np.abs(margins), np.inf)
            sure[rows] = np.minimum(sure[rows], own.min(axis=1, initial=np.inf))
        return lang, sure

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores from 0 to 1: a logistic measure of the narrowest decision."""
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for a in range(0, len(known) if self.names else 0, 256):
            part = known[a:a + 256]
            best, narrow = self.decide(features([texts[i] for i in part]))
            for i, at, sure in zip(part, best, narrow):
                lang[i] = self.names[at]
                score[i] = float(1 / (1 + np.exp(-8 * sure)))
        return lang, score


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 2 by 4. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share(seed: int, share: Column | float) -> Column:
    """Whether a row is among this share of rows, by a hash of its doc_id."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) < F.lit(1 << 52) * share


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang, x): vectors of about ``per_language`` labelled documents of each language, written.

    Documents that are held out, or without a letter, are never among them. Repeated rows count once,
    so the bound holds for a doc_id that fills the table, too.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = materialize(own.groupBy("lang").agg(F.count("*").alias("lang_rows")), "language-sizes")
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    chosen = own.join(few, "lang").filter(_share(97, F.least(F.lit(1.0), per_language / F.col("lang_rows"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, g, t) for d, g, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))) if LETTER.search(t)]
            x = features([t for _, _, t in rows]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "lang", "x"])

    vectors = chosen.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, x binary")
    return materialize(vectors.distinct(), "language-sample")


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.frombuffer(bytes(v), np.float16) for v in vectors]) if len(vectors) else np.zeros((0, DIM), np.float16)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, rest: int = REST) -> Model:
    """Fit on ``sample(docs, per_language)``: a mean a language, then the machines of each family in a task.

    A task holds the sample of a family's languages (``FAMILY`` at most) and ``rest`` documents, about,
    taken evenly from all languages. The order of rows changes nothing.
    """
    spark = docs.sparkSession
    vectors = sample(docs, per_language)

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows.sort_values(["doc_id", "x"])["x"]).astype(np.float32).mean(axis=0)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "x": [x.tobytes()]})

    means = sorted(vectors.groupBy("lang").applyInPandas(mean, "lang string, x binary").collect())
    names = [r.lang for r in means]
    if not names:
        return Model([], [], [])
    family = families(np.stack([np.frombuffer(bytes(r.x), np.float32) for r in means]))
    number = {g: i for i, g in enumerate(names)}
    others = sorted(vectors.filter(_share(98, min(1.0, rest / (len(names) * per_language)))).collect()) if max(family) else []
    beside = spark.sparkContext.broadcast((np.array([r.doc_id for r in others], np.int64), np.array([family[number[r.lang]] for r in others], np.int64),
                                           _matrix([r.x for r in others])))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "at", "x"])
        f, at, x = int(rows["family"].iloc[0]), rows["at"].to_numpy(), _matrix(rows["x"])
        out = []
        ids, of, far = beside.value
        if len(ids):
            order = np.argsort(np.concatenate([rows["doc_id"].to_numpy(), ids[of != f]]), kind="stable")
            y = np.concatenate([np.ones(len(x)), -np.ones((of != f).sum())])[order]
            out.append((f, -1, -1, svm(np.concatenate([x, far[of != f]])[order], y).tobytes()))
        for a, b in combinations(np.unique(at).tolist(), 2):
            both = np.flatnonzero((at == a) | (at == b))
            out.append((f, a, b, svm(x[both], np.where(at[both] == a, 1.0, -1.0)).tobytes()))
        return pd.DataFrame(out, columns=["family", "a", "b", "w"])

    known = spark.createDataFrame([(g, i, family[i]) for g, i in number.items()], "lang string, at int, family int")
    machines = vectors.join(known, "lang").groupBy("family").applyInPandas(fit, "family int, a int, b int, w binary").collect()
    return Model(names, family, [(r.family, r.a, r.b, np.frombuffer(bytes(r.w), np.float32)) for r in machines])


def languages(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 for null texts and texts without a letter, and where nothing was learned.
    Repeated rows are predicted each, alike.
    """
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                lang, score = model.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
