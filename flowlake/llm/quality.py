"""Quality rules with robust multivariate outliers (operator 6).

Fixed rules reject documents with few words or much repetition. The rest is judged by how far
its statistics lie from those of its language and source: mean word length, symbols a word,
repeated lines and repeated words, each transformed to be roughly normal. Centre and covariance
are minimum-covariance-determinant estimates: start from medians and median deviations, then
repeat concentration steps, each of which keeps the half of the documents that lie nearest and
estimates anew from them, and at last estimate once from all that lie near. Junk may be just
under half of a group. Each step is a pass of group sums and quantile sketches
over a narrow table of all documents, so a source may hold any share of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import BROADCAST_ROWS, WHITE, bound_batches, give_back, pieces, window_hashes
from flowlake.llm.encode import forget
from flowlake.scratch import materialize

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
REPEATED = 0.2
WINDOW = 5
KEPT = 0.5                    # share of a group that a concentration step keeps
NEAR = 0.025                  # tail beyond which the last estimate leaves documents out
STEPS = 4
TAIL = 1e-8                   # of the chi-squared distribution beyond which a document is rejected
LEAST_GROUP = 50              # smaller groups are judged by their language, or by all documents
# Least deviation of each transformed statistic: what differs by less is the same.
FLOOR = (0.05, 0.10, 0.12, 0.12)
P = len(FLOOR)
STAT_NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[list[bytes]], k: int = WINDOW) -> list[int]:
    """Words of each text that stand in a window of ``k`` words found twice or more in it."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if total < k:
        return [0] * len(words)
    flat = np.fromiter((hash(w) for ws in words for w in ws), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(words)), sizes)
    h = window_hashes(flat, k)
    whole = doc[: len(h)] == doc[k - 1:]
    at = np.flatnonzero(whole)
    # A text's number goes into its hashes, so equal ones are of the same text.
    h = h[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(total + 1, np.int64)
    first = at[twice]
    np.add.at(step, first, 1)
    np.add.at(step, first + k, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(doc, covered, len(words)).astype(np.int64).tolist()


def text_stats(texts: list[str | None]) -> list[np.ndarray]:
    """The columns of ``STAT_NAMES`` for some texts; a null text is empty."""
    raw = [(t or "").encode() for t in texts]
    words = [b.split() for b in raw]
    out = np.zeros((len(STAT_NAMES), len(raw)), np.int64)
    for i, (t, b, w) in enumerate(zip(texts, raw, words)):
        plain = b.translate(None, WHITE)
        lines = [x for x in b.split(b"\n") if x.strip(WHITE)]
        out[:5, i] = (len(w), len(t or "") - (len(b) - len(plain)), len(plain) - len(plain.translate(None, SYMBOLS)),
                      len(lines), len(lines) - len(set(lines)))
    out[5] = repeated_words(words)
    return list(out)


def with_stats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, and ``stats``, a struct of ``STAT_NAMES``. One pass, no shuffle."""
    bound_batches(docs.sparkSession)
    own = [c for c in docs.columns if c != "stats"]
    df = docs.select(*[f"`{c}`" for c in own]).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"_q_{n}", T.LongType()) for n in STAT_NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in pieces(batch):
                stats = [pa.array(x) for x in text_stats(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, *stats], [*part.schema.names, *(f"_q_{n}" for n in STAT_NAMES)])
        give_back()

    struct = F.struct(*[F.col(f"_q_{n}").alias(n) for n in STAT_NAMES])
    return df.mapInArrow(run, schema).select(*[f"`{c}`" for c in own], struct.alias("stats"))


def failed(s: str = "stats") -> Column:
    """The fixed rules."""
    n, r = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > int(100 * REPEATED) * n)


def vector(s: str = "stats") -> Column:
    """Transformed statistics. Word length is drawn towards 6 in short texts, where it varies by chance."""
    words = F.greatest(F.col(f"{s}.n_words"), F.lit(1))
    return F.array(F.ln((F.col(f"{s}.word_chars") + 300) / (F.col(f"{s}.n_words") + 50)),
                   F.sqrt(F.col(f"{s}.n_symbols") / words),
                   F.sqrt(F.col(f"{s}.n_dup_lines") / F.greatest(F.col(f"{s}.n_lines"), F.lit(1))),
                   F.sqrt(F.col(f"{s}.n_repeat_words") / words))


def keys() -> Column:
    """Groups of a row, nearest first: language and source, language, all. Nulls are values."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    both = F.concat_ws("\t", F.length(part("lang")).cast("string"), part("lang"), part("source"))
    return F.array(both, part("lang"), F.lit(""))


def distance(x: Column, mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance."""
    d = [F.get(x, F.lit(i)) - F.get(mean, F.lit(i)) for i in range(P)]
    terms = [d[i] * d[j] * F.get(inverse, F.lit(i * P + j)) for i in range(P) for j in range(P)]
    return sum(terms[1:], terms[0])


def _chi2(x: float, p: int) -> float:
    """Chi-squared distribution function, p even."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def chi2_quantile(tail: float, p: int = P) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _chi2(mid, p) > tail else (low, mid)
    return high


def consistency(share: float, p: int = P) -> float:
    """What makes the covariance of the nearest ``share`` that of all, for normal vectors."""
    return share / _chi2(chi2_quantile(1 - share, p), p + 2)


def _inverse(factor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.array(FLOOR)
        scale = np.outer(floor, floor)
        for b in batches:
            if not len(b):
                continue
            n = b["n"].to_numpy()[:, None]
            s1, s2 = np.stack(b["s1"].to_numpy()) / n, np.stack(b["s2"].to_numpy()).reshape(-1, P * P) / n
            cov = s2.reshape(-1, P, P) - s1[:, :, None] * s1[:, None, :]
            # In units of the floor no direction varies by less than 1.
            spread, axes = np.linalg.eigh(cov * factor / scale)
            inverse = (axes / np.maximum(spread, 1.0)[:, None, :]) @ axes.transpose(0, 2, 1) / scale
            yield pd.DataFrame({"key": b["key"], "mean": list(s1), "inverse": list(inverse.reshape(-1, P * P))})
    return run


def fit(stats: DataFrame, share: float = KEPT, steps: int = STEPS) -> DataFrame:
    """(key, mean, inverse) of each group of at least ``LEAST_GROUP`` rows, from written (keys, x)."""
    bound_batches(stats.sparkSession)
    rows = stats.select("x", F.explode("keys").alias("key"))
    sized = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_GROUP)
    few = sized.count() <= BROADCAST_ROWS // 16
    held = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    medians = [F.percentile_approx(F.get("x", F.lit(i)), 0.5, 1000) for i in range(P)]
    middle = materialize(rows.groupBy("key").agg(F.array(*medians).alias("mean"), F.count("*").alias("n"))
                         .filter(F.col("n") >= LEAST_GROUP).drop("n"), "mcd-medians")
    away = [F.percentile_approx(F.abs(F.get("x", F.lit(i)) - F.get("mean", F.lit(i))), 0.5, 1000) for i in range(P)]
    start = rows.join(held(middle), "key").groupBy("key").agg(F.first("mean").alias("mean"), F.array(*away).alias("away"))
    sd = [F.greatest(F.get("away", F.lit(i)) * 1.4826, F.lit(FLOOR[i])) for i in range(P)]
    zero = F.lit(0.0)
    params = materialize(start.select(
        "key", "mean", F.array(*[1 / (sd[i] * sd[i]) if i == j else zero for i in range(P) for j in range(P)]).alias("inverse")), "mcd")
    s1 = F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(P)])
    s2 = F.array(*[F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i in range(P) for j in range(P)])

    def estimate(chosen: DataFrame, kept: float) -> DataFrame:
        sums = chosen.groupBy("key").agg(F.count("*").cast("double").alias("n"), s1.alias("s1"), s2.alias("s2"))
        return materialize(sums.mapInPandas(_inverse(consistency(kept)), "key string, mean array<double>, inverse array<double>"), "mcd")

    for _ in range(steps):
        near = rows.join(held(params), "key").withColumn("d", distance(F.col("x")))
        cuts = near.groupBy("key").agg(F.percentile_approx("d", share, 1000).alias("cut"))
        params = estimate(near.join(held(materialize(cuts, "mcd-cuts")), "key").filter("d <= cut"), share)
    near = rows.join(held(params), "key").filter(distance(F.col("x")) <= chi2_quantile(NEAR))
    return estimate(near, 1 - NEAR)


def _judged(df: DataFrame, params: DataFrame, tail: float) -> DataFrame:
    """``df`` with ``distance`` from its nearest fitted group, and ``base_failed`` and ``kept``."""
    few = params.count() <= BROADCAST_ROWS // 16
    df = df.withColumn("_q_keys", keys()).withColumn("_q_x", vector())
    for level in range(3):
        p = params.select(F.col("key").alias(f"_q_key{level}"), F.struct("mean", "inverse").alias(f"_q_p{level}"))
        df = df.withColumn("_q_at", F.get("_q_keys", F.lit(level))).join(
            F.broadcast(p) if few else p, F.col("_q_at") == F.col(f"_q_key{level}"), "left")
    df = df.withColumn("_q_p", F.coalesce("_q_p0", "_q_p1", "_q_p2"))
    far = distance(F.col("_q_x"), "_q_p.mean", "_q_p.inverse")
    return (df.withColumn("_q_distance", F.coalesce(far, F.lit(0.0))).withColumn("_q_failed", failed())
            .withColumn("_q_kept", ~F.col("_q_failed") & (F.col("_q_distance") <= chi2_quantile(tail))))


def fit_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written statistics of every row, fitted groups). The fixed rules' failures are not fitted."""
    rows = materialize(with_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")).drop("text"), "quality-stats")
    return rows, fit(rows.filter(~failed()).select(keys().alias("keys"), vector().alias("x")))


def quality(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """One row a row of ``docs``: doc_id, the counts, base_failed, kept, distance.

    A null or empty text has no words and fails. Null languages and sources are groups of their
    own. A group of fewer than 50 documents is judged by its language, then by all; with fewer
    than 50 documents in all, only the fixed rules judge. Repeated rows are judged each.
    """
    rows, params = fit_documents(docs)
    judged = _judged(rows, params, tail)
    return judged.select("doc_id", *[F.col(f"stats.{n}").alias(n) for n in STAT_NAMES if n != "n_lines"],
                         F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"),
                         F.round("_q_distance", 6).alias("distance"))


def keep_quality(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The documents that ``quality`` keeps, with their own columns; texts are never shuffled."""
    _, params = fit_documents(docs)
    return _judged(with_stats(docs), params, tail).filter("_q_kept").select(*[f"`{c}`" for c in docs.columns])
