"""Ranked lexical search by norm buckets (operator 12).

A document's *impact vector* holds, for each term of the items, what that term adds to a score: its
weight times its damped frequency, a whole number. An item is a 0/1 vector over terms, so a score is
an inner product, and the 50 best documents of an item are those with the largest products (LEMP):

1. Documents become sparse vectors over the items' terms; terms are counted over all documents.
2. Vectors are ranged by length, longest first, and written. A bucket is a run of vectors of like
   length. A vector shorter than ``threshold / sqrt(terms of the item)`` can't reach the threshold
   (Cauchy-Schwarz), so whole buckets fall.
3. Inside a bucket the item's terms go by the largest coordinate that the bucket has in them. Once
   the largest coordinates of the terms that are left add up to less than the threshold, a vector
   without any of the earlier terms falls; of the others, those whose partial product, with the
   rest bounded by coordinates and by Cauchy-Schwarz, stays below it.
4. Survivors get their products in whole numbers.

The longest vectors are searched first, for all items. Their 50th best scores are thresholds that
every later task starts with; a task then raises them by what it finds. No bound drops a score that
is equal to a threshold, so ties are settled by doc_id at the end. Items are read and searched in
slices of bounded size, one at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import bound_batches, give_back, pieces
from flowlake.scratch import materialize, scratch_path

BEST = 50                     # documents an item
SLICE_BYTES = 2 << 20         # text of the items that are searched together; a longer item is alone
SLICE_ITEMS = 4096
BUCKET = 2048                 # vectors of a bucket
FIRST = 1 / 16                # of all vectors, the longest, that set the first thresholds
CELLS = 20                    # of a length's natural logarithm, a unit
BLOCK = 1 << 20               # bytes of a text that are cut into terms at a time
SALTS = 64
SLACK = 1e-9                  # of a floating-point bound, for its rounding

# Bytes that end a term become blanks, capitals A-Z small; other bytes are parts of terms.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

VECTORS = "doc_id long, n long, term array<int>, tf array<long>"
IMPACTS = "doc_id long, norm double, cell int, term array<int>, impact array<long>"
FOUND = "item int, doc_id long, score long"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text, in blocks that end between terms."""
    data = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass
class Slice:
    """Items that are searched together: their ids, distinct terms, and the numbers of these terms."""

    ids: list[int | None]
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]


def slices(items: DataFrame) -> Iterator[Slice]:
    """Items in slices of bounded size, each made when the one before has been used."""
    held, size = Slice([], [], {}), 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        own = len((r.text or "").encode())
        if held.ids and (size + own > SLICE_BYTES or len(held.ids) >= SLICE_ITEMS):
            yield held
            held, size = Slice([], [], {}), 0
        found = {held.vocabulary.setdefault(t, len(held.vocabulary)) for block in terms(r.text) for t in block}
        held.ids.append(r.item_id)
        held.items.append(np.array(sorted(found), np.int64))
        size += own
    if held.ids:
        yield held


def _vectors(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            for part in pieces(batch):
                sizes, found = [], []
                for text in part.column("text").to_pylist():
                    n, count = 0, Counter()
                    for block in terms(text):
                        n += len(block)
                        count.update(map(number, block))
                    count.pop(None, None)
                    sizes.append(n)
                    found.append(count)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([list(c.keys()) for c in found], pa.list_(pa.int32())),
                     pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])
        give_back()
    return run


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column."""
    column = batch.column(name)
    sizes = np.diff(np.asarray(column.offsets))
    return np.asarray(column.flatten(), np.int64), np.repeat(np.arange(len(column)), sizes)


def _impacts(weights, documents: int, total: int):
    """Impact vectors with their lengths; documents without a term that counts go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.array([50 + 50 * n * documents // total for n in batch.column("n").to_pylist()], np.int64)
            term, row = _flat(batch, "term")
            tf, _ = _flat(batch, "tf")
            impact = weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            some = impact > 0
            term, row, impact = term[some], row[some], impact[some]
            sizes = np.bincount(row, minlength=len(m))
            norm = np.sqrt(np.bincount(row, impact.astype(np.float64) ** 2, minlength=len(m)))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(norm), pa.array(np.floor(np.log(np.maximum(norm, 1)) * CELLS).astype(np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(impact))],
                ["doc_id", "norm", "cell", "term", "impact"])
            yield out.filter(pa.array(sizes > 0))
        give_back()
    return run


class Bucket:
    """Vectors of like length, by term: ``at[start[i]:start[i + 1]]`` are the vectors with ``terms[i]``."""

    def __init__(self, norm: np.ndarray, term: np.ndarray, row: np.ndarray, impact: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.at, self.impact = row[order], impact[order]
        self.terms, start = np.unique(term[order], return_index=True)
        self.start = np.append(start, len(order))
        self.most = np.maximum.reduceat(self.impact, start) if len(start) else np.empty(0, np.int64)
        self.norm, self.longest = norm, float(norm.max(initial=0.0))

    def search(self, item: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, products) of all vectors whose product with the item is ``least`` (1 at least) or more."""
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        if self.longest * math.sqrt(len(item)) * (1 + SLACK) < least or not len(self.terms):
            return nothing
        slot = np.minimum(np.searchsorted(self.terms, item), len(self.terms) - 1)
        slot = slot[self.terms[slot] == item]
        slot = slot[np.argsort(-self.most[slot], kind="stable")]
        # rest[j]: the most that terms j, j + 1, ... may add.
        rest = np.append(np.cumsum(self.most[slot][::-1])[::-1], 0)
        if rest[0] < least:
            return nothing
        focus = int(np.argmax(rest < least))
        product, square = np.zeros(len(self.norm), np.int64), np.zeros(len(self.norm))
        for s in slot[:focus].tolist():
            at, impact = self.at[self.start[s]:self.start[s + 1]], self.impact[self.start[s]:self.start[s + 1]]
            product[at] += impact
            square[at] += impact.astype(np.float64) ** 2
        left = len(slot) - focus
        near = np.flatnonzero(product)
        if left:
            short = np.sqrt(np.maximum(self.norm[near] ** 2 * (1 + SLACK) - square[near], 0.0) * left)
            bound = product[near] + np.minimum(short * (1 + SLACK) + 1, rest[focus])
            near = near[bound >= least]
            if not len(near):
                return nothing
            for s in slot[focus:].tolist():
                product[self.at[self.start[s]:self.start[s + 1]]] += self.impact[self.start[s]:self.start[s + 1]]
        near = near[product[near] >= least]
        return near, product[near]


class Best:
    """The best documents of one item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, least: int, best: int):
        self.least, self.best = max(least, 1), best
        self.score, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(p) for p in ((self.score, score), (self.ids, ids), (self.null, null)))
        if len(score) > self.best:
            top = np.lexsort((ids, null, -score))[:self.best]
            score, ids, null = score[top], ids[top], null[top]
        self.score, self.ids, self.null = score, ids, null
        if len(score) == self.best:
            self.least = max(self.least, int(score.min()))


def _searched(items, least, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(int(x), best) for x in least.value]
        for batch in batches:
            norm = np.asarray(batch.column("norm"))
            ids, null = np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("doc_id").is_null())
            (term, row), (impact, _) = _flat(batch, "term"), _flat(batch, "impact")
            cuts = np.searchsorted(row, np.arange(0, len(norm) + BUCKET, BUCKET))
            for b, a in enumerate(range(0, len(norm), BUCKET)):
                one = slice(cuts[b], cuts[b + 1])
                bucket = Bucket(norm[a:a + BUCKET], term[one], row[one] - a, impact[one])
                for item, so_far in zip(items.value, found):
                    at, score = bucket.search(item, so_far.least)
                    if len(at):
                        so_far.add(score, ids[a + at], null[a + at])
        for i, so_far in enumerate(found):
            if len(so_far.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(so_far.score), i, np.int32)), pa.array(so_far.ids, mask=so_far.null), pa.array(so_far.score)], ["item", "doc_id", "score"])
        give_back()
    return run


def _ranked(found: DataFrame, best: int) -> DataFrame:
    """The best rows of each item with their rank; parts of an item first, as each task has some."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).withColumn("rank", rank("item", "salt")).filter(F.col("rank") <= best)
    return parts.select("item", "doc_id", "score", rank("item").alias("rank")).filter(F.col("rank") <= best)


def _search_slice(docs: DataFrame, one: Slice, best: int) -> DataFrame:
    """(item, doc_id, score, rank) of a slice's items, by their number in it."""
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(one.vocabulary)
    vectors = materialize(docs.mapInArrow(_vectors(vocabulary), VECTORS).filter("n > 0"), "vectors")
    documents, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(max(len(one.vocabulary), 1), np.int64)
    for r in vectors.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        weights[r.t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
    impacts = vectors.mapInArrow(_impacts(context.broadcast(weights), documents, max(total, 1)), IMPACTS)
    # The id spreads vectors of one length, as of many copies.
    order = [F.desc("norm"), F.asc("doc_id")]
    impacts = materialize(impacts.repartitionByRange(*order).sortWithinPartitions(*order), "impacts")
    # Cells are of a fixed width, so there are at most some hundred.
    longest, cut = 0, None
    cells = sorted(impacts.groupBy("cell").agg(F.count("*").alias("n")).collect(), reverse=True)
    for r in cells:
        longest, cut = longest + r.n, r.cell
        if longest >= FIRST * sum(x.n for x in cells):
            break
    items, least = context.broadcast(one.items), np.zeros(len(one.items), np.int64)
    search = lambda rows: rows.mapInArrow(_searched(items, context.broadcast(least), best), FOUND)
    first = materialize(_ranked(search(impacts.filter(F.col("cell") >= (cut or 0))), best), "first-best")
    for r in first.filter(F.col("rank") == best).collect():
        least[r.item] = r.score
    second = search(impacts.filter(F.col("cell") < (cut or 0)))
    return _ranked(first.drop("rank").unionByName(second), best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``best`` documents with a score above 0.

    Equal scores go by ascending doc_id, a null doc_id last. Null, empty and termless texts are no
    documents and find nothing as items. Each row of ``items`` is an item of its own, whatever its
    item_id (null too); rows of ``docs`` that share a doc_id are documents of their own. Other columns
    are ignored. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path, schema, done = scratch_path(spark, "ranked"), "item_id long, rank int, doc_id long, score long", 0
    for one in slices(items):
        ids = spark.createDataFrame(list(enumerate(one.ids)), "item int, item_id long")
        ranked = _search_slice(docs, one, best).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        ranked.write.parquet(f"{path}/slice={done}")
        done += 1
    return spark.read.schema(schema).parquet(path).select("item_id", "rank", "doc_id", "score") if done else spark.createDataFrame([], schema)
