"""Mixing sources to target weights by pivotal dependent rounding (operator 1).

A document of a source with target t and size s is to be taken t / s times. The whole part is
taken as it is; what is left is a fractional copy. Two fractional copies are paired: words move
at random from one to the other, so that neither's expected copies change and the pair's words
stay the same, until one of them is whole. The other goes on to the next pair. Pairs are made
within buckets of a few thousand documents; each bucket leaves one fractional copy at most, and
those meet in buckets of the next level, until one is left for each source. It goes to the
nearer whole number, which is the only place where a source's words leave its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import WORD, bound_batches
from flowlake.scratch import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BUCKET = 4096
SEED = 20240607
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n_docs, source_size, target), one row a source, from rows (source, size).

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. Targets share
    ``share`` of all sizes by weight; a target above ``most`` times its source's size stops
    there, and the excess is shared again by weight, until none is above. Without any words all
    targets are 0. Only totals reach the driver, a row a round.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # One row a source stands here, numbered in one place.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    totals = materialize(totals.withColumn(
        "weight", F.element_at(turn, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))), "mix-sources")
    whole = totals.agg(F.sum("source_size")).first()[0] or 0
    cap, weight, level = F.col("source_size") * F.lit(float(most)), F.col("weight"), None
    full = F.lit(False)
    while True:
        row = totals.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(weight)).alias("weight"),
                         F.count_if(full).alias("n")).first()
        if not row.weight:
            break
        level = max(0.0, share * whole - row.full) / row.weight
        now = full | (weight * F.lit(level) > cap)
        if totals.agg(F.count_if(now)).first()[0] == row.n:
            break
        full = now
    target = F.least(cap, weight * F.lit(level)) if level is not None else cap
    return totals.select("source", "n_docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def settle(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractional copies ``part`` of documents of ``size`` words, in the given order.

    Returns the copies and the position of the one that stays fractional, or -1. ``draw`` has a
    number from 0 to 1 for each document.
    """
    out = part.astype(np.float64).copy()
    held = -1
    for i in range(len(out)):
        x = out[i]
        if x <= EPS or x >= 1 - EPS:
            out[i] = round(x)
            continue
        if held < 0:
            held = i
            continue
        a, b, y = float(size[held]), float(size[i]), out[held]
        # Words that can go from i to the held one, and back.
        up = min(x * b, (1 - y) * a)
        down = min(y * a, (1 - x) * b)
        moved = up if draw[i] * (up + down) < down else -down
        y, x = y + moved / a, x - moved / b
        settled = [0.0 if v <= EPS else 1.0 if v >= 1 - EPS else v for v in (y, x)]
        out[held], out[i] = settled
        if settled[0] in (0.0, 1.0):
            held = i if 0.0 < settled[1] < 1.0 else -1
    return out, held


def _rounded(last: bool):
    """Settles each run of rows with equal (source, bucket) in a partition sorted by them."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        part, held = settle(pdf["size"].to_numpy(), pdf["part"].to_numpy(), pdf["draw"].to_numpy())
        if held >= 0 and last:
            part[held] = float(part[held] >= 0.5)
            held = -1
        pdf = pdf.assign(part=part, open=False)
        if held >= 0:
            pdf.iloc[held, pdf.columns.get_loc("open")] = True
        return pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for batch in batches:
            rows = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
            key = rows["slot"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1)]
            for a, b in zip(cuts, cuts[1:]):
                yield one(rows.iloc[a:b].reset_index(drop=True))
            carry = rows.iloc[cuts[-1]:]
        if carry is not None and len(carry):
            yield one(carry.reset_index(drop=True))

    return run


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
        bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of ``docs``.

    ``size`` is the number of words (a null text has 0), ``copies`` the times that the mix takes
    the document and ``taken`` their words. A document
    is taken at most ``most`` times, rounded up. Documents without words are never taken. Rows
    that share a doc_id are rounded each. No rows give no rows. Draws are hashes of doc_id, size
    and seed, so reruns agree.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return mix_sized(materialize(sized, "mix-sizes"), weights, share, most, bucket, seed)


def mix_sized(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
              bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """``mix`` of written rows (doc_id, source, size)."""
    bound_batches(sized.sparkSession)
    targets = materialize(source_targets(sized, weights, share, most).withColumn(
        "source_no", F.monotonically_increasing_id()), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (sized.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
            .join(targets.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))), "source")
            .withColumn("rate", rate)
            .withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)))
            .withColumn("whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(F.lit(0)).cast("long"))
            .withColumn("draw", _unit(F.xxhash64(F.lit(seed), "doc_id", "size")))
            .withColumn("open", F.lit(False))
            .withColumn("buckets", F.ceil(F.col("n_docs") / F.lit(bucket)).cast("long"))
            .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest("buckets", F.lit(1)))))
    columns = ["doc_id", "size", "source_size", "target", "source_no", "whole", "part", "draw", "open", "buckets", "bucket"]
    rows, done, level = rows.select(*columns), [], 0
    most_buckets = targets.agg(F.max(F.ceil(F.col("n_docs") / F.lit(bucket)))).first()[0] or 1
    while True:
        last = most_buckets <= 1
        # Large documents first: the small ones that follow settle what they leave open.
        dealt = (rows.withColumn("slot", F.xxhash64("source_no", "bucket", F.lit(level)))
                 .repartition("slot").sortWithinPartitions("slot", F.desc("size"), "draw", "doc_id"))
        schema = dealt.schema
        settled = dealt.mapInPandas(_rounded(last), schema).drop("slot")
        settled = materialize(settled, f"mix-level-{level}")
        done.append(settled.filter("not open"))
        if last:
            break
        rows = settled.filter("open").withColumn("bucket", F.floor(F.col("bucket") / F.lit(64)))
        # A new draw for each level.
        rows = rows.withColumn("draw", _unit(F.xxhash64(F.lit(seed + level + 2), "doc_id", "size"))).select(*columns)
        most_buckets, level = -(-most_buckets // 64), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("part").cast("long")).alias("copies")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies)


def _unit(h):
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mix takes it.

    Columns of ``docs`` stay as they are. Rows that share a doc_id and a size are interchangeable
    in the mix: together they are taken as often as it says, the first by text once more.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")

    def keyed(df: DataFrame, size) -> DataFrame:
        """Plain join keys: a null doc_id has 0 for it and a size below 0."""
        return (df.withColumn("_mix_size", F.when(F.col("doc_id").isNull(), -1 - size).otherwise(size))
                .withColumn("_mix_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))))

    copies = keyed(mix(docs, **how), F.col("size")).groupBy("_mix_id", "_mix_size").agg(
        F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_rows")).filter("_mix_copies > 0")
    turn = F.row_number().over(Window.partitionBy("_mix_id", "_mix_size").orderBy("text"))
    each = F.floor(F.col("_mix_copies") / F.col("_mix_rows"))
    more = F.when(turn <= F.col("_mix_copies") % F.col("_mix_rows"), 1).otherwise(0)
    return (keyed(docs, size).join(copies, ["_mix_id", "_mix_size"])
            .withColumn("_mix_n", (each + more).cast("long")).filter("_mix_n > 0")
            .withColumn("_mix_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n"))))
            .select(*[f"`{c}`" for c in docs.columns]))
