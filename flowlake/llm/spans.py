"""Places of pattern matches in texts, by SQL functions alone.

Spark returns what a pattern matches, and what stands between, but not where. A match begins
after all gaps and matches before it; a running sum over the matches of a row gives its place in
code points. Only matches travel, never texts.

The patterns here are written so that Java's matcher takes time in proportion to the text:
runs are possessive, and start only where a run starts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR = 40                     # characters on each side that a span keeps as its context


@dataclass(frozen=True)
class Kind:
    """A pattern; ``hint`` must be in a text for it to be searched at all (a cheaper pattern).

    With ``ahead``, group 1 of the pattern is text behind the match that other matches may share.
    """

    name: str
    pattern: str
    hint: str
    base: bool = True
    ahead: bool = False


def _spans(i: int, ahead: bool) -> Column:
    """Matches of kind ``i`` with the gap before each, from the columns m, g and a of that number."""
    gaps = F.col(f"g{i}")
    behind = (lambda at: F.get(F.col(f"a{i}"), at)) if ahead else (lambda at: F.lit(None).cast("string"))
    return F.transform(F.col(f"m{i}"), lambda m, at: F.struct(
        F.lit(i).alias("kind"), at.alias("at"), m.alias("match"), F.length(F.get(gaps, at)).alias("gap"),
        F.right(F.get(gaps, at), F.lit(NEAR)).alias("before"), F.left(F.get(gaps, at + 1), F.lit(NEAR)).alias("after"),
        behind(at).alias("ahead")))


def find(docs: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """One row (row, doc_id, kind, match, start, stop, before, after, ahead) a match, and a row with
    null kind for each document, so that none is lost. Starts count from 0, stops are exclusive."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    empty = F.array().cast("array<string>")
    for i, k in enumerate(kinds):
        there = F.rlike("text", F.lit(k.hint))
        df = (df.withColumn(f"m{i}", F.when(there, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(empty)))
    for i, k in enumerate(kinds):
        df = df.withColumn(f"g{i}", F.when(F.size(f"m{i}") > 0, F.split("text", k.pattern, -1)).otherwise(empty))
        if k.ahead:
            df = df.withColumn(f"a{i}", F.when(F.size(f"m{i}") > 0, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(1))).otherwise(empty))
    parts = [_spans(i, k.ahead) for i, k in enumerate(kinds)]
    rows = df.select("row", "doc_id", F.explode_outer(F.concat(*parts)).alias("s")).select("row", "doc_id", "s.*")
    stop = F.sum(F.col("gap") + F.length("match")).over(
        Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Every kind of a row in one place, so that the later grouping by row needs no second shuffle.
    return (rows.repartition("row").withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("match"))
            .select("row", "doc_id", "kind", "match", "start", "stop", "before", "after", "ahead"))


def joined(spans: Column, names: Sequence[str]) -> Column:
    """kind:start:stop of sorted spans whose ``kind`` is a number, comma-joined."""
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(found: DataFrame, names: Sequence[str], base: Sequence[str], first: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """One row a document: counts of base kinds, digest of base spans, and all spans.

    ``found`` holds the spans that stay, and null kinds; ``first`` names the sort order of spans:
    their fields ``kind`` and ``start``, in that order or the other.
    """
    fields = [F.col(c) for c in (*first, "stop")]
    held = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(*fields))))
    n = len(base)
    counts = [F.count_if(F.col("kind") == i).alias(f"n_{b}") for i, b in enumerate(base)]
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, held.alias("held"), *extra)
    return rows.select(
        "doc_id", *[f"n_{b}" for b in base],
        F.sha2(joined(F.filter("held", lambda s: s["kind"] < n), names), 256).alias("base_sha256"),
        joined(F.col("held"), names).alias("spans"),
        *[c for c in rows.columns if c not in ("row", "doc_id", "held") and not c.startswith("n_")])
