"""Connected components of links between whole numbers, by alternating stars.

Each round is two group-and-join passes over the links, each written to the shared folder, so that the
driver plans one pass at a time; links never reach it, only their number and a checksum. A hub with
many links is one minimum, summed before the shuffle, and a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.scratch import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node go to its smallest neighbour. Small: those below, and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node of a link.

    Repeated links, links to itself and null ends change nothing. No links give no rows.
    """
    links = links.select("a", "b").filter("a <> b").distinct()
    links, before = materialize(links, "links"), None
    while True:
        for large in (True, False):
            links = materialize(_star(links, large), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
