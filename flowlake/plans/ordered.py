"""Order-dependent computations without one task per key.

``Window.partitionBy(key).orderBy(ts)`` sorts all rows of a key in one task. A key that
holds a third of the table breaks that. Here rows are first range-partitioned on
``(keys, order)``: a hot key simply covers many slices of even size. Windows then run per
``(slice, key)``, and what one slice must know of the earlier ones travels in a table that
has at most two rows per slice, because only a key that crosses a slice boundary needs it.

``order`` must give every row of a key its own place (add an id as the last column) or the
rows must already be grouped by ``(keys, order)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.scratch import materialize

SLICE = "_slice"


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   name: str = "slices") -> DataFrame:
    """Rows with their slice number; slices are consecutive ranges of ``(keys, order)``.

    The result is written: slice borders come from a sample, so both readers of the table
    must see the same ones.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *_columns(order))
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()), name)


def _window(keys: Sequence[str], order: Sequence[str | Column]) -> Window:
    return Window.partitionBy(SLICE, *keys).orderBy(*_columns(order))


def _crossing(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a per-(slice, key) summary whose key lies in more than one slice.

    A key crosses a border only as the last key of one slice and the first of the next, so
    the result has at most two rows per slice and may be broadcast.
    """
    if not keys:
        return summary
    places = F.count("*").over(Window.partitionBy(*keys))
    return summary.withColumn("_n", places).filter("_n > 1").drop("_n")


def _attach(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on slice and key; a missing key value is a key like any other."""
    names = [SLICE, *keys]
    renamed = carried.select(*[F.col(k).alias(f"_r_{k}") if k in names else F.col(k)
                               for k in carried.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in names]
    return df.join(F.broadcast(renamed), same, "left").drop(*[f"_r_{k}" for k in names])


def with_previous(sliced: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  value: str, out: str) -> DataFrame:
    """``out`` = ``value`` of the row before, within the key; null on the first row."""
    here = _window(keys, order)
    if value == order[0]:  # a plain maximum, which hash aggregation can hold
        latest = F.max(value)
    else:
        latest = F.max_by(value, F.struct(*[F.col(o) for o in order]))
    last = sliced.groupBy(SLICE, *keys).agg(latest.alias("_last"))
    across = Window.partitionBy(*keys).orderBy(SLICE)
    carried = (_crossing(last, keys)
               .withColumn("_carried", F.lag("_last").over(across))
               .drop("_last"))
    first = F.row_number().over(here) == 1
    return (_attach(sliced.withColumn(out, F.lag(value).over(here)).withColumn("_first", first),
                    carried, keys)
            .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(out)))
            .drop("_first", "_carried"))


def running_totals(sliced: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   sums: dict[str, str]) -> DataFrame:
    """For each ``out: column`` the running sum of ``column`` within the key, this row included."""
    here = _window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = sliced.groupBy(SLICE, *keys).agg(
        *[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = (Window.partitionBy(*keys).orderBy(SLICE)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = _crossing(totals, keys).select(
        SLICE, *keys, *[F.sum(f"_t_{out}").over(before).alias(f"_b_{out}") for out in sums])
    local = sliced.select("*", *[F.sum(c).over(here).alias(out) for out, c in sums.items()])
    joined = _attach(local, carried, keys)
    for out in sums:
        joined = joined.withColumn(out, F.col(out) + F.coalesce(F.col(f"_b_{out}"), F.lit(0)))
    return joined.drop(*[f"_b_{out}" for out in sums])


def carry_last(sliced: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               value: str, out: str) -> DataFrame:
    """``out`` = latest non-null ``value`` up to this row (an as-of lookup)."""
    here = _window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(*[F.col(o) for o in order])
    last = (sliced.groupBy(SLICE, *keys)
            .agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_last")))
    before = (Window.partitionBy(*keys).orderBy(SLICE)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = _crossing(last, keys).select(
        SLICE, *keys, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    local = sliced.withColumn(out, F.last(value, ignorenulls=True).over(here))
    return (_attach(local, carried, keys)
            .withColumn(out, F.coalesce(F.col(out), F.col("_carried")))
            .drop("_carried"))


def with_following(sliced: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   value: str, out: str) -> DataFrame:
    """``out`` = ``value`` of the next row within the key; null on the last row."""
    here = _window(keys, order)
    place = F.struct(*[F.col(o) for o in order])
    first = sliced.groupBy(SLICE, *keys).agg(F.min_by(value, place).alias("_first"))
    across = Window.partitionBy(*keys).orderBy(SLICE)
    carried = (_crossing(first, keys)
               .withColumn("_carried", F.lead("_first").over(across)).drop("_first"))
    return (_attach(sliced.withColumn(out, F.lead(value).over(here)), carried, keys)
            .withColumn(out, F.coalesce(F.col(out), F.col("_carried"))).drop("_carried"))
