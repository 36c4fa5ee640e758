"""Exact sampling and splitting by seeded row keys.

Taking "the n rows with the smallest key" needs no sort and no window: a histogram of key
prefixes finds the cut, and a filter applies it. Only rows that share the cut key exactly,
that is copies of one row, need counting. Copies are handled as one row with a count, so a
group of copies may be as large as it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from flowlake.functions import fixed
from flowlake.functions.keys import full_row_key, row_key, seeded_index, unit_interval
from flowlake.functions.numeric import safe_ratio

KEY = "_key"
GROUP = "_group"
DIGITS = 3            # 4096 histogram cells per step
KEY_DIGITS = 32
SMALL_CELL = 20_000   # keys of one cell that may be read to the driver
LAST_KEY = "g"        # above every hex key
CHUNK = 10_000        # copies made by one task from one row
SLICE_DIGITS = 4      # 65,536 slices of a row numbering


@dataclass(frozen=True)
class Cut:
    """Keys below ``key`` are in; of the ``equal`` rows at ``key``, ``take`` are in."""

    key: str
    take: int
    equal: int

    @property
    def exact(self) -> bool:
        return self.take == self.equal


def _cell_cut(cells: Sequence[tuple[str, int]], wanted: int) -> tuple[str, int, int]:
    """(cell holding the wanted-th row, rows wanted inside it, rows inside it)."""
    for prefix, rows in sorted(cells):
        if wanted <= rows:
            return prefix, wanted, rows
        wanted -= rows
    raise ValueError("fewer rows than wanted")


Wanted = Mapping[int | str, int] | Callable[[dict], Mapping[int | str, int]]


def find_cuts(keyed: DataFrame, wanted: Wanted) -> tuple[dict, dict]:
    """Cut per group of (_group, _key) rows, and the rows per group.

    ``wanted`` gives rows per group, or computes them from the group sizes, which the first
    histogram yields anyway. Each step narrows a group's cell by 3 hex digits: one pass over
    two narrow columns, at most 4096 counts per group back. A cell of few rows is finished
    by reading its keys. Groups of which all or no rows are wanted need no cut.
    """
    cells = _histogram(keyed, DIGITS)
    sizes: dict = {}
    for c in cells:
        sizes[c[GROUP]] = sizes.get(c[GROUP], 0) + c["n"]
    targets = wanted(sizes) if callable(wanted) else wanted
    open_cells = {g: ("", n, 0) for g, n in targets.items() if 0 < n < sizes.get(g, 0)}
    cuts = {g: Cut(LAST_KEY, 0, 0) for g, n in targets.items() if n >= sizes.get(g, 0) > 0}
    digits = DIGITS
    while open_cells:
        for g in list(open_cells):
            prefix, n, rows = _cell_cut(
                [(c["cell"], c["n"]) for c in cells if c[GROUP] == g], open_cells[g][1])
            open_cells[g] = (prefix, n, rows)
            if digits == KEY_DIGITS:
                cuts[g] = Cut(prefix, n, rows)
                del open_cells[g]
        if open_cells:
            small = all(rows <= SMALL_CELL for _, _, rows in open_cells.values())
            digits = KEY_DIGITS if small else min(KEY_DIGITS, digits + DIGITS)
            # All open cells have prefixes of one length; the key is computed once per row.
            known = len(next(iter(open_cells.values()))[0])
            cell = _by_group({g: p for g, (p, _, _) in open_cells.items()})
            cells = _histogram(keyed.filter(F.substring(KEY, 1, known) == cell), digits)
    return cuts, sizes


def _histogram(keyed: DataFrame, digits: int) -> list[Row]:
    return (keyed.groupBy(GROUP, F.substring(KEY, 1, digits).alias("cell"))
            .agg(F.count("*").alias("n")).collect())


def _by_group(values: Mapping[int | str, str]) -> Column:
    """Text per group, null for other groups."""
    out = F.lit(None).cast("string")
    for g, value in values.items():
        out = F.when(F.col(GROUP) == g, value).otherwise(out)
    return out


def expand_copies(df: DataFrame, copies: str) -> DataFrame:
    """Each row ``copies`` times. Large counts are cut in chunks that spread over tasks."""
    chunks = (df.filter(F.col(copies) > 0)
              .withColumn("_chunk", F.explode(F.sequence(
                  F.lit(0), F.floor((F.col(copies) - 1) / CHUNK).cast("bigint"))))
              .withColumn("_each", F.least(F.lit(CHUNK).cast("bigint"),
                                         F.col(copies) - F.col("_chunk") * CHUNK)))
    few, many = chunks.filter(F.col(copies) <= CHUNK), chunks.filter(F.col(copies) > CHUNK)
    spread = many.repartition(*[F.col(f"`{c}`") for c in many.columns])
    return (few.unionByName(spread)
            .withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_each"))))
            .drop("_chunk", "_each", copies))


def mark_lowest(df: DataFrame, wanted: Wanted, key: Column, group: Column,
                out: str) -> DataFrame:
    """``out`` = row is among its group's ``wanted`` lowest keys, exactly; no row is lost."""
    keyed = df.withColumn(KEY, key).withColumn(GROUP, group)
    cuts, _ = find_cuts(keyed.select(GROUP, KEY), wanted)
    if not cuts:
        return df.withColumn(out, F.lit(False))
    whole = [g for g, c in cuts.items() if c.key == LAST_KEY]
    bounds = _by_group({g: c.key for g, c in cuts.items() if g not in whole})
    below = F.coalesce(F.col(KEY) <= bounds, F.lit(False))
    if whole:  # no key is computed for rows that are in anyway
        below = F.when(F.col(GROUP).isin(whole), True).otherwise(below)
    torn = {g: c for g, c in cuts.items() if not c.exact}
    if not torn:
        return keyed.withColumn(out, below).drop(KEY, GROUP)
    # Rows at a torn cut are told apart below; without them "at most" means "below".
    tied = F.coalesce(F.col(KEY) == _by_group({g: c.key for g, c in torn.items()}), F.lit(False))
    parts = [keyed.filter(~tied).withColumn(out, below).drop(KEY, GROUP)]
    for g, c in torn.items():
        ties = keyed.filter((F.col(GROUP) == g) & (F.col(KEY) == c.key)).drop(KEY, GROUP)
        parts.append(_mark_ties(ties, c.take, out))
    return reduce(DataFrame.unionByName, parts)


def _mark_ties(ties: DataFrame, take: int, out: str) -> DataFrame:
    """``take`` of the rows that share one key: different rows by content, copies by count."""
    distinct = ties.groupBy(*[F.col(f"`{c}`") for c in ties.columns]).agg(F.count("*").alias("_n"))
    first_two = distinct.limit(2).collect()
    if len(first_two) == 1:
        n = first_two[0]["_n"]
        sides = distinct.withColumn("_side", F.explode(F.array(
            F.struct(F.lit(True).alias("in"), F.lit(take).cast("bigint").alias("copies")),
            F.struct(F.lit(False).alias("in"), F.lit(n - take).cast("bigint").alias("copies")))))
        return expand_copies(sides.select(*ties.columns, F.col("_side.in").alias(out),
                                          F.col("_side.copies").alias("_copies")), "_copies")
    # The caller's key does not tell these rows apart; the whole row does.
    return mark_lowest(ties, {"ties": take}, full_row_key(ties, take), F.lit("ties"), out)


def take_lowest(df: DataFrame, n: int, key: Column) -> DataFrame:
    """Exactly ``n`` rows, those of the lowest keys (all rows if there are fewer)."""
    return mark_lowest(df, {"all": n}, key, F.lit("all"), "_in").filter("_in").drop("_in")


def _key(df: DataFrame, seed: int, key_columns: Sequence[str | Column] | None) -> Column:
    return row_key(seed, key_columns) if key_columns else full_row_key(df, seed)


def class_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Malicious to benign; null without benign rows."""
    bad, good = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(bad.alias("malicious"), good.alias("benign"),
                  F.round(safe_ratio(bad, good), 6).alias("ratio"))


def undersample(df: DataFrame, ratio: int = fixed.UNDERSAMPLE_RATIO, seed: int = fixed.SEED,
                key_columns: Sequence[str | Column] | None = None,
                label: str = "label") -> DataFrame:
    """R2: all benign rows and exactly ``ratio`` times as many malicious ones, none twice.

    Fewer malicious rows than that are all kept.
    """
    classes = df.filter(F.col(label).isin(0, 1))
    marked = mark_lowest(classes, lambda sizes: {0: sizes.get(0, 0), 1: ratio * sizes.get(0, 0)},
                         _key(df, seed, key_columns), F.col(label), "_in")
    return marked.filter("_in").drop("_in")


def _slice_offsets(df: DataFrame, key: Column) -> tuple[list[tuple[str, int, bool]], int]:
    """(key slice, its first row number, whether copies may crowd it), at most 65,536, and the rows in all."""
    counts = (df.groupBy(F.substring(key, 1, SLICE_DIGITS).alias("s"))
              .agg(F.count("*").alias("n")).collect())
    # Keys are hashes, so a slice of several times its share has copies of a row.
    crowd = max(CHUNK, 4 * sum(r["n"] for r in counts) // 16 ** SLICE_DIGITS)
    offsets, seen = [], 0
    for s, n in sorted((r["s"], r["n"]) for r in counts):
        offsets.append((s, seen, n > crowd))
        seen += n
    return offsets, seen


def index_rows(df: DataFrame, seed: int = fixed.SEED,
               key_columns: Sequence[str | Column] | None = None,
               out: str = "row_idx") -> DataFrame:
    """Row number 0..N-1 in key order."""
    offsets, _ = _slice_offsets(df, _key(df, seed, key_columns))
    return _indexed(df, _key(df, seed, key_columns), offsets, out)


def _indexed(df: DataFrame, key: Column, offsets: list[tuple[str, int, bool]], out: str) -> DataFrame:
    """Slices are key prefixes, even because keys are hashes, and their offsets are a small table: rows
    travel once, to the other rows of their slice. Only in slices crowded by copies, copies are counted
    first, so that each distinct row is met once."""
    columns, crowded = [F.col(f"`{c}`") for c in df.columns], any(c for _, _, c in offsets)
    offsets = df.sparkSession.createDataFrame(offsets, "_slice STRING, _offset BIGINT, _crowded BOOLEAN")
    keyed = (df.withColumn(KEY, key).withColumn("_slice", F.substring(KEY, 1, SLICE_DIGITS))
             .join(F.broadcast(offsets), "_slice"))
    inside = Window.partitionBy("_slice").orderBy(KEY, *_sortable(df))
    number = (F.col("_offset") + F.row_number().over(inside) - 1).alias(out)
    if not crowded:
        return keyed.select(*columns, number)
    return keyed.filter("NOT _crowded").select(*columns, number).unionByName(
        _indexed_copies(keyed.filter("_crowded"), columns, inside, out))


def _indexed_copies(keyed: DataFrame, columns: list[Column], inside: Window, out: str) -> DataFrame:
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (keyed.groupBy("_slice", "_offset", KEY, *columns).agg(F.count("*").alias("_n"))
              .withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_n").over(before), F.lit(0))))
    return (placed
            .withColumn("_from", F.explode(F.sequence(
                F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(CHUNK).cast("bigint"))))
            .repartition(F.col("_start"), F.col("_from"))
            .withColumn("_at", F.explode(F.sequence(
                F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("_n")) - 1)))
            .select(*columns, (F.col("_start") + F.col("_at")).alias(out)))


def _sortable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() != "map"]


def bootstrap(df: DataFrame, n: int, seed: int = fixed.SEED,
              key_columns: Sequence[str | Column] | None = None,
              squared: bool = False) -> DataFrame:
    """Exactly ``n`` draws with replacement.

    R4 (``squared``): a row drawn k times appears k*k times, as published figures have it.
    """
    key = _key(df, seed, key_columns)
    offsets, rows = _slice_offsets(df, key)
    draws = (df.sparkSession.range(n)
             .select(seeded_index(seed, F.col("id"), F.lit(rows)).alias("row_idx"))
             .groupBy("row_idx").agg(F.count("*").alias("_k")))
    copies = F.col("_k") * F.col("_k") if squared else F.col("_k")
    return expand_copies(_indexed(df, key, offsets, "row_idx").join(draws, "row_idx")
                         .withColumn("_copies", copies).drop("row_idx", "_k"), "_copies")


def balance(df: DataFrame, ratio: int = fixed.UNDERSAMPLE_RATIO, seed: int = fixed.SEED,
            key_columns: Sequence[str | Column] | None = None, mode: str = "undersample",
            label: str = "label") -> DataFrame:
    """Balanced table: ``undersample`` (R2), ``bootstrap`` (R3) or ``squared``."""
    if mode == "undersample":
        return undersample(df, ratio, seed, key_columns, label)
    benign = df.filter(F.col(label) == 0)
    drawn = bootstrap(df.filter(F.col(label) == 1), ratio * benign.count(), seed, key_columns,
                      squared=mode == "squared")
    return drawn.unionByName(benign)


def shuffle(df: DataFrame, seed: int = fixed.SEED,
            key_columns: Sequence[str | Column] | None = None) -> DataFrame:
    """Seeded permutation, as a global sort on the key (range-partitioned by Spark)."""
    return df.withColumn(KEY, _key(df, seed, key_columns)).orderBy(KEY).drop(KEY)


def test_sizes(counts: Mapping[int, int], test_share: float) -> dict[int, int]:
    """Exact test rows per class: total rounded up, train shares by largest remainder."""
    total = sum(counts.values())
    test_total = ceil(round(total * test_share, 9))
    train_total = total - test_total
    shares = {c: n * train_total / total for c, n in counts.items()}
    train = {c: floor(s) for c, s in shares.items()}
    by_rest = sorted(counts, key=lambda c: (-(shares[c] - train[c]), c))
    for c in by_rest[:train_total - sum(train.values())]:
        train[c] += 1
    return {c: counts[c] - train[c] for c in counts}


def stratified_split(df: DataFrame, test_share: float = fixed.TEST_SHARE,
                     seed: int = fixed.SEED, key_columns: Sequence[str | Column] | None = None,
                     label: str = "label", out: str = "split") -> DataFrame:
    """``train``/``test`` with the exact size per class."""
    marked = mark_lowest(df, lambda sizes: test_sizes(sizes, test_share),
                         _key(df, seed, key_columns), F.col(label), "_in")
    return marked.withColumn(out, F.when(F.col("_in"), "test").otherwise("train")).drop("_in")


def approximate_split(df: DataFrame, test_share: float = fixed.TEST_SHARE,
                      seed: int = fixed.SEED, key_columns: Sequence[str | Column] | None = None,
                      out: str = "split") -> DataFrame:
    """R6, approximate sizes: one filter on the key, no counting pass."""
    part = unit_interval(_key(df, seed, key_columns))
    return df.withColumn(out, F.when(part < test_share, "test").otherwise("train"))


def leak_free_split(df: DataFrame, id_columns: Sequence[str | Column],
                    test_share: float = fixed.TEST_SHARE, seed: int = fixed.SEED,
                    out: str = "split") -> DataFrame:
    """Every copy of a flow falls on one side; run it before balancing."""
    return approximate_split(df, test_share, seed, id_columns, out)


def split_balance(split: DataFrame, label: str = "label", column: str = "split") -> DataFrame:
    """Rows by split and class."""
    return split.groupBy(column, label).agg(F.count("*").alias("rows"))
