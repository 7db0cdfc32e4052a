"""Bins, ranks and samples over whole columns.

Nothing here puts a whole column into one task: running totals are taken within value
ranges of at most about ``RANGE_ROWS`` distinct values, whose own totals (a row for each
range) give the offsets.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Distinct values of a group that one task sorts.
RANGE_ROWS = 1 << 20


def quantiles(df: DataFrame, col: str, ps: Sequence[float], by: Sequence[str] = (), name: str = "quantiles") -> DataFrame:
    """One row per group with the linearly interpolated quantiles of ``ps`` as an array, read off the running totals of the values' counts."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    placed, several = ranged(counts, "_v", by)
    both = add_below(placed, several, "_v", ["_n"], by)
    if several:
        size = placed.groupBy(*(F.col(c).alias(f"_key_{c}") for c in by)).agg(F.sum("_n").alias("_size"))
        both = both.join(size, _same(by, "_key_")) if by else both.join(F.broadcast(size))
    else:  # the group is in one window as it is
        both = both.withColumn("_size", F.sum("_n").over(Window.partitionBy(*by, "_part")))
    upto = F.col("below__n") + F.col("_n")
    spots = [(F.lit(p) * (F.col("_size") - 1)) for p in ps]
    ends = [F.min(F.when(upto > at, F.col("_v"))).alias(f"_{end}{k}") for k, h in enumerate(spots) for end, at in (("l", F.floor(h)), ("h", F.ceil(h)))]
    got = both.groupBy(*by, "_size").agg(*ends)
    between = [F.col(f"_l{k}") + (h - F.floor(h)) * (F.col(f"_h{k}") - F.col(f"_l{k}")) for k, h in enumerate(spots)]
    return got.select(*by, F.array(*between).alias(name))


def quantile_edges(df: DataFrame, col: str, q: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: the q + 1 linearly interpolated quantiles, equal ones once, as ``edges``."""
    return quantiles(df, col, [k / q for k in range(q + 1)], by).select(*by, F.array_distinct("quantiles").alias("edges"))


def qcut(df: DataFrame, col: str, q: int, name: str = "bin", by: Sequence[str] = (), zero: Column | None = None) -> DataFrame:
    """Quantile bins 1..k of intervals (low, high], the lowest value in bin 1; ties stay together.

    Equal edges make fewer bins. Nulls get no bin. Rows where ``zero`` holds get bin 0 and
    take no part in the quantiles.
    """
    live = df.where(F.col(col).isNotNull() & (~zero if zero is not None else F.lit(True)))
    edges = quantile_edges(live, col, q, by)
    joined = df.join(edges, list(by), "left") if by else df.join(F.broadcast(edges))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    bin_ = F.when(F.col(col).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(col))) + 1)
    if zero is not None:
        bin_ = F.when(zero, 0).otherwise(bin_)
    return joined.withColumn(name, bin_).drop("edges")


def ranged(df: DataFrame, order: str, by: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """``df`` (a row per value and group) written once, with ``_part``: the number of the range of values that a row is in.

    Also whether any group is in several ranges. Ranges are cut by Spark's own sampling of (group, value), so
    they hold about equal numbers of rows, whatever the groups' sizes; a later range of a group has larger values.
    """
    held = staged(df, "values")
    rows = held.count()
    largest = held.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] if by and rows > RANGE_ROWS else rows
    if largest <= RANGE_ROWS:
        return held.withColumn("_part", F.lit(0)), False
    parts = -(-rows // RANGE_ROWS) * 2
    return staged(held.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()), "ranges"), True


def _same(cols: Sequence[str], prefix: str) -> Column:
    return functools.reduce(lambda u, v: u & v, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in cols])


def add_below(placed: DataFrame, several: bool, order: str, cols: Sequence[str], by: Sequence[str] = (), last: str | None = None) -> DataFrame:
    """Rows of ``ranged`` with ``below_<c>``: the sum of c over smaller values of the group; and ``last``: the next smaller value."""
    within = Window.partitionBy(*by, "_part").orderBy(order)
    local = placed.select("*", *(F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"below_{c}") for c in cols), *([F.lag(order).over(within).alias(last)] if last else []))
    if not several:
        return local
    keys = [*by, "_part"]
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys).agg(*(F.sum(c).alias(f"_all_{c}") for c in cols), F.max(order).alias("_most"))
    offsets = totals.select(*(F.col(c).alias(f"_key_{c}") for c in keys), *(F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in cols), F.max("_most").over(before).alias("_before"))
    out = local.join(offsets, _same(keys, "_key_"))
    new = {f"below_{c}": F.col(f"below_{c}") + F.col(f"_off_{c}") for c in cols} | ({last: F.coalesce(last, "_before")} if last else {})
    return out.withColumns(new).select(*local.columns)


def add_reach(placed: DataFrame, several: bool, order: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``ranged`` with ``_reach``: the largest ``col`` over smaller values of the group, null for the first."""
    earlier = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_reach", F.max(col).over(earlier))
    if not several:
        return local
    keys = [*by, "_part"]
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*keys).agg(F.max(col).alias("_most")).select(*(F.col(c).alias(f"_key_{c}") for c in keys), F.max("_most").over(before).alias("_carried"))
    return local.join(carried, _same(keys, "_key_")).withColumn("_reach", F.greatest("_reach", "_carried")).select(*local.columns)


def running_totals(df: DataFrame, order: str, cols: Sequence[str], by: Sequence[str] = (), keep_part: bool = False) -> DataFrame:
    """``df`` (one row per value and group) with ``below_<c>``: the sum of c over smaller values of the group.

    With ``keep_part`` the number of the value's range stays as ``_part``.
    """
    out = add_below(*ranged(df, order, by), order, cols, by)
    return out if keep_part else out.drop("_part")


def value_ranks(df: DataFrame, col: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per group and value: n, and the average rank of its rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return running_totals(counts, col, ["n"], by).select(*by, col, "n", (F.col("below_n") + (F.col("n") + 1) / 2).alias("rank"))


def avg_rank(df: DataFrame, col: str, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the average rank of ``col`` in its group; nulls stay null."""
    ranks = value_ranks(df, col, by).select(*by, col, F.col("rank").alias(name))
    return df.join(ranks, [*by, col], "left").select(*df.columns, name)


def rank_norm(df: DataFrame, col: str, name: str = "rank_norm", by: Sequence[str] = ()) -> DataFrame:
    """Average ranks scaled to [0, 1]; a group of one value keeps its rank."""
    ranked = avg_rank(df, col, "_rank", by)
    sizes = df.groupBy(*by).agg(F.count(col).alias("_n"))
    both = ranked.join(sizes, list(by)) if by else ranked.join(F.broadcast(sizes))
    return both.withColumn(name, F.when(F.col("_n") <= 1, F.col("_rank")).otherwise((F.col("_rank") - 1) / (F.col("_n") - 1))).drop("_rank", "_n")


def zscore(df: DataFrame, col: str, name: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / sample sd of the group; 0 where the sd is 0 or unknown."""
    return zscores(df, {name: col}, by)


def zscores(df: DataFrame, cols: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``zscore`` of several columns from one pass: ``cols`` names the new ones.

    Moments of groups are written first, so Spark knows their size: few groups are broadcast, and their rows stay where they are.
    """
    moments = df.groupBy(*by).agg(*(f(c).alias(f"_{m}_{n}") for n, c in cols.items() for m, f in (("m", F.avg), ("s", F.stddev_samp))))
    both = df.join(staged(moments, "moments"), list(by)) if by else df.join(F.broadcast(moments))
    z = lambda n, c: F.when(F.coalesce(F.col(f"_s_{n}"), F.lit(0.0)) == 0, F.when(F.col(c).isNotNull(), 0.0)).otherwise((F.col(c) - F.col(f"_m_{n}")) / F.col(f"_s_{n}"))
    return both.withColumns({n: z(n, c) for n, c in cols.items()}).drop(*(f"_{m}_{n}" for n in cols for m in "ms"))


def sample_order(key: Column, seed: int = 42) -> Column:
    """A repeatable random order of keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def sample_k(df: DataFrame, k: int, key: str, seed: int = 42, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """``k`` rows by hash order (of each group, if ``by``); an error if there are fewer and ``strict``.

    Of a group, only rows whose hash lies below a share that surely holds ``k`` of them are put in order, with a second
    look at all rows of a group where it does not.
    """
    ordered = df.withColumn("_order", sample_order(F.col(key), seed))
    if by:
        same = functools.reduce(lambda u, v: u & v, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by])
        sizes = df.groupBy(*(F.col(c).alias(f"_key_{c}") for c in by)).agg(F.count("*").alias("_size"))
        place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / 2.0**32
        low = ordered.join(sizes, same).where(place <= (k + 8 * k**0.5 + 32) / F.col("_size")).drop(*(f"_key_{c}" for c in by))
        short = low.groupBy(*(F.col(c).alias(f"_key_{c}") for c in by), "_size").agg(F.count("*").alias("_got")).where(F.col("_got") < F.least(F.lit(k), F.col("_size")))
        none = sizes.join(low.select(*(F.col(c).alias(f"_low_{c}") for c in by)).distinct(), functools.reduce(lambda u, v: u & v, [F.col(f"_key_{c}").eqNullSafe(F.col(f"_low_{c}")) for c in by]), "left_anti")
        again = staged(short.drop("_size", "_got").unionByName(none.drop("_size")), "short")
        if not again.isEmpty():
            low = low.join(again, same, "left_anti").unionByName(ordered.join(again, same, "left_semi"), allowMissingColumns=True)
        ranked = low.drop("_size").withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_order", key)))
        return ranked.where(F.col("_n") <= k).drop("_order", "_n")
    if strict and df.limit(k).count() < k:
        raise ValueError(f"fewer than {k} rows to sample from")
    return ordered.orderBy("_order", key).limit(k).drop("_order")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. Spark keeps one row per key and task before the shuffle (a window group limit), so a frequent key is not sorted in one task."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def number_rows(df: DataFrame, order: str | Sequence[str], name: str = "number") -> DataFrame:
    """1, 2, 3, ... by one or several columns that are unique together, without one task for all rows."""
    cols = [order] if isinstance(order, str) else list(order)
    placed = df.withColumns({"_one": F.lit(1), "_order": F.struct(*cols)})
    return running_totals(placed, "_order", ["_one"]).withColumn(name, F.col("below__one") + 1).drop("_one", "_order", "below__one")
