"""Interval operators. Intervals are half-open: chrom, start, end; two overlap if they share a base.

An overlap join turns into an equi-join on cells. Bins come in levels, each ``FACTOR`` times as
wide as the one before; an interval is at home at the first level where it is no longer than
``SPAN`` bins, so in at most five of them, and is a guest in the bins that it touches at those
wider levels at which the other side has homes; guests meet homes only. A pair meets at the wider of its two
levels, in the bin of its overlap's start. Cells with many rows of a side are dealt out: that
side's rows by hash, the other's repeated, so a pile-up or the rows under a contig-long
interval are spread over tasks.

Counts, sums and means over overlapping rows need no pairs: they are differences of running
totals at an interval's two ends.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..sources.staging import staged
from .binning import add_below, add_reach, ranged, running_totals
from .cells import NARROW, WIDE, longest, overlap_values, profiles, shared_parts

BIN = 1 << 14
FACTOR = 4
LEVELS = 16
#: Bin widths that an interval may have at its home level.
SPAN = 4
#: Rows of one side of a cell that are kept together.
CELL_ROWS = 1 << 18
#: Rows up to which ``max_signal`` joins blocks, without Python workers: each row becomes one for each level.
JOIN_ROWS = 1 << 16


def center(df: DataFrame) -> DataFrame:
    """Each interval's midpoint as an interval of one base."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    return df.withColumns({"start": mid, "end": mid + 1})


def slop(df: DataFrame, before: int, sizes: DataFrame | int, after: int | None = None) -> DataFrame:
    """Intervals widened on both sides, within [0, contig size]; ``sizes`` has chrom, size or is one size for all."""
    after = before if after is None else after
    if isinstance(sizes, int):
        known, size = df, F.lit(sizes)
    else:
        known, size = df.join(sizes.select("chrom", F.col("size").alias("_size")), "chrom"), F.col("_size")
    wide = known.withColumns({"start": F.greatest(F.lit(0), F.col("start") - before).cast("long"), "end": F.least(size, F.col("end") + after).cast("long")})
    return wide.select(*df.columns)


def tile(df: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Sequence rows (chrom, start, seq) cut into whole tiles; a part at the end is dropped.

    Chunks of a contig must start at multiples of ``size`` for tiles to run on across them.
    """
    pieces = F.regexp_extract_all(seq, F.lit(f"(?s).{{{size}}}"), F.lit(0))  # one pass over the sequence, however long it is
    cut = df.select("chrom", F.col("start").alias("_at"), F.posexplode(pieces).alias("k", "_piece"))
    return cut.select("chrom", (F.col("_at") + F.col("k") * size).alias("start"), (F.col("_at") + (F.col("k") + 1) * size).alias("end"), F.col("_piece").alias("seq"))


def _touched(width: Column) -> Column:
    """Numbers of the bins of this width that an interval touches."""
    return F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width))


def _level(width: int) -> Column:
    """The first level where the interval is no longer than ``SPAN`` bins."""
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    return sum((F.when(length > SPAN * width * FACTOR**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))


def _cells(df: DataFrame, width: int, own: Sequence[int], others: Sequence[int], side: int) -> DataFrame:
    """Rows repeated for each cell (``_lvl``, ``_bin``, ``_role``) that they are listed in; ``own`` and ``others`` are the levels of both sides.

    Role 0 is for pairs of one level, role 1 + side for this side's wider rows against narrower ones of the other,
    role 2 - side the other way round; so two rows that are both narrower than a cell never meet in it.
    """
    listed = []
    for k in sorted({*own, *others}):
        roles = [0] * (k in own and k in others) + [1 + side] * (k in own and any(o < k for o in others))
        listed += [(k, F.col("_level") == k, role) for role in roles]
        if k in others and any(o < k for o in own):
            listed.append((k, F.col("_level") < k, 2 - side))
    if not listed:
        return df.where("false").select("*", *(F.lit(0).alias(c) for c in ("_lvl", "_bin", "_role")))
    if len(listed) == 1 and len(own) == 1:
        k, _, role = listed[0]
        return df.select("*", F.lit(k).alias("_lvl"), F.explode(_touched(F.lit(width * FACTOR**k))).alias("_bin"), F.lit(role).alias("_role"))
    places = F.array(*(F.when(here, F.struct(F.lit(k).alias("_lvl"), _touched(F.lit(width * FACTOR**k)).alias("_bins"), F.lit(role).alias("_role"))) for k, here, role in listed))
    at = df.withColumn("_level", _level(width)).select(*df.columns, F.explode(places).alias("_at")).where("_at is not null")
    return at.select(*df.columns, "_at._lvl", F.explode("_at._bins").alias("_bin"), "_at._role")


CELL = ("_lvl", "_bin", "_role")


def _dealt(sides: Sequence[DataFrame]) -> list[DataFrame]:
    """Both sides with the parts ``_i`` and ``_j`` of a cell: a side's rows have one part of their own and are repeated for each of the other's."""
    keys = ["chrom", *CELL]
    counts = [x.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > CELL_ROWS) for x in sides]
    parts = [c.select(*keys, F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias(p)) for c, p in zip(counts, ("_pi", "_pj"), strict=True)]
    hot = staged(parts[0].join(parts[1], keys, "full"), "hot")
    if hot.isEmpty():
        return [x.withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for x in sides]
    out = []
    for x, own, other in zip(sides, ("_i", "_j"), ("_j", "_i"), strict=True):
        known = x.join(hot, keys, "left").withColumns({p: F.coalesce(p, F.lit(1)) for p in ("_pi", "_pj")})
        mine = F.pmod(F.xxhash64(*x.columns), F.col(f"_p{own[-1]}")).cast("int")
        out.append(known.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"_p{other[-1]}") - 1))).select(*x.columns, "_i", "_j"))
    return out


def _levels(sides: Sequence[DataFrame], width: int) -> list[dict[int, int]]:
    """Rows of each side at each level, from one pass."""
    held = sides[0].select(_level(width).alias("k"), F.lit(0).alias("side")).unionByName(sides[1].select(_level(width).alias("k"), F.lit(1).alias("side")))
    found = held.groupBy("side", "k").count().collect()
    return [{r["k"]: r["count"] for r in found if r["side"] == s} for s in (0, 1)]


def overlap_pairs(a: DataFrame, b: DataFrame, width: int = BIN, suffixes: Sequence[str] = ("_a", "_b")) -> DataFrame:
    """One row per overlapping pair: all columns of both sides with suffixes, and overlap_bp.

    Of a stream no counts are known, so the other side is listed at all levels where the stream may have homes, and cells stay whole.
    Sides are not broadcast: their rows are repeated for each cell, which Spark's estimates of sizes do not count.
    """
    given = [df.where(F.col("chrom").isNotNull() & (F.col("start") < F.col("end"))) for df in (a, b)]
    stream = a.isStreaming or b.isStreaming
    found = [dict.fromkeys(range(LEVELS + 1), 0) if df.isStreaming else None for df in given] if stream else _levels(given, width)
    found = [x if x is not None else {r["k"]: 0 for r in df.select(_level(width).alias("k")).distinct().collect()} for x, df in zip(found, given, strict=True)]
    sides = [_cells(df, width, [*found[k]], [*found[1 - k]], k) for k, df in enumerate(given)]
    few = stream or all(sum(x.values()) <= CELL_ROWS for x in found)
    dealt = [x.withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for x in sides] if few else _dealt(sides)
    x, y = (df.toDF(*(f"{c}{s}" for c in df.columns)) for df, s in zip(dealt, suffixes, strict=True))
    p, q = suffixes
    low, high = F.greatest(f"start{p}", f"start{q}"), F.least(f"end{p}", f"end{q}")
    same = functools.reduce(lambda u, v: u & v, [F.col(f"{c}{p}") == F.col(f"{c}{q}") for c in ("chrom", *CELL, "_i", "_j")])
    bin_width = F.lit(width) * F.pow(F.lit(float(FACTOR)), F.col(f"_lvl{p}"))
    met = (low < high) & (F.floor(low / bin_width) == F.col(f"_bin{p}"))
    return x.join(y.hint("merge"), same & met).withColumn("overlap_bp", high - low).drop(*(f"{c}{s}" for c in (*CELL, "_i", "_j") for s in suffixes))


def overlap_sums(a: DataFrame, b: DataFrame, sums: dict[str, Column], by: Sequence[str] = ("chrom",)) -> DataFrame:
    """Each distinct row of ``a`` with sums over the rows of ``b`` that it overlaps, 0 if none.

    Rows overlap only if they agree in ``by``. Of all rows of b, those that start before an interval's end less those
    that end by its start overlap it: two running totals, over the rows' and the intervals' ends, and no pairs. Sums
    should be of whole numbers or decimals, which differences keep exact.
    """
    names, full = list(sums), F.col("start") < F.col("end")
    live = b.where(full).select(*by, "start", "end", *(v.alias(f"_sum_{c}") for c, v in sums.items()))
    ends = [F.struct(F.col(e).alias("_at"), *((F.col(f"_sum_{c}") if e == side else F.lit(0) * F.col(f"_sum_{c}")).alias(f"_{side}_{c}") for side in ("start", "end") for c in names)) for e in ("start", "end")]
    asked = a.select("*", F.inline(F.array(F.struct(F.col("end").alias("_at"), F.lit(True).alias("_upper")), F.struct(F.col("start").alias("_at"), F.lit(False).alias("_upper")))))
    marks = live.select(*by, F.inline(F.array(*ends))).unionByName(asked.select(*by, "_at"), allowMissingColumns=True)
    cols = [f"_{side}_{c}" for side in ("start", "end") for c in names]
    points = marks.groupBy(*by, "_at").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols))
    placed = running_totals(points, "_at", cols, by)
    told = placed.select(*by, "_at", *(F.col(f"below__start_{c}").alias(f"_below_{c}") for c in names), *((F.col(f"below__end_{c}") + F.col(f"_end_{c}")).alias(f"_upto_{c}") for c in names))
    found = asked.join(told, [*by, "_at"], "left")
    part = lambda c: F.when(full & F.col("_upper"), F.col(f"_below_{c}")).when(full, -F.col(f"_upto_{c}"))
    return found.groupBy(*a.columns).agg(*(F.coalesce(F.sum(part(c)), F.lit(0)).alias(c) for c in names))


def overlap_totals(a: DataFrame, b: DataFrame, key: Sequence[str], sums: dict[str, Column], by: Sequence[str] = ("chrom",)) -> DataFrame:
    """All rows of ``a`` with the sums of ``overlap_sums``; ``key`` tells rows of ``a`` apart, so the other columns need not be shuffled with the ends."""
    got = overlap_sums(a.select(*dict.fromkeys([*key, *by, "start", "end"])), b, sums, by)
    same = functools.reduce(lambda u, v: u & v, [F.col(k) == F.col(f"_key_{k}") for k in key])
    return a.drop(*sums).join(got.select(*(F.col(k).alias(f"_key_{k}") for k in key), *(F.col(c).alias(f"_got_{c}") for c in sums)), same, "left").select(*(c for c in a.columns if c not in sums), *(F.coalesce(f"_got_{c}", F.lit(0)).alias(c) for c in sums))


def key_only(key: Sequence[str], by: Sequence[str]) -> list[str]:
    return [k for k in key if k not in by]


def overlap_count(a: DataFrame, b: DataFrame, key: Sequence[str], name: str = "n_overlaps", by: Sequence[str] = ("chrom",)) -> DataFrame:
    """All rows of ``a`` with how many rows of ``b`` they overlap; ``key`` tells rows of ``a`` apart."""
    return overlap_totals(a, b, key, {name: F.lit(1).cast("long")}, by)


def _hit_keys(a: DataFrame, b: DataFrame, key: Sequence[str], width: int) -> DataFrame:
    """Keys of the rows of ``a`` that overlap ``b``, whose rows are merged first: a row then meets few islands, however deep they pile up."""
    islands = staged(merge(b.select("chrom", "start", "end")).select("chrom", "start", "end"), "islands")
    pairs = overlap_pairs(a.select(*dict.fromkeys([*key, "chrom", "start", "end"])), islands, width)
    return pairs.select(*(F.col(f"{k}_a").alias(k) for k in key)).distinct()


def overlap_semi(a: DataFrame, b: DataFrame, key: Sequence[str], width: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap some row of ``b``, each once."""
    return a.join(_hit_keys(a, b, key, width), list(key), "left_semi")


def overlap_anti(a: DataFrame, b: DataFrame, key: Sequence[str], width: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap no row of ``b``."""
    return a.join(_hit_keys(a, b, key, width), list(key), "left_anti")


def overlap_flags(a: DataFrame, lists: dict[str, DataFrame], key: Sequence[str], width: int = BIN) -> DataFrame:
    """``a`` with a boolean per named list: whether it overlaps some row of that list."""
    for name, b in lists.items():
        a = a.join(_hit_keys(a, b, key, width).withColumn(name, F.lit(True)), list(key), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return a


def exclude_with_reasons(a: DataFrame, lists: dict[str, DataFrame], key: Sequence[str], width: int = BIN) -> tuple[DataFrame, DataFrame]:
    """Rows free of all lists, and how many rows each combination of lists dropped (reason ``kept`` for none)."""
    flagged = overlap_flags(a, lists, key, width)
    reason = F.array_join(F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in lists)), lambda x: x.isNotNull()), "+")
    named = flagged.withColumn("reason", F.when(reason == "", "kept").otherwise(reason))
    return named.where("reason = 'kept'").select(*a.columns), named.groupBy("reason").agg(F.count("*").alias("n"))


def intersect(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """The shared part of each overlapping pair: chrom, start, end, and all columns of both with suffixes."""
    pairs = overlap_pairs(a, b, width)
    return pairs.withColumns({"chrom": F.col("chrom_a"), "start": F.greatest("start_a", "start_b"), "end": F.least("end_a", "end_b")})


def intersect_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each distinct part that the rows of a key of ``a`` share with rows of ``b``: the key, chrom, start, end.

    Equal parts meet in the cell that holds their first base and are told apart there, so neither pairs nor parts are shuffled
    or sorted; parts longer than any cell are taken from pairs.
    """
    most = min(longest(a), longest(b))
    if most > WIDE:
        return intersect(a.select(key, "chrom", "start", "end"), b.select("chrom", "start", "end")).select(F.col(f"{key}_a").alias(key), "chrom", "start", "end").distinct()
    return shared_parts(a, b, key, max(NARROW, 1 << (most - 1).bit_length()))


def _dyadic(start: Column, end: Column) -> Column:
    """The blocks (level, block of 2^level bases) that make up [start, end): at most two of a level."""
    top = F.when(end > start, F.floor(F.log2((end - start).cast("double"))).cast("int") + 1).otherwise(0)

    def at_level(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k).cast("long")
        low, high = F.ceil(start / width), F.floor(end / width)
        cell = lambda b: F.struct(k.alias("_lvl"), b.cast("long").alias("_block"))
        return F.array(F.when((low < high) & (low % 2 != 0), cell(low)), F.when((low < high) & (high % 2 != 0), cell(high - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), at_level)), lambda x: x.isNotNull())


def _holding(at: Column, levels: int) -> Column:
    """The block of each level 0..levels that holds a base."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("_lvl"), F.floor(at / F.pow(F.lit(2.0), k).cast("long")).alias("_block")))


def max_signal(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """For each key of ``a`` that overlaps ``b``: sum, mean, max and count of ``value``, and bases shared.

    No pairs are made. A row of b overlaps an interval if it starts in it, or before it and reaches over its first base. For the first,
    rows of b are summed up by blocks of 2^k bases that hold their starts, and an interval is a few such blocks; for
    the second, rows of b are such blocks themselves, and an interval's first base is in one of each level. Of more than
    ``JOIN_ROWS`` rows the blocks are trees within cells of the contig, if no interval is longer than a cell and values are floating; else they are joined.
    """
    live = [df.where(F.col("chrom").isNotNull() & (F.col("start") < F.col("end"))) for df in (a.select(*dict.fromkeys([*key, "chrom", "start", "end"])), b.select("chrom", "start", "end", F.col(value).alias("_v")))]
    x, y = live
    found = [df.agg(F.max(F.col("end") - F.col("start")), F.count("*")).first() for df in live]
    sizes, kind = [r[0] or 1 for r in found], y.schema["_v"].dataType
    if sum(r[1] for r in found) > JOIN_ROWS and max(sizes) <= WIDE and kind.typeName() in ("double", "float"):
        cells = overlap_values(x, y, key, max(sizes))
        keys = [F.col(f"_key_{i}").alias(k) for i, k in enumerate(key)]
        return cells.groupBy(*keys).agg(F.sum("_sum").alias("signal_sum"), (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("signal_mean"), F.max("_max").cast(kind).alias("signal_max"), F.sum("_rows").alias("n_peaks"), F.sum("_bp").alias("overlap_bp"))
    levels = [int(n).bit_length() for n in sizes]
    starts = y.select("chrom", "_v", F.lit(0).alias("_kind"), F.inline(_holding(F.col("start"), levels[0])))
    reach = y.select("chrom", "_v", F.lit(1).alias("_kind"), F.inline(_dyadic(F.col("start") + 1, F.col("end"))))
    cell = ["chrom", "_kind", "_lvl", "_block"]
    known = starts.unionByName(reach).groupBy(*cell).agg(F.sum("_v").alias("_sum"), F.max("_v").alias("_max"), F.count("_v").alias("_n"), F.count("*").alias("_rows"))
    names = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)]
    inside = x.select(*names, "chrom", F.lit(0).alias("_kind"), F.inline(_dyadic(F.col("start"), F.col("end"))))
    over = x.select(*names, "chrom", F.lit(1).alias("_kind"), F.inline(_holding(F.col("start"), levels[1])))
    found = inside.unionByName(over).join(known.hint("merge"), cell).groupBy(*(f"_key_{i}" for i in range(len(key)))).agg(*(f(c).alias(c) for f, c in ((F.sum, "_sum"), (F.max, "_max"), (F.sum, "_n"), (F.sum, "_rows"))))
    ends = F.inline(F.array(*(F.struct(F.col(e).alias("_at"), F.lit(w).alias("_sign")) for e, w in (("end", 1), ("start", -1)))))
    shared = track_totals(y.select("chrom", "start", "end", F.lit(1.0).alias("value")), x.select(*names, "chrom", ends))
    bases = shared.groupBy(*(f"_key_{i}" for i in range(len(key)))).agg(F.sum(F.col("_sign") * F.col("_total")).cast("long").alias("overlap_bp"))
    both = found.join(bases, [f"_key_{i}" for i in range(len(key))])
    return both.select(*(F.col(f"_key_{i}").alias(k) for i, k in enumerate(key)), F.col("_sum").alias("signal_sum"), (F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))).alias("signal_mean"), F.col("_max").alias("signal_max"), F.col("_rows").alias("n_peaks"), "overlap_bp")


def merge(df: DataFrame, by: Sequence[str] = ("chrom",), width: int = 1 << 20) -> DataFrame:
    """Islands of intervals that overlap or touch: the ``by`` columns, start, end, n_merged.

    Intervals are first merged within blocks of ``width`` bases. What is left has one row per start, which goes into ranges of starts;
    the furthest end of earlier ranges and the number of islands in them are carried on, so no task needs a contig.
    """
    by = list(by)
    blocks = df.select(*by, "start", "end").withColumn("_block", F.floor(F.col("start") / width))
    order = Window.partitionBy(*by, "_block").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    local = blocks.withColumn("_island", island).groupBy(*by, "_block", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged"))
    placed, several = ranged(local.select(*by, "start", "end", "n_merged"), "start", by)
    reached = add_reach(placed, several, "start", "end", by).withColumn("_new", F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1))
    numbered = add_below(reached, several, "start", ["_new"], by).withColumn("_island", F.col("below__new") + F.col("_new"))
    return numbered.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_merged").alias("n_merged")).drop("_island")


def remap(df: DataFrame, blocks: DataFrame, key: Sequence[str], width: int = BIN) -> tuple[DataFrame, DataFrame]:
    """Coordinates moved by block pairs (chrom, start, end, to_chrom, to_start); and the rows that no block covers whole."""
    pairs = overlap_pairs(df, blocks, width).where("start_a >= start_b and end_a <= end_b")
    shift = F.col("to_start_b") - F.col("start_b")
    first = Window.partitionBy(*(f"{k}_a" for k in key)).orderBy("start_b", "to_chrom_b")
    one = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    moved = {"chrom": F.col("to_chrom_b"), "start": F.col("start_a") + shift, "end": F.col("end_a") + shift}
    mapped = one.select(*(moved.get(c, F.col(f"{c}_a")).alias(c) for c in df.columns))
    return mapped, df.join(one.select(*(F.col(f"{k}_a").alias(k) for k in key)), list(key), "left_anti")


def track_totals(track: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (chrom, _at and more) with ``_total``: the track's values summed over the bases before ``_at``, and ``_covered``: those of them under a row of value other than 0.

    Between two neighbouring ends the sum of the rows that lie over a base is the same, so both are running totals over ends.
    """
    live = track.where((F.col("start") < F.col("end")) & (F.col("value") != 0)).select("chrom", "start", "end", F.col("value").cast("double").alias("v"))
    ends = F.array(F.struct(F.col("start").alias("_at"), F.col("v").alias("dv"), F.lit(1).alias("dn")), F.struct(F.col("end").alias("_at"), (-F.col("v")).alias("dv"), F.lit(-1).alias("dn")))
    marks = live.select("chrom", F.inline(ends)).unionByName(asked.select("chrom", "_at"), allowMissingColumns=True)
    points = marks.groupBy("chrom", "_at").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dv", "dn")))
    placed, several = ranged(points, "_at", ["chrom"])
    over = add_below(placed, several, "_at", ["dv", "dn"], ["chrom"], last="_last")
    gap = F.when(F.col("below_dn") > 0, F.col("_at") - F.col("_last")).otherwise(0)
    steps = over.select("chrom", "_part", "_at", (gap * F.col("below_dv")).alias("area"), gap.alias("bases"))
    totals = add_below(steps, several, "_at", ["area", "bases"], ["chrom"])
    told = totals.select("chrom", "_at", (F.col("below_area") + F.col("area")).alias("_total"), (F.col("below_bases") + F.col("bases")).alias("_covered"))
    return asked.join(told.hint("merge"), ["chrom", "_at"])  # ``asked`` is made by explode, so an estimate of its size is too low to broadcast it by


def signal_mean(windows: DataFrame, track: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every window with the mean of a track (chrom, start, end, value) over its bases; uncovered bases count as 0."""
    live = windows.where(F.col("start") < F.col("end"))
    asked = live.select("chrom", *key_only(key, ["chrom"]), F.inline(F.array(*(F.struct(F.col(e).alias("_at"), F.lit(w).alias("_sign")) for e, w in (("end", 1), ("start", -1))))))
    found = track_totals(track, asked)
    sums = found.groupBy(*(F.col(k).alias(f"_key_{k}") for k in key)).agg(*(F.sum(F.col("_sign") * F.col(c)).alias(c) for c in ("_total", "_covered")))
    out = windows.join(sums, functools.reduce(lambda u, v: u & v, [F.col(k) == F.col(f"_key_{k}") for k in key]), "left")
    return out.select(*(c for c in windows.columns if c != "signal"), F.when(F.col("_covered") > 0, F.col("_total") / (F.col("end") - F.col("start"))).otherwise(0.0).alias("signal"))


def metaprofile(points: DataFrame, track: DataFrame, flank: int, step: int, by: str, key: str) -> DataFrame:
    """Mean signal by group and bin around points (chrom, pos, strand): group, bin, n, signal.

    Points without any signal are left out; bins of minus-strand points run backwards. A bin's signal is the
    difference of the track's running totals at its two edges: of more than ``JOIN_ROWS`` edges it is added up in cells of the contig, so a point
    is a row for each cell that it touches; else edges are joined, without Python workers.
    """
    n_bins = 2 * flank // step
    held = staged(points.select("chrom", "pos", "strand", by, key), "points")
    if held.count() * (n_bins + 1) > JOIN_ROWS:
        found = staged(profiles(held, track, flank, step, by, key), "profiles")
        members, sums = found.where("bin is null"), found.where("bin is not null").withColumnRenamed("_s", "_v")
    else:
        asked = held.select("chrom", key, by, "strand", F.col("pos").alias("_pos"), F.explode(F.sequence(F.lit(0), F.lit(n_bins))).alias("_edge")).withColumn("_at", F.col("_pos") - flank + F.col("_edge") * step)
        found = track_totals(track, asked)
        sides = F.array(F.struct((F.col("_edge") - 1).alias("_bin"), F.lit(1).alias("_sign")), F.struct(F.col("_edge").alias("_bin"), F.lit(-1).alias("_sign")))
        bins = found.select(key, by, "strand", "_total", "_covered", F.inline(sides)).where(f"_bin between 0 and {n_bins - 1}")
        at = F.when(F.col("strand") == "-", n_bins - 1 - F.col("_bin")).otherwise(F.col("_bin")).cast("long")
        found = bins.groupBy(key, by, at.alias("bin")).agg((F.sum(F.col("_sign") * F.col("_total")) / step).alias("_v"), F.sum(F.col("_sign") * F.col("_covered")).alias("_c")).where("_c > 0")
        members = sums = found
    members = members.groupBy(by).agg(F.count_distinct(key).alias("n"))
    sums = sums.groupBy(by, "bin").agg(F.sum("_v").alias("_s"))
    grid = members.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return grid.join(sums, [by, "bin"], "left").select(by, "bin", "n", (F.coalesce("_s", F.lit(0.0)) / F.col("n")).alias("signal"))


def sort_bed(df: DataFrame) -> DataFrame:
    return df.orderBy("chrom", "start", "end")


def extract_seq(intervals: DataFrame, chunks: DataFrame, key: Sequence[str], width: int = BIN) -> DataFrame:
    """``intervals`` with ``seq``, put together from sequence chunks (chrom, start, seq) that they overlap.

    Minus-strand intervals (column ``strand``, if there is one) are read backwards and complemented. An interval
    that the chunks do not cover whole has a null sequence.
    """
    pieces = chunks.select("chrom", "start", (F.col("start") + F.length("seq")).alias("end"), "seq")
    pairs = overlap_pairs(intervals.select(*dict.fromkeys([*key, "chrom", "start", "end"])), pieces, width)
    low = F.greatest("start_a", "start_b")
    part = F.substr("seq_b", (low - F.col("start_b") + 1).cast("int"), F.col("overlap_bp").cast("int"))
    joined = pairs.groupBy(*(F.col(f"{k}_a").alias(f"_key_{k}") for k in key)).agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("piece")))).alias("_p"))
    both = intervals.join(joined, functools.reduce(lambda u, v: u & v, [F.col(k) == F.col(f"_key_{k}") for k in key]), "left")
    seq = F.array_join(F.transform("_p", lambda x: x["piece"]), "")
    if "strand" in intervals.columns:
        seq = F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq)
    whole = F.length(seq) == F.col("end") - F.col("start")
    return both.select(*(c for c in intervals.columns if c != "seq"), F.when(whole, seq).alias("seq"))
