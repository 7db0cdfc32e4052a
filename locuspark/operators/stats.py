"""Grouped tests and models.

Spark computes the sufficient statistics: value histograms, rank sums, moments, counts. Tail
probabilities are taken on the few result rows that remain (``with_p``).
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import pvalues
from ..sources.staging import staged
from .binning import running_totals, value_ranks


def with_p(df: DataFrame, name: str, fn: Callable[..., float | None], *cols: str) -> DataFrame:
    """Append ``fn`` of some columns of a small result; null where an argument is null."""

    @F.pandas_udf("double")
    def tail(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in x) else fn(*x) for x in zip(*args, strict=True)], dtype="float64")

    return df.withColumn(name, tail(*cols))


def mann_whitney(df: DataFrame, col: str, group: str, a: str, b: str, by: Sequence[str] = (), alternative: str = "two-sided") -> DataFrame:
    """n_a, n_b, u (of a), ties, rank_biserial = 1 - 2u/(n_a n_b) and p_value of two groups; null without rows of both."""
    rows = df.where(F.col(col).isNotNull() & F.col(group).isin(a, b))
    hist = rows.groupBy(*by, col).agg(F.count_if(F.col(group) == a).alias("na"), F.count("*").alias("n"))
    low = running_totals(hist, col, ["n"], by)
    n = F.col("n").cast("double")
    out = low.groupBy(*by).agg(F.sum("na").alias("n_a"), (F.sum("n") - F.sum("na")).alias("n_b"), F.sum(F.col("na") * (F.col("below_n") + (n + 1) / 2)).alias("_r"), F.sum(n * n * n - n).alias("ties"))
    pairs = F.col("n_a").cast("double") * F.col("n_b")
    out = out.withColumn("u", F.when(pairs > 0, F.col("_r") - F.col("n_a").cast("double") * (F.col("n_a") + 1) / 2)).drop("_r")
    out = out.withColumn("rank_biserial", 1 - 2 * F.col("u") / F.nullif(pairs, F.lit(0.0)))
    return with_p(out, "p_value", lambda u, x, y, t: pvalues.mann_whitney_p(u, int(x), int(y), t, alternative), "u", "n_a", "n_b", "ties")


def kruskal(df: DataFrame, col: str, group: str, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """n, groups, tie-corrected h and p_value; groups of under ``least`` values take no part."""
    rows = df.where(F.col(col).isNotNull() & F.col(group).isNotNull())
    if least > 1:
        rows = rows.join(rows.groupBy(*by, group).agg(F.count("*").alias("_c")).where(F.col("_c") >= least).select(*by, group), [*by, group], "left_semi")
    cells = rows.groupBy(*by, group, col).agg(F.count("*").alias("m"))
    ranks = value_ranks(cells, col, by, weight="m")
    t = F.col("n").cast("double")
    ties = ranks.groupBy(*by).agg(F.sum(t * t * t - t).alias("ties"))
    per = cells.join(ranks.select(*by, col, "rank"), [*by, col]).groupBy(*by, group).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("rank")).alias("r"))
    out = per.groupBy(*by).agg(F.sum("m").alias("n"), F.count("*").alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"))
    out = out.join(ties, list(by)) if by else out.join(F.broadcast(ties))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    return with_p(out.select(*by, "n", "groups", h.alias("h")), "p_value", lambda h, k: pvalues.chi2_sf(h, int(k) - 1) if k > 1 else None, "h", "groups")


def fisher(df: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d", alternative: str = "two-sided") -> DataFrame:
    """Odds ratio, its Woolf 95 % interval (null with an empty cell) and the exact p of 2x2 counts; one test per row."""
    w, x, y, z = (F.col(k).cast("double") for k in (a, b, c, d))
    full = (w > 0) & (x > 0) & (y > 0) & (z > 0)
    log_or = F.when(full, F.ln(w * z / (x * y)))
    se = F.when(full, F.sqrt(1 / w + 1 / x + 1 / y + 1 / z))
    out = df.withColumns({"odds_ratio": w * z / F.nullif(x * y, F.lit(0.0)), "ci_low": F.exp(log_or - 1.96 * se), "ci_high": F.exp(log_or + 1.96 * se)})
    return with_p(out, "p_value", lambda *t: pvalues.fisher_p(*map(int, t), alternative=alternative), a, b, c, d)


def chi2_contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, df, chi2 (Yates' correction if df is 1) and p_value of the r x c table of two columns."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(*by, a).agg(F.sum("o").alias("r")), cells.groupBy(*by, b).agg(F.sum("o").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("o").alias("n"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("nr")).join(cols.groupBy(*by).agg(F.count("*").alias("nc")), list(by)) if by else rows.agg(F.count("*").alias("nr")).join(cols.agg(F.count("*").alias("nc")))
    grid = rows.join(cols, list(by)) if by else rows.join(cols)
    grid = grid.join(total, list(by)).join(sizes, list(by)) if by else grid.join(total).join(sizes)
    full = grid.join(cells, [*by, a, b], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    e = F.col("r").cast("double") * F.col("c") / F.col("n")
    off = F.abs(F.col("o") - e)
    off = F.when((F.col("nr") == 2) & (F.col("nc") == 2), off - F.least(F.lit(0.5), off)).otherwise(off)
    out = full.groupBy(*by, "n", "nr", "nc").agg(F.sum(off * off / e).alias("chi2"))
    out = out.select(*by, "n", ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("df"), "chi2")
    return with_p(out, "p_value", lambda x, k: pvalues.chi2_sf(x, int(k)) if k else None, "chi2", "df")


def _rank_cells(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Distinct complete value tuples with their number of rows m and the average rank of each column."""
    rows = df.dropna(subset=list(cols))
    cells = staged(rows.groupBy(*by, *cols).agg(F.count("*").alias("m")), "cells")
    for c in cols:
        cells = cells.join(value_ranks(cells, c, by, weight="m").select(*by, c, F.col("rank").alias(f"r_{c}")), [*by, c])
    return cells


def _corr(x: Column, y: Column, w: Column) -> Column:
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    top = n * F.sum(w * x * y) - sx * sy
    return top / F.nullif(F.sqrt((n * F.sum(w * x * x) - sx * sx) * (n * F.sum(w * y * y) - sy * sy)), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """n, rho and p_value over complete pairs; null rho under ``least`` pairs."""
    cells = _rank_cells(df, [x, y], by)
    out = cells.groupBy(*by).agg(F.sum("m").alias("n"), _corr(F.col(f"r_{x}"), F.col(f"r_{y}"), F.col("m").cast("double")).alias("rho"))
    out = out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))
    return with_p(out, "p_value", lambda r, n: pvalues.correlation_p(r, int(n)), "rho", "n")


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    rows = df.dropna(subset=[x, y])
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    return with_p(out, "p_value", lambda r, n: pvalues.correlation_p(r, int(n)), "r", "n")


def partial_spearman(df: DataFrame, x: str, y: str, z: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of the ranks of x and y given those of z; p with n - 2 degrees of freedom."""
    cells, w = _rank_cells(df, [x, y, z], by), F.col("m").cast("double")
    r = {p: _corr(F.col(f"r_{p[0]}"), F.col(f"r_{p[1]}"), w) for p in ((x, y), (x, z), (y, z))}
    out = cells.groupBy(*by).agg(F.sum("m").alias("n"), r[x, y].alias("_xy"), r[x, z].alias("_xz"), r[y, z].alias("_yz"))
    rho = (F.col("_xy") - F.col("_xz") * F.col("_yz")) / F.sqrt((1 - F.col("_xz") ** 2) * (1 - F.col("_yz") ** 2))
    return with_p(out.select(*by, "n", rho.alias("rho")), "p_value", lambda r, n: pvalues.correlation_p(r, int(n)), "rho", "n")


def partial_spearman_each(df: DataFrame, x: str, ys: dict[object, str], z: str, by: Sequence[str] = (), name: str = "target") -> DataFrame:
    """``partial_spearman`` of x with each of several columns, told apart by ``name``: a row per group and column.

    Rows stay one for all columns: a value of x or z gets its ranks among the complete rows of each column from one running total.
    Ranks of the columns themselves are written first, so Spark knows their size: few values are broadcast.
    """
    cols = [f"_y{k}" for k in range(len(ys))]
    rows = staged(df.where(F.col(x).isNotNull() & F.col(z).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(z).alias("_z"), *(F.col(y).alias(c) for c, y in zip(cols, ys.values(), strict=True))), "rows")
    ranked = rows
    for c in ("_x", "_z"):
        counts = rows.groupBy(*by, c).agg(*(F.count(y).alias(f"_n{y}") for y in cols))
        below = running_totals(counts, c, [f"_n{y}" for y in cols], by)
        ranked = ranked.join(below.select(*by, c, *((F.col(f"below__n{y}") + (F.col(f"_n{y}") + 1) / 2).alias(f"{c}{y}") for y in cols)), [*by, c])
    for y in cols:
        own = staged(value_ranks(rows, y, by).select(*by, y, F.col("rank").alias(f"_r{y}")), "ranks")
        ranked = ranked.join(own, [*by, y], "left")
    w = {y: F.when(F.col(y).isNotNull(), 1.0) for y in cols}
    pairs = {y: {"_xy": (f"_x{y}", f"_r{y}"), "_xz": (f"_x{y}", f"_z{y}"), "_yz": (f"_r{y}", f"_z{y}")} for y in cols}
    sums = ranked.groupBy(*by).agg(*(F.count(y).alias(f"_n{y}") for y in cols), *(_corr(F.col(a), F.col(b), w[y]).alias(f"{c}{y}") for y in cols for c, (a, b) in pairs[y].items()))
    told = F.array(*(F.struct(F.lit(n).alias(name), F.col(f"_n{y}").alias("n"), *(F.col(f"{c}{y}").alias(c) for c in ("_xy", "_xz", "_yz"))) for n, y in zip(ys, cols, strict=True)))
    out = sums.select(*by, F.inline(told)).where("n > 0")
    rho = (F.col("_xy") - F.col("_xz") * F.col("_yz")) / F.sqrt((1 - F.col("_xz") ** 2) * (1 - F.col("_yz") ** 2))
    return with_p(out.select(*by, name, "n", rho.alias("rho")), "p_value", lambda r, n: pvalues.correlation_p(r, int(n)), "rho", "n")


def bh_adjust(df: DataFrame, p: str = "p_value", family: Sequence[str] = (), name: str = "p_adj", null_as_one: bool = True) -> DataFrame:
    """Benjamini-Hochberg within each family; null p count as 1, or stay null and do not count.

    Works on the distinct p of a family: equal p share the largest rank. The least of p * m / rank
    over larger p is taken within ranges of p, and over ranges from their own least values.
    """
    value = F.coalesce(F.col(p), F.lit(1.0)) if null_as_one else F.col(p)
    x = df.withColumn("_p", value)
    counts = x.where(F.col("_p").isNotNull()).groupBy(*family, "_p").agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, "_p", ["_n"], family, keep_part=True)
    size = counts.groupBy(*family).agg(F.sum("_n").alias("_m"))
    size = size.select(*(F.col(c).alias(f"_key_{c}") for c in family), "_m")
    ranked = ranked.join(size, functools.reduce(lambda u, v: u & v, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in family])).drop(*(f"_key_{c}" for c in family)) if family else ranked.join(F.broadcast(size))
    ranked = ranked.withColumn("_q", F.col("_p") * F.col("_m") / (F.col("below__n") + F.col("_n")))
    later = Window.partitionBy(*family).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranked.groupBy(*family, "_part").agg(F.min("_q").alias("_low")).select(*(F.col(c).alias(f"_in_{c}") for c in (*family, "_part")), F.min("_low").over(later).alias("_later"))
    within = Window.partitionBy(*family, "_part").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    least = ranked.withColumn("_w", F.min("_q").over(within)).join(ranges, functools.reduce(lambda u, v: u & v, [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in (*family, "_part")]))
    adjusted = least.select(*(F.col(c).alias(f"_key_{c}") for c in (*family, "_p")), F.least("_w", "_later", F.lit(1.0)).alias("_adj"))
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in (*family, "_p")]
    both = x.join(adjusted, functools.reduce(lambda u, v: u & v, same), "left")
    return both.select(*(c for c in df.columns if c != name), F.col("_adj").alias(name))


def pairwise_tests(df: DataFrame, col: str, group: str, groups: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Two-sided Mann-Whitney of all pairs of the listed groups, adjusted over all of them."""
    parts = [mann_whitney(df, col, group, a, b, by).withColumns({"group_a": F.lit(a), "group_b": F.lit(b)}) for a, b in itertools.combinations(groups, 2)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return bh_adjust(out)


def over_representation(query: DataFrame, background: DataFrame, sets: DataFrame, key: str = "gene", least: int = 5, most: int = 500) -> DataFrame:
    """Sets of least..most background members against the query: counts, odds ratio, p_value (greater), p_adj."""
    pool = background.select(key).distinct().join(query.select(key).distinct().withColumn("_q", F.lit(1)), key, "left")
    n = pool.agg(F.count("*").alias("n"), F.count("_q").alias("nq"))
    per = sets.select("set_name", key).distinct().join(pool, key).groupBy("set_name").agg(F.count("*").alias("set_size"), F.count("_q").alias("a"))
    kept = per.where(F.col("set_size").between(least, most)).join(F.broadcast(n))
    cells = kept.select("set_name", "set_size", "a", (F.col("nq") - F.col("a")).alias("b"), (F.col("set_size") - F.col("a")).alias("c"), (F.col("n") - F.col("nq") - F.col("set_size") + F.col("a")).alias("d"))
    return bh_adjust(fisher(cells.where("b >= 0 and c >= 0 and d >= 0"), alternative="greater")).orderBy("p_value", "set_name")


def _design(xs: Sequence[str], interactions: Sequence[tuple[str, str]]) -> list[tuple[str, Column]]:
    return [("intercept", F.lit(1.0)), *((x, F.col(x).cast("double")) for x in xs), *((f"{a}:{b}", F.col(a).cast("double") * F.col(b).cast("double")) for a, b in interactions)]


def treatment_codes(df: DataFrame, col: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first."""
    names = [f"{col}_{v}" for v in levels[1:]]
    return df.withColumns({n: (F.col(col) == v).cast("double") for n, v in zip(names, levels[1:], strict=True)}), names


#: Groups whose triangles a task holds at a time, and parts in which a group's triangles are folded before the last.
HELD_GROUPS, FOLDS = 4096, 32


def _triangles(rows: DataFrame, by: Sequence[str], cols: Sequence[tuple[str, Column]], target: Column) -> DataFrame:
    """A few rows per group, ``_n`` and ``_c<i>``: what is left of the rows (design columns and target) after orthogonal reduction.

    A batch of a group's rows is reduced to its triangle (the R of a QR factorisation), which stands for them: rows of
    triangles are reduced again like rows of data. Squares are never formed, so columns far from 0 keep their digits.
    """
    names = [f"_c{i}" for i in range(len(cols) + 1)]
    given = rows.select(*by, F.lit(1).cast("long").alias("_n"), *(c.cast("double").alias(n) for n, c in zip(names, [c for _, c in cols] + [target], strict=True)))
    keys = [*by] or ["_all"]
    given = given if by else given.withColumn("_all", F.lit(0))
    schema = StructType([given.schema[c] for c in (*keys, "_n", *names)])

    def fold(frames):
        held: dict = {}
        for pdf in frames:
            for g, part in pdf.groupby(keys, dropna=False, sort=False):
                n, r = held.get(g, (0, np.zeros((0, len(names)))))
                held[g] = n + int(part["_n"].sum()), np.linalg.qr(np.vstack([r, part[names].to_numpy(dtype=float)]), mode="r")
            if len(held) > HELD_GROUPS:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    def told(held: dict) -> pd.DataFrame:
        out = [pd.DataFrame(r, columns=names).assign(_n=[n] + [0] * (len(r) - 1), **dict(zip(keys, g, strict=True))) for g, (n, r) in held.items()]
        return pd.concat(out)[schema.names]

    once = given.select(*schema.names).mapInPandas(fold, schema).withColumn("_part", F.spark_partition_id() % FOLDS)
    return once.repartition(*keys, "_part").drop("_part").mapInPandas(fold, schema)


def _triangle(pdf: pd.DataFrame) -> tuple[int, np.ndarray]:
    names = [c for c in pdf.columns if c.startswith("_c") and c[2:].isdigit()]
    r = np.linalg.qr(pdf[names].to_numpy(dtype=float), mode="r")
    return int(pdf["_n"].sum()), np.vstack([r, np.zeros((len(names) - len(r), len(names)))])


def _per_triangle(triangles: DataFrame, by: Sequence[str], fields: str, fit: Callable[[int, np.ndarray], list[dict]]) -> DataFrame:
    """``fit`` of each group's number of rows and triangle, as rows with the group's columns."""
    schema = StructType([triangles.schema[c] for c in by] + StructType.fromDDL(fields).fields)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | x for x in fit(*_triangle(pdf))], columns=schema.names)

    return triangles.groupBy(*(by or ["_all"])).applyInPandas(solve, schema)


def _fit(names: Sequence[str], n: int, r: np.ndarray, least: int) -> dict | None:
    """The least squares fit of the target (last column) on the first columns of a triangle; None under ``least`` rows or for a design without full rank."""
    k = len(names)
    if n < max(least, k + 1):
        return None
    top, y = r[:k, :k], r[:, -1]
    if (np.abs(np.diag(top)) <= 1e-12 * np.linalg.norm(top, axis=0)).any():
        return None
    inv = np.linalg.inv(top)
    beta = inv @ y[:k]
    rss = float((y[k:] ** 2).sum())
    tss_ = float((y[1:] ** 2).sum())  # the first column is the intercept
    se = np.sqrt((inv**2).sum(axis=1) * rss / (n - k))
    llf = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.inf
    r2 = 1 - rss / tss_ if tss_ > 0 else math.nan
    rows = [{"term": c, "coef": b, "se": s, "t": b / s if s else math.inf, "p_value": pvalues.t_two_sided(b / s, n - k) if s else 0.0} for c, b, s in zip(names, beta.tolist(), se.tolist(), strict=True)]
    return {"terms": rows, "n": n, "k": k, "rss": rss, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "llf": llf, "aic": 2 * k - 2 * llf}


def _per_group(sums: DataFrame, by: Sequence[str], fields: str, fit: Callable[[dict], list[dict]]) -> DataFrame:
    """``fit`` of each row of sums (one per group) as rows with the group's columns."""
    schema = StructType([sums.schema[c] for c in by] + StructType.fromDDL(fields).fields)

    def solve(frames):
        for pdf in frames:
            rows = [{c: r[c] for c in by} | x for r in pdf.to_dict("records") for x in fit(r)]
            yield pd.DataFrame(rows, columns=schema.names)

    return sums.mapInPandas(solve, schema)


def linear_models(df: DataFrame, y: str, xs: Sequence[str], interactions: Sequence[tuple[str, str]] = (), by: Sequence[str] = (), least: int = 20) -> DataFrame:
    """One least squares fit per group from one pass: a row per group and term.

    term, coef, se, t, p_value and the model's n, k, r2, adj_r2, llf, aic; no rows for groups of
    under ``least`` complete rows or without full rank.
    """
    cols = _design(xs, interactions)
    names = [c for c, _ in cols]
    rows = df.dropna(subset=[y, *dict.fromkeys([*xs, *itertools.chain(*interactions)])])

    def fit(n: int, r: np.ndarray) -> list[dict]:
        one = _fit(names, n, r, least)
        return [t | {k: one[k] for k in ("n", "k", "r2", "adj_r2", "llf", "aic")} for t in one["terms"]] if one else []

    return _per_triangle(_triangles(rows, by, cols, F.col(y)), by, "term string, coef double, se double, t double, p_value double, n long, k long, r2 double, adj_r2 double, llf double, aic double", fit)


def nested_gain(df: DataFrame, y: str, base: Sequence[str], added: Sequence[str], by: Sequence[str] = (), least: int = 20) -> DataFrame:
    """Per group, what ``added`` brings to the linear model of ``base`` on the same rows, both from one pass.

    n, adj_r2_full, adj_r2_base, delta_adj_r2, delta_aic (base less full), lr and its p_value; only n where the design has no full rank.
    """
    cols = _design([*base, *added], ())
    names, k = [c for c, _ in cols], 1 + len(base)
    rows = df.dropna(subset=[y, *base, *added])

    def fit(n: int, r: np.ndarray) -> list[dict]:
        large, small = _fit(names, n, r, least), _fit(names[:k], n, r, least)
        if not large or not small:
            return [{"n": n}] if n >= max(least, len(names) + 1) else []
        lr = 2 * (large["llf"] - small["llf"])
        return [{"n": large["n"], "adj_r2_full": large["adj_r2"], "adj_r2_base": small["adj_r2"], "delta_adj_r2": large["adj_r2"] - small["adj_r2"], "delta_aic": small["aic"] - large["aic"], "lr": lr, "p_value": pvalues.chi2_sf(lr, len(added))}]

    return _per_triangle(_triangles(rows, by, cols, F.col(y)), by, "n long, adj_r2_full double, adj_r2_base double, delta_adj_r2 double, delta_aic double, lr double, p_value double", fit)


def logistic_models(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), least: int = 20, least_positive: int = 5, rounds: int = 120) -> DataFrame:
    """One logistic regression per group; all groups take each step in one or two passes over a written design.

    term, coef, se, odds_ratio, ci_low, ci_high, p_value and the model's n, n_positive, llf, aic,
    mcfadden_r2 and method. ``mle``: maximum likelihood by Newton steps, halved where the likelihood falls. Where a
    direction splits the outcomes (no row on the wrong side, some on the right one) the likelihood has no
    maximum. Newton's steps then run along such a direction, and once all rows confirm it, the group is
    fitted by Firth's penalised likelihood instead, which always has one (method ``firth``; llf, aic and
    mcfadden_r2 are of the plain likelihood there). No rows for groups with too few rows, positives or negatives, or a
    design without full rank; nulls and method ``unsettled`` for one that needs more than ``rounds`` steps.
    """
    cols = _design(xs, ())
    names, k = [c for c, _ in cols], len(cols)
    keys = [*by] or ["_all"]
    rows = df.dropna(subset=[y, *xs]).select(*by, *([] if by else [F.lit(0).alias("_all")]), F.col(y).cast("double").alias("_y"), *(c.alias(f"_x{i}") for i, (_, c) in enumerate(cols)))
    rows = staged(rows, "design")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_y").alias("pos")).where(f"n >= {least} and least(pos, n - pos) >= {least_positive}")
    vectors = [f"{v}{i}" for v in ("b", "best", "move", "se") for i in range(k)]
    inverse = [f"inv{i}_{j}" for i in range(k) for j in range(i, k)]
    fields = "n long, pos double, method string, done boolean, ready boolean, value double, llf double, " + ", ".join(f"{c} double" for c in (*vectors, *inverse))
    now = staged(counts.select(*keys, "n", "pos", F.lit("mle").alias("method"), F.lit(False).alias("done"), F.lit(False).alias("ready"), *(F.lit(None).cast("double").alias(c) for c in ("value", "llf")), *(F.lit(0.0).alias(c) for c in (*vectors, *inverse))), "fit")
    dot = lambda v: sum((F.col(f"_x{i}") * F.col(f"{v}{i}") for i in range(k)), F.lit(0.0))
    hat = sum((F.col(f"inv{min(i, j)}_{max(i, j)}") * F.col(f"_x{i}") * F.col(f"_x{j}") for i in range(k) for j in range(k)), F.lit(0.0))
    for _ in range(rounds):
        live = now.where("not done")
        if live.isEmpty():
            break
        at = rows.join(live.select(*keys, *(f"{v}{i}" for v in ("b", "move") for i in range(k)), *inverse), keys)
        at = at.select(*keys, "_y", *(f"_x{i}" for i in range(k)), dot("b").alias("_eta"), ((2 * F.col("_y") - 1) * dot("move")).alias("_side"), hat.alias("_hat"))
        at = at.withColumn("_p", 1 / (1 + F.exp(-F.col("_eta")))).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
        at = at.withColumn("_r", F.col("_y") - F.col("_p") + F.col("_w") * F.col("_hat") * (0.5 - F.col("_p")))
        sums = at.groupBy(*keys).agg(
            F.sum(F.col("_y") * F.col("_eta") - F.greatest("_eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("_eta")))).alias("new"),
            F.max("_side").alias("right"),
            F.max(-F.col("_side")).alias("wrong"),
            *(F.sum(F.col(f"_x{i}") * F.col("_r")).alias(f"g{i}") for i in range(k)),
            *(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}") * F.col("_w")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)),
        )
        now = staged(now.where("done").unionByName(_per_group(live.join(sums, keys), keys, fields, functools.partial(_logistic_step, k=k))), "fit")

    def told(got: dict) -> list[dict]:
        n, pos, llf = got["n"], got["pos"], got["llf"]
        null = pos * math.log(pos / n) + (n - pos) * math.log(1 - pos / n)
        out = []
        for i, name in enumerate(names):
            b, se = got[f"best{i}"], got[f"se{i}"]
            row = {"term": name, "coef": b, "se": se, "odds_ratio": math.exp(min(b, 700)), "ci_low": math.exp(min(b - 1.96 * se, 700)), "ci_high": math.exp(min(b + 1.96 * se, 700)), "p_value": 2 * pvalues.normal_sf(abs(b / se)) if se else 0.0, "llf": llf, "aic": 2 * k - 2 * llf, "mcfadden_r2": 1 - llf / null}
            row = row if got["done"] else dict.fromkeys(row) | {"term": name}
            out.append(row | {"n": n, "n_positive": int(pos), "method": got["method"] if got["done"] else "unsettled"})
        return out

    return _per_group(now, by, "term string, coef double, se double, odds_ratio double, ci_low double, ci_high double, p_value double, n long, n_positive long, llf double, aic double, mcfadden_r2 double, method string", told)


def _logistic_step(got: dict, k: int) -> list[dict]:
    """What the sums at a group's trial point say: back half-way, a step, settled, on to Firth's likelihood, or no model.

    The penalised score needs the inverse information at the trial point, so such a group takes a round for that
    (``ready``) and another for its score.
    """
    b, best, last = (np.array([got[f"{v}{i}"] for i in range(k)]) for v in ("b", "best", "move"))
    g = np.array([got[f"g{i}"] for i in range(k)])
    info = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    full = np.isfinite(info).all() and np.linalg.matrix_rank(info) == k
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def placed(b: np.ndarray, best: np.ndarray, move: np.ndarray, **new) -> list[dict]:
        return [got | {f"{v}{i}": float(x[i]) for v, x in (("b", b), ("best", best), ("move", move)) for i in range(k)} | new]

    if not full and not b.any():
        return []
    split = got["right"] > 0.1 and got["wrong"] <= 1e-3 * got["right"]
    if got["method"] == "mle" and (split or not full):
        zero = np.zeros(k)
        return placed(zero, zero, zero, method="firth", value=None)
    if got["ready"]:
        inv = np.array([[got[f"inv{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        move = inv @ g
        # these steps shrink at a steady rate, so the rest of the way is taken at once; a step too far is halved later
        length = float(last @ info @ last)
        step = move / (1 - min(max(float(move @ info @ last) / length, 0.0), 0.8)) if length > 0 else move
        step = step * (5 / max(float(np.abs(step).max()), 5.0))
        done = bool(g @ move < 1e-13)
        return placed(b + step, b + step if done else b, move, done=done, ready=False)
    firth = got["method"] == "firth"
    value, before = got["new"] + (0.5 * float(np.linalg.slogdet(info)[1]) if firth else 0.0), got["value"]
    if not full or not pd.isna(before) and value < before - 1e-9 * max(1.0, abs(before)):
        return placed((b + best) / 2, best, last if firth else (b - best) / 2)
    inv = np.linalg.inv(info)
    told = {"value": value, "llf": got["new"]} | {f"se{i}": math.sqrt(inv[i, i]) for i in range(k)}
    if firth:
        return placed(b, b, last, ready=True, **told, **{f"inv{i}_{j}": float(inv[i, j]) for i, j in pairs})
    move = inv @ g
    done = bool(g @ move < 1e-13)
    return placed(b + move, b + move if done else b, move, done=done, **told)


def ols(df: DataFrame, y: str, xs: Sequence[str], interactions: Sequence[tuple[str, str]] = (), least: int = 20) -> dict | None:
    """Least squares with an intercept: coefficients with se, t, p; r2, adj_r2, llf, aic; None under ``least`` rows."""
    cols = _design(xs, interactions)
    rows = df.dropna(subset=[y, *dict.fromkeys([*xs, *itertools.chain(*interactions)])])
    few = _triangles(rows, (), cols, F.col(y)).toPandas()  # a triangle for each of at most FOLDS parts
    return _fit([c for c, _ in cols], *_triangle(few), least)


def partial_slope(df: DataFrame, y: str, x: str, zs: Sequence[str]) -> float | None:
    """Slope of y on x after both are freed of ``zs``: the full model's coefficient."""
    fit = ols(df, y, [x, *zs])
    return fit["terms"][1]["coef"] if fit else None


#: Rows of a group up to which a block of replicates is one task's arrays; beyond, a replicate is a key of its own.
BLOCK_ROWS = 1 << 21
#: Replicates of a block, and cells (rows x replicates) of one array.
BLOCK, BLOCK_CELLS = 500, 1 << 20
#: Tasks that replicates are spread over at least, as a group of many rows is long work for few; a task gets all rows of its group.
BLOCK_TASKS = 24
_LOW = (1 << 32) - 1


def _key_hash(key: str, seed: int) -> Column:
    """32 bits of the md5 of the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def _scatter(x: np.ndarray) -> np.ndarray:
    """A 32-bit mixing step."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x85EBCA6B)) & np.uint64(_LOW)
    x = x ^ (x >> np.uint64(13))
    x = (x * np.uint64(0xC2B2AE35)) & np.uint64(_LOW)
    return x ^ (x >> np.uint64(16))


def _scatter_32(x: np.ndarray) -> np.ndarray:
    """The same step in place on an array of 32 bits, whose products wrap by themselves."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _draws(h: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """A 32-bit number for each row's key hash (rows) and replicate (columns)."""
    return _scatter(h.astype(np.uint64)[:, None] ^ _scatter(replicates.astype(np.uint64))[None, :])


def _scattered(x: Column) -> Column:
    """The same step on a column; each part is the variable of a lambda, so that it is worked out once."""
    held = F.array(x)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        held = F.transform(held, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift)))
        if factor:  # in two halves, which stay below 2^63
            held = F.transform(held, lambda v: (F.shiftleft((v * (factor >> 16)).bitwiseAND(0xFFFF), 16) + v * (factor & 0xFFFF)).bitwiseAND(_LOW))
    return held[0]


def _with_draw(df: DataFrame) -> DataFrame:
    """The same number as ``draw``, from the columns ``h`` and ``replicate``."""
    return df.withColumn("draw", _scattered(F.col("h").bitwiseXOR(_scattered(F.col("replicate").cast("long")))))


#: A draw over the k-th of these makes at least k + 1 copies: the distribution function of a Poisson variable of mean 1.
COPIES = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def _ties(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the values, where each distinct one begins in it, and each row's distinct value."""
    order = np.argsort(v, kind="stable")
    v = v[order]
    new = np.ones(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    del v
    group = np.empty(len(order), np.int32)
    group[order] = np.cumsum(new, dtype=np.int32) - 1
    return order, np.flatnonzero(new), group


def _weighted_rho(m: np.ndarray, *ties: tuple) -> np.ndarray:
    """Rank correlation of the rows with each column of ``m`` as numbers of copies; NaN where a side does not vary."""
    ranks = []
    for order, starts, group in ties:
        own = np.add.reduceat(m[order], starts, axis=0)
        ranks.append((np.cumsum(own, axis=0) - (own - 1) / 2)[group])
    a, b = ranks
    n, sums = m.sum(axis=0), lambda *xs: np.einsum(",".join(["ir"] * len(xs)) + "->r", *xs)
    sa, sb = sums(m, a), sums(m, b)
    spread = (n * sums(m, a, a) - sa * sa) * (n * sums(m, b, b) - sb * sb)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(spread > 0, (n * sums(m, a, b) - sa * sb) / np.sqrt(np.maximum(spread, 0)), np.nan)


#: Rows that a replicate is worked through at a time, and draws over which a row has one copy more.
STEP = 1 << 18
OVER = [np.uint32(math.floor(c * 2.0**32)) for c in COPIES]


def _resampled(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> Callable[[int], float]:
    """The rank correlation of x and y in a replicate; NaN where a side does not vary.

    A row is held in twelve bytes: the hash of its key and the numbers of its two values. A replicate adds a byte for each row and a few numbers
    for each distinct value: copies are counted by value, ranks are read off the running counts, and only products of both ranks need the rows again.
    """
    h = np.asarray(h).astype(np.uint32)
    (x, n_x), (y, n_y) = ((group, len(starts)) for _, starts, group in (_ties(np.asarray(v)) for v in (x, y)))
    step = max(STEP, n_x, n_y)  # so that counts are added up over few steps where there are many values
    copies = np.empty(len(h), np.uint8)

    def centred(own: np.ndarray, total: float) -> np.ndarray:
        rank = np.cumsum(own)
        rank -= own / 2
        rank -= total / 2
        return rank

    def rho(replicate: int) -> float:
        seed = np.uint32(_scatter(np.uint64(replicate)))
        for k in range(0, len(h), STEP):
            draw = _scatter_32(h[k : k + STEP] ^ seed)
            m = copies[k : k + STEP]
            m[:] = 0
            for most in OVER:
                m += draw > most
        counts = []
        for code, n in ((x, n_x), (y, n_y)):
            own = np.zeros(n)
            for k in range(0, len(h), step):
                own += np.bincount(code[k : k + step], weights=copies[k : k + step], minlength=n)
            counts.append(own)
        total = counts[0].sum()
        a, b = (centred(own, total) for own in counts)
        spread = float(np.einsum("i,i,i->", counts[0], a, a)) * float(np.einsum("i,i,i->", counts[1], b, b))
        del counts
        if not spread > 0:
            return math.nan
        both = sum(float(np.einsum("i,i,i->", copies[k : k + STEP], a[x[k : k + STEP]], b[y[k : k + STEP]])) for k in range(0, len(h), STEP))
        return both / math.sqrt(spread)

    return rho


def _in_blocks(rows: DataFrame, by: Sequence[str], times: int, fields: str, one: Callable[[dict[str, np.ndarray]], Callable[[np.ndarray], dict]], groups: int = 1) -> DataFrame:
    """What ``one`` of a group's columns tells of replicates, for each block of replicates 1..times: the rows go to as many tasks as there are blocks, not replicates."""
    schema = StructType([rows.schema[c] for c in by] + StructType.fromDDL(f"replicate int, {fields}").fields)
    size = min(BLOCK, -(-times // max(1, BLOCK_TASKS // max(1, groups))))
    names = [c for c in rows.columns if c not in by]

    def block(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, parts = group[-1].as_py() * size + 1, {c: [] for c in names}
        for batch in batches:
            for c in names:  # copies: a view of one column would hold the whole batch
                parts[c].append(np.array(batch.column(c).to_numpy(zero_copy_only=False)))
        held = {c: np.concatenate(parts.pop(c)) for c in names}
        width = max(1, BLOCK_CELLS // len(held["h"]))
        told = one(held)
        for k in range(low, min(low + size, times + 1), width):
            r = np.arange(k, min(k + width, low + size, times + 1))
            out = told(r)
            cols = [*(pa.repeat(x, len(r)) for x in group[:-1]), pa.array(r, pa.int32()), *(pa.array(out[f.name]) for f in schema.fields[len(by) + 1 :])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    blocks = F.explode(F.sequence(F.lit(0), F.lit((times - 1) // size)))
    return rows.withColumn("block", blocks).groupBy(*by, "block").applyInArrow(block, schema)


def _sizes(rows: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and how many groups there are."""
    r = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    return r[0] or 0, r[1]


def _replicate_rho(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted rank correlation ``r`` of the cells (x, y, m) of each key; a replicate is one key, so one task sorts no more than its rows."""
    for c in ("x", "y"):
        order = Window.partitionBy(*keys).orderBy(c)
        upto = F.sum("m").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        own = F.sum("m").over(Window.partitionBy(*keys, c))
        cells = cells.withColumn(f"r_{c}", upto - (own - 1) / 2)
    return cells.groupBy(*keys).agg(_corr(F.col("r_x"), F.col("r_y"), F.col("m").cast("double")).alias("r"))


def bootstrap_spearman(df: DataFrame, x: str, y: str, key: str, by: Sequence[str] = (), times: int = 1000, seed: int = 42) -> DataFrame:
    """Per group n, rho, ci_low, ci_high: percentiles of rho over Poisson(1) bootstraps.

    A row's weight in a replicate comes from hashes of its key and the seed and of the replicate, so a run can be repeated
    anywhere. Replicates are worked in blocks, one at a time over the group's rows (``_resampled``), which go there as three numbers; where
    a group has more than 4 ``BLOCK_ROWS``, rows with weight are spread over replicates instead.
    """
    rows = df.dropna(subset=[x, y]).select(*by, F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), _key_hash(key, seed).alias("h"))
    rows = staged(rows.drop("key"), "resampled")
    largest, groups = _sizes(rows, by)
    if largest <= 4 * BLOCK_ROWS:

        def one(held: dict[str, np.ndarray]) -> Callable[[np.ndarray], dict]:
            rho = _resampled(held.pop("h"), held.pop("x"), held.pop("y"))
            return lambda replicates: {"r": np.array([rho(r) for r in replicates])}

        per = _in_blocks(rows, by, times, "r double", one, groups).withColumn("r", F.nanvl("r", F.lit(None).cast("double")))
    else:
        many = _with_draw(rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(times)))))
        m = sum(((F.col("draw") / 2.0**32 > s).cast("int") for s in COPIES), F.lit(0))
        per = _replicate_rho(many.withColumn("m", m).where("m > 0").groupBy(*by, "replicate", "x", "y").agg(F.sum("m").alias("m")), [*by, "replicate"])
    ci = per.groupBy(*by).agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = spearman(rows, "x", "y", by).select(*by, "n", "rho")
    both = whole.join(ci, list(by), "left") if by else whole.join(F.broadcast(ci))
    return both.select(*by, "n", "rho", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def permutation_test(df: DataFrame, x: str, y: str, group: str, a: str, b: str, key: str, by: Sequence[str] = (), times: int = 10_000, seed: int = 42) -> DataFrame:
    """Per group of ``by``: n_a, n_b, rho_a, rho_b, observed = |rho_a - rho_b| and the share of label shuffles that reach it.

    A shuffle gives the label ``a`` to the rows with the smallest hashes of key and replicate. Blocks of replicates as in ``bootstrap_spearman``.
    """
    rows = df.where(F.col(group).isin(a, b)).dropna(subset=[x, y]).select(*by, F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), _key_hash(key, seed).alias("h"), (F.col(group) == a).alias("g"))
    rows = staged(rows, "permuted")
    sizes = rows.groupBy(*by).agg(F.count_if("g").alias("n_a"), F.count_if(~F.col("g")).alias("n_b")).where("n_a >= 3 and n_b >= 3")
    rows = rows.join(sizes, list(by)) if by else rows.join(F.broadcast(sizes))
    real = _sides(rows.withColumns({"replicate": F.lit(0), "side": F.col("g")}), by)
    largest, groups = _sizes(rows, by)
    if largest <= BLOCK_ROWS:

        def one(held: dict[str, np.ndarray]) -> Callable[[np.ndarray], dict]:
            order = np.argsort(held["key"], kind="stable")
            h, x, y = (held[c][order] for c in ("h", "x", "y"))
            n_a, place = int(held["n_a"][0]), np.arange(len(h), dtype=np.uint64)[:, None]
            ties = _ties(x), _ties(y)

            def told(replicates: np.ndarray) -> dict:
                order = np.argpartition((_draws(h, replicates) << np.uint64(22)) | place, n_a - 1, axis=0)
                side = np.zeros((len(h), len(replicates)))
                np.put_along_axis(side, order[:n_a], 1.0, axis=0)
                return {"rho_a": _weighted_rho(side, *ties), "rho_b": _weighted_rho(1 - side, *ties)}

            return told

        shuffled = _in_blocks(rows, by, times, "rho_a double, rho_b double", one, groups)
        shuffled = shuffled.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("rho_a", "rho_b")})
    else:
        many = _with_draw(rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(times)))))
        place = F.row_number().over(Window.partitionBy(*by, "replicate").orderBy("draw", "key"))
        shuffled = _sides(many.withColumn("side", place <= F.col("n_a")), by)
    gap = F.coalesce(F.abs(F.col("rho_a") - F.col("rho_b")), F.lit(0.0))
    gaps = shuffled.groupBy(*by).agg(F.collect_list(gap).alias("_gaps"))
    real = real.withColumn("observed", gap)
    whole = sizes.join(real, list(by)).join(gaps, list(by)) if by else sizes.join(real).join(gaps)
    hits = F.size(F.filter("_gaps", lambda g: g >= F.col("observed") - 1e-12))
    return whole.select(*by, "n_a", "n_b", "rho_a", "rho_b", "observed", (hits / F.lit(times)).alias("p_value"))


def _sides(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank correlation of both sides of each replicate."""
    rho = _replicate_rho(rows.withColumn("m", F.lit(1)), [*by, "replicate", "side"])
    return rho.groupBy(*by, "replicate").agg(F.max(F.when(F.col("side"), F.col("r"))).alias("rho_a"), F.max(F.when(~F.col("side"), F.col("r"))).alias("rho_b"))
