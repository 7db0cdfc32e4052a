"""Group summaries and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PADJ_MAX, flag
from ..sources.staging import staged
from .binning import quantiles


def named(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """One row for each listed value: keeps groups without rows in a summary."""
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{col} string")


def group_summary(df: DataFrame, group: str, col: str, groups: Sequence[str], above: float = 1.0) -> DataFrame:
    """n, mean, median, quartiles and n above a threshold of each listed group, empty ones too."""
    df = staged(df.select(group, col), "measured")  # read for the counts and for the quantiles
    stats = df.groupBy(group).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.count_if(F.col(col) > above).alias("n_above"))
    out = named(df, group, groups).join(stats, group, "left").join(quantiles(df, col, [0.25, 0.5, 0.75], [group], "_q"), group, "left")
    return out.select(group, F.coalesce("n", F.lit(0)).alias("n"), "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), F.coalesce("n_above", F.lit(0)).alias("n_above"))


def sig_summary(df: DataFrame, by: Sequence[str], padj: str = "padj", alpha: float = PADJ_MAX, inclusive: bool = False) -> DataFrame:
    """n, tested (padj known), significant, and the significant share of the tested."""
    hit = F.col(padj) <= alpha if inclusive else F.col(padj) < alpha
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(padj).alias("n_tested"), F.count_if(hit).alias("n_sig"))
    return out.withColumn("fraction", F.col("n_sig") / F.nullif(F.col("n_tested"), F.lit(0)))


def fc_summary(df: DataFrame, by: Sequence[str], lfc: str = "lfc", padj: str = "padj") -> DataFrame:
    """Mean and median change, and the significant repressed and induced over all known changes."""
    sig = flag(F.col(padj) < PADJ_MAX)
    out = df.groupBy(*by).agg(F.count(lfc).alias("n"), F.avg(lfc).alias("mean_lfc"), F.median(lfc).alias("median_lfc"), F.count_if(sig & (F.col(lfc) > 0)).alias("n_repressed"), F.count_if(sig & (F.col(lfc) < 0)).alias("n_induced"))
    n = F.nullif(F.col("n"), F.lit(0))
    return out.withColumns({"fraction_repressed": F.col("n_repressed") / n, "fraction_induced": F.col("n_induced") / n})


def direction_counts(df: DataFrame, by: Sequence[str], direction: str = "direction", lfc: str = "lfc") -> DataFrame:
    """Repressed and induced rows, their ratio and the mean change."""
    out = df.groupBy(*by).agg(F.count_if(F.col(direction) == "repressed").alias("n_repressed"), F.count_if(F.col(direction) == "induced").alias("n_induced"), F.count("*").alias("n"), F.avg(lfc).alias("mean_lfc"))
    return out.withColumn("ratio", F.col("n_repressed") / F.nullif(F.col("n_induced"), F.lit(0)))


def contingency(df: DataFrame, a: str, b: str, a_values: Sequence[str], b_values: Sequence[str]) -> DataFrame:
    """Count of each pair of listed values, zeros kept, and its share of the b value's rows."""
    counts = df.where(F.col(a).isin(*a_values) & F.col(b).isin(*b_values)).groupBy(a, b).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} string, {b} string")
    out = grid.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(b))
    return out.withColumn("fraction", F.col("n") / F.nullif(total, F.lit(0)))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Rows by columns of the listed values, counts, 0 for none."""
    return df.groupBy(rows).pivot(columns, list(values)).count().fillna(0, list(values))


def signal_summary(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.sum(value).alias("signal_sum"), F.avg(value).alias("signal_mean"), F.max(value).alias("signal_max"), F.count("*").alias("n_peaks"))


def retention(annotated: DataFrame, measured: DataFrame, group: str, key: str) -> DataFrame:
    """Distinct annotated keys of each group, those measured, the rest, and percentages."""
    seen = measured.select(key).distinct().withColumn("_seen", F.lit(1))
    out = annotated.select(group, key).distinct().join(seen, key, "left").groupBy(group).agg(F.count("*").alias("n_annotated"), F.count("_seen").alias("n_retained"))
    n = F.nullif(F.col("n_annotated"), F.lit(0))
    return out.withColumns({"n_filtered": F.col("n_annotated") - F.col("n_retained"), "percent_retained": 100 * F.col("n_retained") / n, "percent_filtered": 100 * (F.col("n_annotated") - F.col("n_retained")) / n})


def bin_fractions(df: DataFrame, bin_: str, flags: Sequence[str]) -> DataFrame:
    """n and the share of each flag by bin; bins without rows do not appear."""
    return df.groupBy(bin_).agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("int")).alias(f"fraction_{f}") for f in flags))


def class_presence(members: DataFrame, structures: DataFrame, key: str, structure: str, class_: str) -> DataFrame:
    """Members of each class that have a structure, over all members of the class."""
    totals = members.groupBy(class_).agg(F.count_distinct(key).alias("n_class"))
    found = structures.select(key, structure).distinct().join(members.select(key, class_), key).groupBy(structure, class_).agg(F.count_distinct(key).alias("n_present"))
    return found.join(totals, class_).withColumn("fraction", F.col("n_present") / F.col("n_class"))


def sweep(df: DataFrame, group: str, target: str, control: str, thresholds: Sequence[float], padj: str = "padj") -> DataFrame:
    """Tested and significant rows of a group and of its comparators (all others, one group), by threshold; one pass."""
    out = df.groupBy().agg(*(
        x for t in thresholds for side, cond in (("target", F.col(group) == target), ("others", F.col(group) != target), ("control", F.col(group) == control))
        for x in (F.count_if(cond & F.col(padj).isNotNull()).alias(f"{side}_{t}_tested"), F.count_if(cond & (F.col(padj) < t)).alias(f"{side}_{t}_sig"))
    ))
    rows = [F.struct(F.lit(t).alias("threshold"), F.lit(c).alias("comparator"), F.col(f"`target_{t}_sig`").alias("a"), (F.col(f"`target_{t}_tested`") - F.col(f"`target_{t}_sig`")).alias("b"), F.col(f"`{c}_{t}_sig`").alias("c"), (F.col(f"`{c}_{t}_tested`") - F.col(f"`{c}_{t}_sig`")).alias("d")) for t in thresholds for c in ("others", "control")]
    return out.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def filter_summary(df: DataFrame, kept: Column, by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(kept).alias("n_retained"))
    return out.withColumn("fraction", F.col("n_retained") / F.nullif(F.col("n"), F.lit(0)))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows stop at each condition, the first that fails; ``kept`` for the rest, in order."""
    stop = None
    for k, (name, ok) in enumerate(steps):
        at = F.struct(F.lit(k).alias("step"), F.lit(name).alias("reason"))
        stop = F.when(~flag(ok), at) if stop is None else stop.when(~flag(ok), at)
    stop = stop.otherwise(F.struct(F.lit(len(steps)).alias("step"), F.lit("kept").alias("reason")))
    return df.select(stop.alias("x")).groupBy("x.step", "x.reason").agg(F.count("*").alias("n"))


def joined_members(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Distinct members of each group as sorted, comma-joined text."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(col)), ",").alias("members"))


def bucket_count(df: DataFrame, key: str, most: int = 3) -> DataFrame:
    """How many keys have 1, 2, ... or at least ``most`` rows."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).groupBy(F.least("_n", F.lit(most)).alias("n_rows")).agg(F.count("*").alias("n_keys"))


def left_chain(base: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    for t in tables:
        base = base.join(t, key, "left")
    return base


def inner_chain(base: DataFrame, tables: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Inner join of all tables, and how many base rows each one dropped first."""
    flagged = base
    for name, t in tables.items():
        flagged = flagged.join(t.withColumn(f"_{name}", F.lit(True)), key, "left")
    losses = funnel(flagged, [(name, F.col(f"_{name}")) for name in tables])
    kept = flagged.where(" and ".join(f"_{n}" for n in tables)).drop(*(f"_{n}" for n in tables))
    return kept, losses


def flag_in(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    marks = keys.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of either side with in_a and in_b."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, key, "full_outer").fillna(False, ["in_a", "in_b"])
