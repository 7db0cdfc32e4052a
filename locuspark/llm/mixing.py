"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells of source, language and topic. The cells' token weights are raked:
in turn, each dimension's marginals are scaled to their targets. A cell's calibrated factor
(raked weight over tokens) times one constant, capped at 1, is the probability with which
its documents are sampled; the constant makes the expected tokens meet the budget. A
document is in the sample if a hash of its id, as a number in [0, 1), is below that.

Targets are a table (dimension, value, share): shares count among the values that occur, and
values of a listed dimension that are not in the table get none. Dimensions without targets
temper the corpus: each marginal's share to the power ``ALPHA``. Where the cap at 1 binds, the
sample falls short of its targets; ``marginals`` tells target, raked and expected share of each value.
The topic is a coarse one by form unless the caller gives an expression for it.

Defined results: a null source, language or text counts as the category ``(none)`` and 0
tokens; cells without tokens have probability 0; repeated rows are sampled alike; rows with
a null doc_id share one hash; clashing columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

DIMENSIONS = ("source", "lang", "topic")
ALPHA = 0.5
KEEP = 0.5
SWEEPS = 8
CAP_ROUNDS = 12


def n_tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form: table, noise, shouting, long or short prose."""
    return (
        F.when(text.isNull(), "(none)")
        .when(text.contains(" | "), "table")
        .when(text.contains("### ") | text.contains("$$$ "), "noise")
        .when(text.contains("!! "), "shouting")
        .when(F.length(text) >= 2000, "long prose")
        .otherwise("short prose")
    )


def labelled(docs: DataFrame, topic_of: Column | None = None) -> DataFrame:
    """doc_id, the three dimensions and tokens of each document."""
    none = F.lit("(none)")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), none).alias("source"), F.coalesce(F.col("lang").cast("string"), none).alias("lang"), _topic(topic_of).alias("topic"), n_tokens(F.col("text")).alias("tokens"))


def _topic(given: Column | None) -> Column:
    return topic(F.col("text")) if given is None else F.coalesce(given.cast("string"), F.lit("(none)"))


def cell_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")


def _total(value: str, dimension: str) -> Column:
    return F.sum(value).over(Window.partitionBy(dimension))


def with_targets(cells: DataFrame, alpha: float = ALPHA, targets: DataFrame | None = None) -> DataFrame:
    """The cells with a ``target_<dimension>`` each: the wanted share of the cell's value."""
    given = {r[0] for r in targets.select("dimension").distinct().collect()} & set(DIMENSIONS) if targets is not None else set()  # three at most
    parts = cells.select("*", *(F.pow(_total("tokens", d), F.lit(alpha)).alias(f"target_{d}") for d in DIMENSIONS), *(F.count("*").over(Window.partitionBy(d)).alias(f"n_{d}") for d in DIMENSIONS))
    for d in sorted(given):
        own = targets.where(F.col("dimension") == d).groupBy(F.col("value").alias(d)).agg(F.sum("share").alias("_share"))
        parts = parts.join(own, d, "left").withColumn(f"target_{d}", F.coalesce(F.col("_share").cast("double"), F.lit(0.0))).drop("_share")
    parts = staged(parts, "targets")
    whole = parts.agg(*(F.sum(F.col(f"target_{d}") / F.col(f"n_{d}")) for d in DIMENSIONS)).first()
    return parts.select(*DIMENSIONS, "tokens", *((F.col(f"target_{d}") / F.lit(w or 1.0)).alias(f"target_{d}") for d, w in zip(DIMENSIONS, whole, strict=True)))


def rake(cells: DataFrame, sweeps: int = SWEEPS, per_job: int = 4) -> DataFrame:
    """The cells with ``weight``, shares of 1 whose marginals meet the targets.

    Cells are few rows next to documents: a dimension's value holds at most the values of the
    two others. A sweep is three windows; ``per_job`` sweeps run as one job.
    """
    whole = cells.agg(F.sum("tokens")).first()[0] or 1.0
    now = cells.withColumn("weight", F.col("tokens") / F.lit(whole))
    for k in range(sweeps):
        for d in DIMENSIONS:
            now = now.withColumn("weight", F.coalesce(F.col("weight") * F.col(f"target_{d}") / F.nullif(_total("weight", d), F.lit(0.0)), F.lit(0.0)))
        if (k + 1) % per_job == 0:
            now = staged(now, "raked")
    return now


def probabilities(cells: DataFrame, keep: float = KEEP, rounds: int = CAP_ROUNDS) -> DataFrame:
    """The raked cells with ``probability``; the expected tokens are ``keep`` of all if the caps allow it."""
    factor = F.col("weight") / F.col("tokens")
    whole = cells.agg(F.sum("tokens")).first()[0] or 0.0
    scale = keep * whole
    for _ in range(rounds):
        got = cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(scale) * factor))).first()[0]
        if not got or abs(got / (keep * whole) - 1) < 1e-12:
            break
        scale *= keep * whole / got
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(scale) * factor))


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the md5 of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def marginals(cells: DataFrame) -> DataFrame:
    """dimension, value, target, raked and expected (what the sample holds on average) share of each value, from ``probabilities``."""
    hold = F.col("tokens") * F.col("probability")
    whole = cells.agg(F.sum(hold)).first()[0] or 1.0
    parts = [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.first(f"target_{d}").alias("target"), F.sum("weight").alias("raked"), (F.sum(hold) / F.lit(whole)).alias("expected")) for d in DIMENSIONS]
    return functools.reduce(DataFrame.unionByName, parts)


def calibrated(rows: DataFrame, keep: float = KEEP, alpha: float = ALPHA, targets: DataFrame | None = None) -> DataFrame:
    """All cells with targets, raked weight and probability."""
    cells = staged(cell_table(rows), "cells")
    return staged(probabilities(rake(with_targets(cells, alpha, targets)), keep), "mix")


def calibrated_cells(rows: DataFrame, keep: float = KEEP, alpha: float = ALPHA, targets: DataFrame | None = None) -> DataFrame:
    return calibrated(rows, keep, alpha, targets).select(*DIMENSIONS, "weight", "probability")


def sampled(docs: DataFrame, keep: float = KEEP, alpha: float = ALPHA, targets: DataFrame | None = None, topic_of: Column | None = None) -> DataFrame:
    """Each document's cell, tokens, weight of the cell, probability and whether it is in the sample."""
    rows = staged(labelled(docs, topic_of), "labelled")
    out = rows.join(calibrated_cells(rows, keep, alpha, targets), [*DIMENSIONS], "left").fillna(0.0, ["weight", "probability"])
    return out.select("doc_id", *DIMENSIONS, "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def sample_documents(docs: DataFrame, keep: float = KEEP, alpha: float = ALPHA, targets: DataFrame | None = None, topic_of: Column | None = None) -> DataFrame:
    """The sampled documents, with mix_topic and mix_probability (replaced if there) besides the columns of ``docs``."""
    cells = calibrated_cells(labelled(docs, topic_of), keep, alpha, targets).toDF("_source", "_lang", "_topic", "_weight", "_probability")
    none = F.lit("(none)")
    same = (F.coalesce(docs["source"].cast("string"), none) == cells["_source"]) & (F.coalesce(docs["lang"].cast("string"), none) == cells["_lang"]) & (_topic(topic_of) == cells["_topic"])
    kept = docs.join(cells, same).where(uniform(docs["doc_id"]) < cells["_probability"])
    own = [docs[c] for c in docs.columns if c not in ("mix_topic", "mix_probability")]
    return kept.select(*own, cells["_topic"].alias("mix_topic"), F.round(cells["_probability"], 6).alias("mix_probability"))
