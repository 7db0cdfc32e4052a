"""Entity by sample measurements in long form: one row per entity, sample and value."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binning import quantiles


def sample_stats(long: DataFrame, key: str, value: str, samples: Sequence[object] | None = None, sample: str = "sample_id") -> DataFrame:
    """Mean, sample sd and whether all values are 0, over the chosen samples."""
    rows = long.where(F.col(sample).isin(list(samples))) if samples is not None else long
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.bool_and(F.col(value) == 0).alias("all_zero"))


def prefilter(long: DataFrame, key: str, value: str, least: float = 10, samples: int = 3) -> DataFrame:
    """Rows of the keys that reach ``least`` in at least ``samples`` samples."""
    good = long.groupBy(key).agg(F.count_if(F.col(value) >= least).alias("_n")).where(F.col("_n") >= samples).select(key)
    return long.join(good, key, "left_semi")


def select_samples(names: Sequence[str], time: str, manifest: dict[str, str] | None = None) -> list[str]:
    """Sample columns of a time: by a manifest (sample to time), else by marks of the time in the name."""
    if manifest:
        return [n for n in names if manifest.get(n) == time]
    for mark in (f"t{time}", f"_{time}", f"{time}_", time):
        found = [n for n in names if mark in n]
        if found:
            return found
    return []


def tx_to_gene(quant: DataFrame, tx2gene: DataFrame) -> DataFrame:
    """Sums of tpm and reads by gene and sample, and length weighted by tpm (a plain mean where tpm is 0)."""
    joined = quant.join(tx2gene.select("transcript_id", "gene_id"), "transcript_id")
    out = joined.groupBy("gene_id", "sample_id").agg(F.sum("tpm").alias("tpm"), F.sum("num_reads").alias("num_reads"), F.sum(F.col("eff_length") * F.col("tpm")).alias("_w"), F.avg("eff_length").alias("_m"))
    return out.select("gene_id", "sample_id", "tpm", "num_reads", F.coalesce(F.col("_w") / F.nullif(F.col("tpm"), F.lit(0.0)), F.col("_m")).alias("length"))


def mapping_summary(quant: DataFrame, tx2gene: DataFrame) -> DataFrame:
    """Distinct transcripts, mapped and unmapped ones, by sample."""
    known = tx2gene.select("transcript_id").distinct().withColumn("_known", F.lit(1))
    out = quant.select("sample_id", "transcript_id").distinct().join(known, "transcript_id", "left").groupBy("sample_id").agg(F.count("*").alias("n_transcripts"), F.count("_known").alias("n_mapped"))
    return out.withColumns({"n_unmapped": F.col("n_transcripts") - F.col("n_mapped"), "fraction_mapped": F.col("n_mapped") / F.nullif(F.col("n_transcripts"), F.lit(0))})


def size_factors(long: DataFrame, key: str, sample: str, value: str) -> DataFrame:
    """Median over keys of the ratio of each sample to the key's geometric mean; keys with a 0 or a gap are left out."""
    n = long.select(sample).distinct().count()
    means = long.groupBy(key).agg(F.avg(F.ln(F.when(F.col(value) > 0, F.col(value)))).alias("_log"), F.count_if(F.col(value) > 0).alias("_n")).where(F.col("_n") == n).select(key, "_log")
    ratios = long.join(means, key).select(sample, (F.ln(value) - F.col("_log")).alias("_ratio"))
    return quantiles(ratios, "_ratio", [0.5], [sample]).select(sample, F.exp(F.col("quantiles")[0]).alias("size_factor"))


def normalize_counts(long: DataFrame, key: str, sample: str, value: str) -> DataFrame:
    return long.join(size_factors(long, key, sample, value), sample).withColumn("normalized", F.col(value) / F.col("size_factor"))


def top_variance(long: DataFrame, key: str, value: str, n: int) -> DataFrame:
    best = long.groupBy(key).agg(F.var_samp(value).alias("_v")).orderBy(F.desc("_v"), key).limit(n).select(key)
    return long.join(best, key, "left_semi")


def sample_distance(long: DataFrame, key: str, sample: str, value: str) -> DataFrame:
    """Euclidean distance of each pair of samples. A pair per key and two samples: samples are few."""
    a, b = (long.select(key, F.col(sample).alias(f"sample_{k}"), F.col(value).alias(f"_{k}")) for k in "ab")
    both = a.join(b, key).where("sample_a < sample_b")
    return both.groupBy("sample_a", "sample_b").agg(F.sqrt(F.sum(F.pow(F.col("_a") - F.col("_b"), F.lit(2)))).alias("distance"))


def sample_pca(long: DataFrame, key: str, sample: str, value: str, n_keys: int = 500, k: int = 2) -> DataFrame:
    """First components of the samples over the keys of the largest variance, of either sign.

    From the sums of products of each two samples: only that table, of the square of the number of samples, comes to the
    driver, and no task holds a sample's keys. A key that a sample lacks counts as that key's mean.
    """
    picked = top_variance(long, key, value, n_keys)
    centred = picked.join(picked.groupBy(key).agg(F.avg(value).alias("_m")), key).select(key, F.col(sample).alias("s"), (F.col(value) - F.col("_m")).alias("v"))
    a, b = (centred.select(key, F.col("s").alias(f"s{i}"), F.col("v").alias(f"v{i}")) for i in "ab")
    gram = a.join(b, key).groupBy("sa", "sb").agg(F.sum(F.col("va") * F.col("vb")).alias("w")).collect()
    names = sorted({r["sa"] for r in gram})
    at = {n: i for i, n in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in gram:
        g[at[r["sa"]], at[r["sb"]]] = r["w"]
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    scores = np.zeros((len(names), k))
    found = min(k, len(names))
    scores[:, :found] = (vectors * np.sqrt(np.maximum(values, 0)))[:, ::-1][:, :found]
    kind = long.schema[sample].dataType.simpleString()
    return long.sparkSession.createDataFrame([(n, *map(float, s)) for n, s in zip(names, scores, strict=True)], f"{sample} {kind}, " + ", ".join(f"pc{i + 1} double" for i in range(k)))
