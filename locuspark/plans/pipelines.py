"""Composite queries: whole analyses as one plan each, over DataFrames of any origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sequence as Q
from ..operators import binning as B
from ..operators import cells as C
from ..operators import intervals as I
from ..operators import matrix as M
from ..operators import stats as T
from ..operators import summaries as A
from ..sources.staging import staged

GROUPS = ("hit", "control", "none")


def _unpivot(df: DataFrame, keep: Sequence[str], stems: Sequence[str], times: Sequence[int] = S.TIMES, name: str = "time") -> DataFrame:
    """One row per time with the columns ``<stem>_<time>`` as ``<stem>``."""
    rows = F.array(*(F.struct(F.lit(t).alias(name), *(F.col(f"{s}_{t}").alias(s) for s in stems)) for t in times))
    return df.select(*keep, F.explode(rows).alias("_x")).select(*keep, "_x.*")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def promoter_groups(windows: DataFrame, loci: DataFrame, control: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """gene, n_overlaps, group flags and the group of each window's gene."""
    counted = I.overlap_count(windows, loci, ["gene"])
    flagged = A.flag_in(counted, control, "gene", "has_control").withColumn("has_hit", F.col("n_overlaps") > 0)
    return flagged.select("gene", "n_overlaps", "has_hit", "has_control", S.assign_group(F.col("has_hit"), F.col("has_control"), groups).alias("grp"))


def baseline_by_group(groups: DataFrame, matrix: DataFrame, samples: Sequence[object]) -> DataFrame:
    """gene, grp, mean, mean_log2, expression_class: silent genes, else quartiles of the whole matrix."""
    stats = M.sample_stats(matrix, "gene", "value", samples).withColumn("mean_log2", S.log2p1("mean"))
    binned = B.qcut(stats, "mean", 4, "quartile", zero=F.col("all_zero"))
    named = binned.withColumn("expression_class", F.when(F.col("quartile") == 0, "silent").otherwise(F.concat(F.lit("Q"), F.col("quartile").cast("string"))))
    return groups.select("gene", "grp").join(named.select("gene", "mean", "mean_log2", "sd", "expression_class"), "gene")


def expression_tests(by_group: DataFrame, value: str = "mean_log2", groups: Sequence[str] = GROUPS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Overall test, one-sided pairs against the first group, expressed-or-not tests (of groups with rows), and group summaries."""
    overall = T.kruskal(by_group, value, "grp")
    pairs = T.bh_adjust(_union([T.mann_whitney(by_group, value, "grp", groups[0], g, alternative="greater").withColumn("against", F.lit(g)) for g in groups[1:]]))
    live = F.col(value) > 1
    counts = by_group.groupBy().agg(*(x for g in groups for x in (F.count_if((F.col("grp") == g) & live).alias(f"{g}_on"), F.count_if((F.col("grp") == g) & ~live).alias(f"{g}_off"))))
    cells = _union([counts.select(F.lit(g).alias("against"), F.col(f"{groups[0]}_on").alias("a"), F.col(f"{groups[0]}_off").alias("b"), F.col(f"{g}_on").alias("c"), F.col(f"{g}_off").alias("d")) for g in groups[1:]]).where("a + b > 0 AND c + d > 0")
    return overall, pairs, T.bh_adjust(T.fisher(cells, alternative="greater")), A.group_summary(by_group, "grp", value, groups)


def prepare_loci(intervals: DataFrame, both_strands: bool = True, classes: Sequence = Q.MOTIFS) -> DataFrame:
    """Motif-supported loci of intervals with their sequence: structure and its place on the contig."""
    called = intervals.withColumn("m", (Q.classify_both_strands if both_strands else Q.classify_motif)("seq", classes))
    called = called if both_strands else called.withColumn("m", F.col("m").withField("strand", F.col("strand")))
    kept = called.where("m.structure <> 'other' AND m.span_start IS NOT NULL AND m.strand IN ('+', '-')")
    at = Q.span_to_coords("start", "end", "m.strand", "m.span_start", "m.span_end")
    rest = [c for c in intervals.columns if c not in ("chrom", "start", "end", "strand", "seq")]
    out = kept.select("chrom", "start", "end", *rest, "m.strand", "m.structure", at.alias("at")).select("chrom", "start", "end", *rest, "strand", "structure", "at.*")
    return out.where("structure_start >= start AND structure_end <= `end` AND structure_center BETWEEN structure_start AND structure_end")


def union_loci(*loci: DataFrame) -> DataFrame:
    """Merged islands of several assays."""
    return I.merge(_union([x.select("chrom", "start", "end") for x in loci]))


def gc_sample(tiles: DataFrame, exclude: dict[str, DataFrame], gc: float, k: int, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``k`` tiles or windows above a GC fraction, without the listed intervals, and the funnel of the selection."""
    held = staged(tiles, "tiles")  # cut once; only places and conditions go through the joins
    judged = held.select(*dict.fromkeys([key, "chrom", "start", "end"]), Q.only_acgt("seq").alias("_acgt"), (Q.gc_fraction("seq") > gc).alias("_gc"))
    flagged = I.overlap_flags(judged, exclude, [key])
    steps = [*((n, ~F.col(n)) for n in exclude), ("not_acgt", F.col("_acgt")), ("gc", F.col("_gc"))]
    good = flagged
    for _, ok in steps:
        good = good.where(ok)
    chosen = B.sample_k(good.select(key, "chrom", "start", "end"), k, key, seed)
    return held.join(chosen.select(key), key, "left_semi").select(*tiles.columns), A.funnel(flagged, steps)


def import_track(beds: DataFrame, blocks: DataFrame, exclude: DataFrame, key: str) -> DataFrame:
    """Strand files moved to other coordinates, without excluded regions, sorted."""
    mapped, _ = I.remap(beds, blocks, [key])
    return I.sort_bed(I.overlap_anti(mapped, exclude, [key]))


def decile_trend(by_group: DataFrame, value: str, flags: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Share of each flag by decile (0 for silent genes), and its rank correlation with the decile."""
    binned = B.qcut(by_group, value, 10, "decile", zero=F.col(value) == 0)
    out = A.bin_fractions(binned, "decile", flags)
    trend = _union([T.spearman(out.where("decile > 0"), "decile", f"fraction_{f}").withColumn("flag", F.lit(f)) for f in flags])
    return out, trend


def response_by_group(groups: DataFrame, lrt: DataFrame, contrast: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Significant share, change summary of all and of significant genes, and the test of changes over groups."""
    rows = A.left_chain(groups.select("gene", "grp"), [lrt, contrast], "gene")
    sig = rows.where("lrt_padj < 0.05")
    return A.sig_summary(rows, ["grp"], "lrt_padj"), A.fc_summary(rows, ["grp"], "lfc", "padj"), A.fc_summary(sig, ["grp"], "lfc", "padj"), T.kruskal(rows, "lfc", "grp")


def structure_enrichment(members: DataFrame, windows: DataFrame, loci: DataFrame, key: str = "gene", class_: str = "expression_class", top: str = "Q4", bottoms: Sequence[str] = ("Q1", "silent")) -> tuple[DataFrame, DataFrame]:
    """Presence of each structure by class, and exact tests of the top class against the others, adjusted over all."""
    islands = staged(I.merge(loci.where("start < `end`"), by=["chrom", "structure"]), "islands")  # a window meets few of a structure, however deep loci pile up
    found = staged(I.overlap_pairs(windows.select(key, "chrom", "start", "end"), islands).select(F.col(f"{key}_a").alias(key), F.col("structure_b").alias("structure")).distinct(), "found")
    members = staged(members.select(key, class_), "members")
    presence = A.class_presence(members, found, key, "structure", class_)
    totals = members.groupBy(class_).agg(F.count_distinct(key).alias("n_class"))
    grid = found.select("structure").distinct().join(totals)
    full = staged(grid.join(presence.select("structure", class_, "n_present"), ["structure", class_], "left").withColumn("n_present", F.coalesce("n_present", F.lit(0))), "grid")
    up = full.where(F.col(class_) == top).select("structure", F.col("n_present").alias("a"), (F.col("n_class") - F.col("n_present")).alias("b"))
    down = full.where(F.col(class_).isin(*bottoms)).select("structure", F.col(class_).alias("against"), F.col("n_present").alias("c"), (F.col("n_class") - F.col("n_present")).alias("d"))
    return presence, T.bh_adjust(T.fisher(up.join(down, "structure"), alternative="greater"))


def gene_response(groups: DataFrame, wide: DataFrame, *more: DataFrame) -> DataFrame:
    """One row per gene of a group: changes, directions and the response label."""
    dirs = [f"dir_{t}" for t in S.TIMES]
    named = wide.withColumns({f"dir_{t}": S.direction(f"lfc_{t}", f"padj_{t}") for t in S.TIMES}).withColumn("response", S.response_label("lrt_padj", dirs))
    return A.left_chain(groups.select("gene", "grp"), [named, *more], "gene")


def strength_and_ora(genes: DataFrame, windows: DataFrame, loci: DataFrame, sets: DataFrame, metric: str = "signal_max", n_bins: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signal strength and its bin for genes with loci, tests of the bins, and set over-representation of significant genes.

    ``genes`` has gene, lrt_padj and abs_lfc.
    """
    strength = I.max_signal(windows, loci, ["gene"], "signal").join(genes, "gene")
    binned = B.qcut(strength, metric, n_bins, "strength_bin")
    sig = binned.withColumns({"significant": S.flag(F.col("lrt_padj") < 0.05), "score": S.neg_log10("lrt_padj")})
    chi = T.chi2_contingency(sig, "strength_bin", "significant").select(F.lit("bin_by_significance").alias("test"), F.col("chi2").alias("statistic"), "p_value", "n")
    kw = T.kruskal(sig, "abs_lfc", "strength_bin").select(F.lit("change_by_bin").alias("test"), F.col("h").alias("statistic"), "p_value", "n")
    rho = T.spearman(sig, metric, "score").select(F.lit("strength_by_score").alias("test"), F.col("rho").alias("statistic"), "p_value", "n")
    return sig, _union([chi, kw, rho]), T.over_representation(sig.where("significant"), sig, sets)


def sensitivity(groups: DataFrame, lrt: DataFrame, thresholds: Sequence[float] = (0.01, 0.05, 0.1, 0.2), target: str = "hit", control: str = "control") -> DataFrame:
    """Exact tests of the significant share at several thresholds, against all others and against one group."""
    rows = groups.select("gene", "grp").join(lrt, "gene", "left")
    return T.fisher(A.sweep(rows, "grp", target, control, thresholds, "lrt_padj"), alternative="greater")


def accessible_groups(windows: DataFrame, loci: DataFrame, open_regions: DataFrame, control: DataFrame, times: Sequence[int], key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Groups at each time with only the loci whose centre is in an open region of that time, and how many loci stay.

    ``open_regions`` has a timepoint. All times are one plan: the time goes into the contig's name, or is one of the
    columns that overlapping rows share.
    """
    spread = F.explode(F.array(*map(F.lit, times)))
    at = lambda df: df.withColumn("chrom", F.concat("chrom", F.lit("@"), F.col("timepoint").cast("string")))
    every = at(loci.withColumn("timepoint", spread))
    centred = I.center(every)
    kept = I.overlap_semi(centred, at(open_regions), [key, "timepoint"]).select(key, "timepoint")
    held = every.join(kept.withColumn("_kept", F.lit(True)), [key, "timepoint"], "left")
    report = A.filter_summary(held, S.flag(F.col("_kept")), ["timepoint"])
    near = I.overlap_count(at(windows.withColumn("timepoint", spread)), held.where("_kept"), ["gene", "timepoint"], by=["chrom", "timepoint"])
    flagged = A.flag_in(near, control, "gene", "has_control")
    return flagged.select("timepoint", "gene", S.assign_group(F.col("n_overlaps") > 0, F.col("has_control"), GROUPS).alias("grp")), report


def signal_expression(groups: DataFrame, windows: DataFrame, track: DataFrame, matrix: DataFrame, first: object) -> tuple[DataFrame, DataFrame]:
    """gene, grp, sample_id, log_signal, expression of the active genes, and the silent genes (no signal and no expression in sample ``first``)."""
    signal = I.signal_mean(windows, track, ["gene"]).select("gene", S.log2p1("signal").alias("log_signal"))
    rows = groups.select("gene", "grp").join(signal, "gene").join(matrix.withColumn("expression", S.log2p1("value")), "gene")
    rows = rows.select("gene", "grp", "sample_id", "log_signal", "expression")
    silent = rows.where((F.col("sample_id") == first) & (F.col("log_signal") == 0) & (F.col("expression") == 0)).select("gene", "grp")
    return rows.join(silent.select("gene"), "gene", "left_anti"), silent


def signal_expression_corr(rows: DataFrame) -> DataFrame:
    """Rank correlation of window signal and expression by group and sample, of groups with ten genes."""
    return T.bh_adjust(T.spearman(rows, "log_signal", "expression", by=["grp", "sample_id"], least=10), null_as_one=False)


def signal_expression_intervals(rows: DataFrame, times: int = 1000) -> DataFrame:
    """Bootstrap intervals of the same correlations."""
    return T.bootstrap_spearman(rows, "log_signal", "expression", "gene", by=["grp", "sample_id"], times=times)


def signal_expression_contrast(rows: DataFrame, a: str, b: str, times: int = 10_000) -> DataFrame:
    """Permutation tests of the correlations' difference between two groups, by sample."""
    return T.permutation_test(rows, "log_signal", "expression", "grp", a, b, "gene", by=["sample_id"], times=times)


def uv_master(groups: DataFrame, wide: DataFrame, tpm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per gene with changes, directions, course, first and last hit; and the losses of the join."""
    rows, losses = A.inner_chain(groups.select("gene", "grp"), {"changes": wide, "tpm": tpm}, "gene")
    dirs = [f"dir_{t}" for t in S.TIMES]
    out = rows.withColumns({f"abs_lfc_{t}": F.abs(f"lfc_{t}") for t in S.TIMES} | {f"dir_{t}": S.direction(f"lfc_{t}", f"padj_{t}") for t in S.TIMES})
    return out.withColumns({"abs_lfc_max": S.max_of(*(f"abs_lfc_{t}" for t in S.TIMES)), "trajectory": S.trajectory(dirs, "lrt_padj"), "first_hit": S.first_hit(dirs, S.TIMES), "last_hit": S.first_hit(dirs[::-1], S.TIMES[::-1]), "log2_tpm": S.log2p1("tpm")}), losses


def magnitude(master: DataFrame, groups: Sequence[str] = GROUPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By time: overall test of the size of change, pairs against the first group (one family), summaries."""
    rows = _unpivot(master, ["gene", "grp"], ["abs_lfc"])
    pairs = _union([T.mann_whitney(rows, "abs_lfc", "grp", groups[0], g, by=["time"], alternative=a).withColumns({"against": F.lit(g), "alternative": F.lit(a)}) for g, a in ((g, "greater") for g in groups[1:])])
    summary = rows.groupBy("time", "grp").agg(F.count("abs_lfc").alias("n"), F.avg("abs_lfc").alias("mean"), F.median("abs_lfc").alias("median"))
    return T.kruskal(rows, "abs_lfc", "grp", by=["time"]), T.bh_adjust(pairs), summary


def direction_asymmetry(master: DataFrame, groups: Sequence[str] = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Direction counts by time and group, and exact tests of repressed against induced, first group against the others."""
    rows = _unpivot(master, ["gene", "grp"], ["dir", "lfc"])
    counts = A.direction_counts(rows, ["time", "grp"], "dir", "lfc")
    top = counts.where(F.col("grp") == groups[0]).select("time", F.col("n_repressed").alias("a"), F.col("n_induced").alias("b"))
    rest = counts.where(F.col("grp").isin(*groups[1:])).select("time", F.col("grp").alias("against"), F.col("n_repressed").alias("c"), F.col("n_induced").alias("d"))
    return counts, T.bh_adjust(T.fisher(top.join(rest, "time")))


TRAJECTORIES = ("complex", "repressed_sustained", "repressed_transient", "induced_sustained", "induced_transient", "lrt_only", "not_responsive")


def trajectory_tests(master: DataFrame, groups: Sequence[str] = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Course by group with shares, and exact tests of each course, first group against all others."""
    table = A.contingency(master, "trajectory", "grp", TRAJECTORIES, groups)
    side = F.col("grp") == groups[0]
    hits = master.groupBy("trajectory").agg(F.count_if(side).alias("a"), F.count_if(~side).alias("c"))
    totals = master.agg(F.count_if(side).alias("na"), F.count_if(~side).alias("nc"))
    cells = hits.join(totals).select("trajectory", "a", (F.col("na") - F.col("a")).alias("b"), "c", (F.col("nc") - F.col("c")).alias("d"))
    return table, T.bh_adjust(T.fisher(cells))


def onset_tests(master: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Exact tests of each first-hit time among responders, first group against all others."""
    live = master.where("first_hit <> 'NA'")
    side = F.col("grp") == groups[0]
    hits = live.groupBy("first_hit").agg(F.count_if(side).alias("a"), F.count_if(~side).alias("c"))
    totals = live.agg(F.count_if(side).alias("na"), F.count_if(~side).alias("nc"))
    return T.bh_adjust(T.fisher(hits.join(totals).select("first_hit", "a", (F.col("na") - F.col("a")).alias("b"), "c", (F.col("nc") - F.col("c")).alias("d"))))


def sustained_baseline(master: DataFrame, groups: Sequence[str] = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Baseline expression of the genes of sustained repression by group, and the one-sided test of the first group against the last."""
    rows = master.where("trajectory = 'repressed_sustained'")
    return A.group_summary(rows, "grp", "log2_tpm", groups), T.mann_whitney(rows, "log2_tpm", "grp", groups[0], groups[-1], alternative="greater")


def onset_course(master: DataFrame) -> DataFrame:
    """Median change of significant genes by time and group."""
    long = _unpivot(master.where("lrt_padj < 0.05"), ["gene", "grp"], ["lfc"])
    return long.groupBy("time", "grp").agg(F.count("lfc").alias("n"), F.median("lfc").alias("median"))


def combined_strength(signals: dict[str, DataFrame], key: str = "gene", how: str = "max") -> DataFrame:
    """Rank-normalised signal of each assay, and their largest or mean value (missing as 0 for the mean)."""
    out = None
    for name, s in signals.items():
        known = staged(s.select(key, F.col("signal_max").alias("_v")), "signal")  # read for its values, their number and the ranks
        ranked = B.rank_norm(known, "_v", f"strength_{name}").select(key, f"strength_{name}")
        out = ranked if out is None else out.join(ranked, key, "full_outer")
    cols = [F.col(f"strength_{n}") for n in signals]
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / len(cols)
    return out.withColumn("strength", S.max_of(*cols) if how == "max" else mean)


def strength_predictor(master: DataFrame, strength: DataFrame, n_bins: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rank correlation of strength with each time's change, and directions by strength tertile."""
    rows = master.join(strength.select("gene", "strength"), "gene")
    long = _unpivot(rows, ["gene", "strength"], ["abs_lfc", "dir", "lfc"])
    tertiles = B.qcut(rows.select("gene", "strength"), "strength", n_bins, "tertile").select("gene", "tertile")
    return T.spearman(long, "strength", "abs_lfc", by=["time"]), A.direction_counts(long.join(tertiles, "gene"), ["time", "tertile"], "dir", "lfc")


def matched_magnitude(master: DataFrame, bins: int = 10, groups: Sequence[str] = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Tests of the largest change within expression bins, and what the group adds to expression in a linear model."""
    binned = B.qcut(master, "log2_tpm", bins, "bin")
    tests = T.bh_adjust(T.mann_whitney(binned, "abs_lfc_max", "grp", groups[0], groups[-1], by=["bin"]))
    coded = master.withColumn("in_first", (F.col("grp") == groups[0]).cast("double"))
    return tests, T.nested_gain(coded, "abs_lfc_max", ["log2_tpm"], ["in_first"])


def burden(windows: DataFrame, loci: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locus and gene burden: reads within promoter loci, real over simulated, by product and time (here one per sample).

    ``reads`` has sample_id, product, kind (real, sim), chrom, start, end. Loci are told apart and counted in cells of the contig, without a
    join of reads, and shuffled only as sums of their gene.
    """
    return burden_loci(windows, loci, reads), burden_genes(windows, loci, reads)


def burden_loci(windows: DataFrame, loci: DataFrame, reads: DataFrame) -> DataFrame:
    """Each distinct part that a gene's windows share with loci, over the samples of each product."""
    return _burden(windows, loci, reads, whole=True)


def burden_genes(windows: DataFrame, loci: DataFrame | None, reads: DataFrame) -> DataFrame:
    """The loci of ``burden_loci`` by product and gene; without ``loci`` the windows themselves count as such."""
    return B.zscore(staged(_burden(windows, loci, reads, whole=False), "burden"), "damage_mean", "damage_z", by=["product"])


def burden_of_places(places: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``burden``, for intervals that are given with their genes."""
    return _burden(places, None, reads, whole=True), burden_genes(places, None, reads)


def _burden(windows: DataFrame, loci: DataFrame | None, reads: DataFrame, whole: bool) -> DataFrame:
    longest = min(C.longest(x) for x in (windows, loci) if x is not None)
    if longest > C.WIDE:  # parts longer than any cell: counted by running totals over the contig
        parts = windows if loci is None else I.intersect(windows.select("gene", "chrom", "start", "end"), loci.select("chrom", "start", "end")).withColumnRenamed("gene_a", "gene")
        locus = _long_loci(staged(parts.select("gene", "chrom", "start", "end").distinct(), "places"), reads)
        return locus if whole else _by_gene(locus.groupBy("product", "gene"), F.count_distinct("locus"), F.avg("damage_mean"), F.sum("damage_mean"), F.avg("real_rpkm_mean"))
    totals = reads.groupBy("sample_id", "product").agg(F.count_if(F.col("kind") == "real").alias("real"), F.count_if(F.col("kind") == "sim").alias("sim")).orderBy("product", "sample_id").collect()  # a row for each sample
    products = list(dict.fromkeys(r["product"] for r in totals))
    schema = reads.select("sample_id", "product").schema
    known = reads.sparkSession.createDataFrame([(r["sample_id"], r["product"], k) for k, r in enumerate(totals)], schema.add("_sample", "integer"))
    numbered = reads.where(F.col("kind").isin("real", "sim")).join(F.broadcast(known), ["sample_id", "product"]).withColumn("_real", (F.col("kind") == "real").cast("int"))
    samples = [(products.index(r["product"]), r["real"], r["sim"]) for r in totals]
    rows = C.shared_part_rates(windows, loci, numbered, longest, samples, whole)
    named = reads.sparkSession.createDataFrame([(p, k) for k, p in enumerate(products)], reads.select("product").schema.add("_product", "integer"))
    rows = rows.join(F.broadcast(named), "_product")
    if whole:
        return rows.select("product", "gene", S.locus_id("chrom", "start", "end", "gene").alias("locus"), "n_samples", "real_rpkm_mean", "real_rpkm_max", "sim_rpkm_mean", "damage_mean", "damage_max")
    n = F.sum("n_loci")
    return _by_gene(rows.groupBy("product", "gene"), n, F.sum("damage_sum") / n, F.sum("damage_sum"), F.sum("real_rpkm_sum") / n, "real_rpkm_max")


def _by_gene(rows, n: Column, mean: Column, total: Column, real_mean: Column, real_max: str = "real_rpkm_max") -> DataFrame:
    return rows.agg(n.alias("n_loci"), F.max("damage_max").alias("damage_max"), mean.alias("damage_mean"), total.alias("damage_sum"), F.max(real_max).alias("real_rpkm_max"), real_mean.alias("real_rpkm_mean"))


def _long_loci(places: DataFrame, reads: DataFrame) -> DataFrame:
    places = places.withColumn("locus", S.locus_id("chrom", "start", "end", "gene"))
    totals = reads.groupBy("sample_id", "product").agg(F.count_if(F.col("kind") == "real").alias("total_real"), F.count_if(F.col("kind") == "sim").alias("total_sim"))
    grid = places.select("locus", "gene", "chrom", "start", "end", (F.col("end") - F.col("start")).alias("length")).join(totals)  # the result has a row for each locus and sample
    kinds = {k: (F.col("kind") == k).cast("long") for k in ("real", "sim")}
    full = I.overlap_sums(grid, reads, kinds, by=["chrom", "sample_id", "product"])
    rated = full.withColumns({"real_rpkm": S.rpkm("real", "length", "total_real"), "sim_rpkm": S.rpkm("sim", "length", "total_sim")}).withColumn("damage", S.log2_ratio("real_rpkm", "sim_rpkm"))
    return rated.groupBy("product", "gene", "locus").agg(F.count("*").alias("n_samples"), F.avg("real_rpkm").alias("real_rpkm_mean"), F.max("real_rpkm").alias("real_rpkm_max"), F.avg("sim_rpkm").alias("sim_rpkm_mean"), F.avg("damage").alias("damage_mean"), F.max("damage").alias("damage_max"))


def burden_master(gene_burden: DataFrame, master: DataFrame, strength: DataFrame | None) -> DataFrame:
    """Burden, response and strength (if given) in one row per product and gene; no signal counts as strength 0."""
    rows = gene_burden.join(master, "gene")
    if strength is not None:
        rows = rows.join(strength.select("gene", "strength"), "gene", "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    return rows.withColumns({f"repressed_{t}": S.flag(F.col(f"dir_{t}") == "repressed") for t in S.TIMES} | {"sustained": S.flag(F.col("trajectory") == "repressed_sustained")})


def burden_tertiles(bm: DataFrame, value: str = "damage_mean") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """By product and time: changes by burden tertile; tests of signed and absolute change; chi-square and exact tests of responses.

    The tests are long tables (product, time, test, comparison, statistic, p_value), one-sided and adjusted by product.
    Each of the four parts can be had by itself.
    """
    long = tertile_rows(bm, value)
    return tertile_summary(long), tertile_tests(long), tertile_responses(long), tertile_outcomes(long)


def tertile_rows(bm: DataFrame, value: str = "damage_mean") -> DataFrame:
    """A row for each row of ``bm`` and time with the tertile of burden."""
    binned = B.qcut(bm, value, 3, "tertile", by=["product"]).withColumn("tertile", F.concat(F.lit("T"), F.col("tertile").cast("string")))
    return _unpivot(binned, ["product", "gene", "tertile", "sustained"], ["lfc", "dir"]).withColumn("abs_lfc", F.abs("lfc"))


def tertile_summary(long: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return long.groupBy("product", "time", "tertile").agg(
        F.count("lfc").alias("n"), F.avg("lfc").alias("mean"), F.median("lfc").alias("median"), F.median("abs_lfc").alias("median_abs"),
        share(F.col("dir") == "repressed").alias("repressed"), share(F.col("dir") == "induced").alias("induced"), share(F.col("lfc") > 1).alias("over_1"), share(F.col("lfc") > 2).alias("over_2"),
    )


def _told(df: DataFrame, test: str, comparison: str, statistic: str) -> DataFrame:
    return df.select("product", "time", F.lit(test).alias("test"), F.lit(comparison).alias("comparison"), F.col(statistic).alias("statistic"), "p_value")


def tertile_tests(long: DataFrame) -> DataFrame:
    by = ["product", "time"]
    parts = [_told(T.kruskal(long, "lfc", "tertile", by=by, least=3), "kruskal", "all", "h")]
    for low in ("T1", "T2"):
        for col, name in (("lfc", "signed"), ("abs_lfc", "absolute")):
            parts.append(_told(T.mann_whitney(long, col, "tertile", "T3", low, by=by, alternative="greater"), f"ranks_{name}", f"T3_{low}", "u"))
    return T.bh_adjust(_union(parts), family=["product"])


def tertile_responses(long: DataFrame) -> DataFrame:
    return _told(T.chi2_contingency(long.withColumn("dir", F.coalesce("dir", F.lit("not_sig"))), "tertile", "dir", by=["product", "time"]), "chi2", "all", "chi2")


def tertile_outcomes(long: DataFrame) -> DataFrame:
    high = F.coalesce(F.col("tertile") == "T3", F.lit(False))
    outcome = F.explode(F.array(*(F.struct(F.lit(n).alias("outcome"), F.coalesce(c, F.lit(False)).alias("yes")) for n, c in (("repressed", F.col("dir") == "repressed"), ("sustained", F.col("sustained"))))))
    cells = long.select("product", "time", high.alias("high"), outcome.alias("x")).groupBy("product", "time", "x.outcome").agg(*(F.count_if(h & y).alias(c) for c, h, y in (("a", F.col("high"), F.col("x.yes")), ("b", F.col("high"), ~F.col("x.yes")), ("c", ~F.col("high"), F.col("x.yes")), ("d", ~F.col("high"), ~F.col("x.yes")))))
    return T.bh_adjust(T.fisher(cells, alternative="greater"), family=["product"])


def standardised(bm: DataFrame, value: str) -> tuple[DataFrame, list[str]]:
    """``bm`` with burden, expression and strength as z-scores of their product."""
    cols = {"z_burden": value, "z_tpm": "log2_tpm", "z_strength": "strength"}
    return B.zscores(bm.where(F.col(value).isNotNull()), cols, by=["product"]), list(cols)


def burden_models(bm: DataFrame, value: str = "damage_mean") -> dict[str, DataFrame]:
    """By product: correlations, partial correlation and covariate models of burden and response.

    correlations (burden with each change, the absolute last one, strength and expression, adjusted by
    product), partial (given expression, by time), linear and comparison (with and without burden) by time.
    Each of the four parts can be had by itself.
    """
    times, xs = coded_times(bm, value)
    return {"correlations": burden_correlations(bm, value), "partial": burden_partial(bm, value), "linear": burden_linear(times, xs), "comparison": burden_comparison(times, xs)}


def burden_correlations(bm: DataFrame, value: str = "damage_mean") -> DataFrame:
    last = S.TIMES[-1]
    pairs = [(f"lfc_{t}", F.col(f"lfc_{t}")) for t in S.TIMES] + [(f"abs_lfc_{last}", F.abs(f"lfc_{last}")), ("strength", F.col("strength")), ("log2_tpm", F.col("log2_tpm"))]
    targets = bm.select("product", F.col(value).alias("burden"), F.explode(F.array(*(F.struct(F.lit(n).alias("target"), c.cast("double").alias("other")) for n, c in pairs))).alias("_x")).select("product", "burden", "_x.*")
    return T.bh_adjust(T.spearman(targets, "burden", "other", by=["product", "target"], least=5), family=["product"], null_as_one=False)


def burden_partial(bm: DataFrame, value: str = "damage_mean") -> DataFrame:
    return T.partial_spearman_each(bm, value, {t: f"lfc_{t}" for t in S.TIMES}, "log2_tpm", by=["product"], name="time")


def coded_times(bm: DataFrame, value: str = "damage_mean") -> tuple[DataFrame, list[str]]:
    """``standardised`` with a row for each time."""
    coded, xs = standardised(bm, value)
    return _unpivot(staged(coded.select("product", "gene", *xs, *(f"lfc_{t}" for t in S.TIMES)), "coded"), ["product", "gene", *xs], ["lfc"]), xs


def burden_linear(times: DataFrame, xs: Sequence[str]) -> DataFrame:
    return T.linear_models(times, "lfc", xs, by=["product", "time"])


def burden_comparison(times: DataFrame, xs: Sequence[str]) -> DataFrame:
    return T.nested_gain(times, "lfc", xs[1:], xs[:1], by=["product", "time"])


def burden_logistic(bm: DataFrame, value: str = "damage_mean") -> DataFrame:
    """By product, logistic models of repression at each time and of the sustained course."""
    coded, xs = standardised(bm, value)
    outcomes = [(f"repressed_{t}", F.col(f"repressed_{t}")) for t in S.TIMES] + [("sustained", F.col("sustained"))]
    hits = coded.select("product", *xs, F.explode(F.array(*(F.struct(F.lit(n).alias("outcome"), c.cast("double").alias("yes")) for n, c in outcomes))).alias("_x")).select("product", *xs, "_x.*")
    return T.logistic_models(hits, "yes", xs, by=["product", "outcome"])


def burden_by_trajectory(bm: DataFrame, value: str = "damage_mean", against: str = "not_responsive") -> dict[str, DataFrame]:
    """By product: burden over courses; each course against no response; sustained repression in halves of expression. Each can be had by itself."""
    return {"overall": burden_of_courses(bm, value), "pairs": burden_course_pairs(bm, value, against), "halves": burden_halves(bm, value, against)}


def burden_of_courses(bm: DataFrame, value: str = "damage_mean") -> DataFrame:
    return T.kruskal(bm, value, "trajectory", by=["product"], least=3)


def burden_course_pairs(bm: DataFrame, value: str = "damage_mean", against: str = "not_responsive") -> DataFrame:
    pairs = [T.mann_whitney(bm, value, "trajectory", t, against, by=["product"], alternative="two-sided").withColumn("course", F.lit(t)) for t in TRAJECTORIES if t != against]
    return T.bh_adjust(_union(pairs).where("n_a >= 3 and n_b >= 3"), family=["product"])


def burden_halves(bm: DataFrame, value: str = "damage_mean", against: str = "not_responsive") -> DataFrame:
    halves = B.qcut(bm, "log2_tpm", 2, "half", by=["product"])
    return T.mann_whitney(halves, value, "trajectory", "repressed_sustained", against, by=["product", "half"], alternative="greater")


def trajectory_logistic(bm: DataFrame, value: str = "damage_mean", against: str = "not_responsive") -> DataFrame:
    """By product, a logistic model of sustained repression against no response."""
    coded, xs = standardised(bm.where(F.col("trajectory").isin("repressed_sustained", against)), value)
    return T.logistic_models(coded.withColumn("yes", F.col("sustained").cast("double")), "yes", xs, by=["product"])


def specificity(bm: DataFrame, windows: DataFrame, master: DataFrame, reads: DataFrame, background: DataFrame, value: str = "damage_max", groups: Sequence[str] = GROUPS) -> dict[str, DataFrame]:
    """Is the burden special to the first group? By product.

    matched: median burden of the first and the last group within each side's own expression deciles.
    The last group's windows count as loci. interaction: change at each time on burden, group, their product
    and expression, where both sides have ten genes. background: burden of intervals outside genes against the first group's.
    Each part can be had by itself.
    """
    both, outside = specific_sides(bm, windows, master, reads, value, groups), outside_burden(background, reads)
    return {"matched": matched_burden(both), "interaction": burden_interaction(both), "background": background_test(bm, outside, value, groups), "background_summary": background_summary(outside, value)}


def _first_side(bm: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    return bm.where((F.col("grp") == groups[0]) & F.col(value).isNotNull())


def specific_sides(bm: DataFrame, windows: DataFrame, master: DataFrame, reads: DataFrame, value: str = "damage_max", groups: Sequence[str] = GROUPS) -> DataFrame:
    """Burden, expression and changes of the genes of the first group (``in_first`` 1) and the last (0)."""
    other = burden_genes(windows.join(master.where(F.col("grp") == groups[-1]).select("gene"), "gene", "left_semi").select("gene", "chrom", "start", "end"), None, reads)
    lfc = [f"lfc_{t}" for t in S.TIMES]
    control = other.join(master, "gene").select("product", "gene", F.col(value).alias("burden"), "log2_tpm", *lfc, F.lit(0.0).alias("in_first"))
    target = _first_side(bm, value, groups).select("product", "gene", F.col(value).alias("burden"), "log2_tpm", *lfc, F.lit(1.0).alias("in_first"))
    return staged(target.unionByName(control.where("burden is not null")), "specific")


def matched_burden(both: DataFrame) -> DataFrame:
    deciles = B.qcut(both, "log2_tpm", 10, "decile", by=["product", "in_first"]).groupBy("product", "decile")
    matched = deciles.agg(*(f.alias(n) for k, side in (("first", 1.0), ("last", 0.0)) for n, f in ((f"n_{k}", F.count_if(F.col("in_first") == side)), (f"median_{k}", F.median(F.when(F.col("in_first") == side, F.col("burden")))))))
    return matched.where("n_first >= 3 and n_last >= 3")


def burden_interaction(both: DataFrame) -> DataFrame:
    enough = both.groupBy("product").agg(F.count_if(F.col("in_first") == 1).alias("n1"), F.count_if(F.col("in_first") == 0).alias("n0")).where("least(n1, n0) >= 10")
    rows = _unpivot(B.zscore(both, "burden", "z_burden", by=["product"]).join(enough, "product", "left_semi"), ["product", "gene", "z_burden", "in_first", "log2_tpm"], ["lfc"])
    return T.linear_models(rows, "lfc", ["z_burden", "in_first", "log2_tpm"], [("z_burden", "in_first")], by=["product", "time"], least=30)


def outside_burden(background: DataFrame, reads: DataFrame) -> DataFrame:
    """Burden of intervals outside genes, each named by its place."""
    return burden_genes(background.withColumn("gene", F.concat_ws(":", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))), None, reads)


def background_test(bm: DataFrame, outside: DataFrame, value: str = "damage_max", groups: Sequence[str] = GROUPS) -> DataFrame:
    sides = _first_side(bm, value, groups).select("product", F.col(value).alias("burden"), F.lit("first").alias("side")).union(outside.select("product", F.col(value), F.lit("background")).where(F.col(value).isNotNull()))
    return T.mann_whitney(sides, "burden", "side", "first", "background", by=["product"])


def background_summary(outside: DataFrame, value: str = "damage_max") -> DataFrame:
    return outside.groupBy("product").agg(F.count("*").alias("n_loci"), F.count(value).alias("n_quantified"), F.median(value).alias("median"), F.avg(value).alias("mean"))


def metric_sweep(bm: DataFrame, metrics: Sequence[str] = ("damage_max", "damage_mean", "damage_sum", "real_rpkm_mean"), outcome: str = "lfc_60") -> DataFrame:
    """Rank correlation of each burden measure with an outcome, by product."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))
    return T.spearman(bm.select("product", outcome, F.explode(rows).alias("_x")).select("product", outcome, "_x.*"), "value", outcome, by=["product", "metric"])


def matched_difference(a: DataFrame, b: DataFrame, stratify: str, value: str, q: int = 10, least: int = 3) -> DataFrame:
    """Mean difference within strata that each side takes from its own quantiles, where both have enough rows."""
    parts = [B.qcut(x, stratify, q, "stratum").groupBy("stratum").agg(F.count(value).alias(f"n_{k}"), F.avg(value).alias(f"mean_{k}")).where(F.col(f"n_{k}") >= least) for k, x in (("a", a), ("b", b))]
    return parts[0].join(parts[1], "stratum").withColumn("difference", F.col("mean_a") - F.col("mean_b"))


def metaprofile_by_group(groups: DataFrame, genes: DataFrame, track: DataFrame, flank: int = 2000, step: int = 50) -> tuple[DataFrame, DataFrame]:
    """The start points of each group's genes (gene, chrom, tss, strand given), and the mean signal around them by distance bin."""
    points = genes.join(groups.select("gene", "grp"), "gene").select("gene", "grp", "chrom", F.col("tss").alias("pos"), "strand")
    return points, I.metaprofile(points, track, flank, step, "grp", "gene")


def gene_matrices(quant: DataFrame, tx2gene: DataFrame, least: float = 10, samples: int = 3) -> DataFrame:
    """gene_id, sample_id, tpm, num_reads and normalised reads of the genes that pass the count filter."""
    genes = M.prefilter(M.tx_to_gene(quant, tx2gene), "gene_id", "num_reads", least, samples)
    return M.normalize_counts(genes, "gene_id", "sample_id", "num_reads")


def headline(tables: dict[str, dict[str, Column]], frames: dict[str, DataFrame]) -> DataFrame:
    """(section, metric, value) rows: one aggregate per table, stacked."""
    parts = []
    for section, metrics in tables.items():
        one = frames[section].agg(*(c.cast("double").alias(m) for m, c in metrics.items()))
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x")).select("x.*"))
    return _union(parts)
