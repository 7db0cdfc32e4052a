"""Boundaries, properties and textbook values."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locuspark.functions import pvalues as P
from locuspark.functions import scalars as S
from locuspark.functions import sequence as Q
from locuspark.operators import binning as B
from locuspark.operators import intervals as I
from locuspark.operators import matrix as M
from locuspark.operators import stats as T
from locuspark.operators import summaries as A
from locuspark.sources import readers as R


def ivs(spark, rows):
    return spark.createDataFrame(rows, "id long, chrom string, start long, end long")


def random_intervals(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start = rng.randrange(500)
        out.append((k, f"c{rng.randrange(2)}", start, start + rng.choice([0, 1, 5, 60, 300])))
    return out


@pytest.mark.parametrize("width", [1, 16, 1 << 14])
def test_overlap_join_equals_theta_join(spark, width):
    a, b = random_intervals(1, 60), random_intervals(2, 60)
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3])}
    got = [(r[0], r[1]) for r in I.overlap_pairs(ivs(spark, a), ivs(spark, b), width).select("id_a", "id_b").collect()]
    assert set(got) == want and len(got) == len(want)


def test_overlaps_of_all_lengths_and_hot_cells(spark, monkeypatch):
    """Levels from one base to a contig, and cells whose rows are dealt out on one or both sides."""
    monkeypatch.setattr(I, "FACTOR", 4)
    rng = random.Random(6)
    sides = []
    for n in (70, 90):
        rows = [(k, f"c{rng.randrange(2)}", at := rng.randrange(4000), at + rng.choice([1, 3, 20, 300, 4000, 0, -2])) for k in range(n)]
        sides.append([*rows, (n, None, 0, 9), (n + 1, "c0", 0, 20_000), (n + 2, "c0", None, 5), *((n + 3 + k, "c1", 100, 104) for k in range(40))])
    a, b = sides
    want = {(x[0], y[0]): min(x[3], y[3]) - max(x[2], y[2]) for x in a for y in b if x[1] and x[1] == y[1] and x[2] is not None and y[2] is not None and max(x[2], y[2]) < min(x[3], y[3])}
    for rows in (1 << 16, 7):
        monkeypatch.setattr(I, "CELL_ROWS", rows)
        got = I.overlap_pairs(ivs(spark, a), ivs(spark, b), 4).select("id_a", "id_b", "overlap_bp").collect()
        assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)
    shared = I.intersect(ivs(spark, a), ivs(spark, b), 4)
    assert shared.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == sum(want.values())
    assert I.overlap_pairs(ivs(spark, a), ivs(spark, []), 4).count() == 0


def test_a_contig_long_interval_is_listed_a_few_times_and_pile_ups_are_dealt_out(spark, monkeypatch):
    long = ivs(spark, [(0, "c", 0, 250_000_000)])
    reads = spark.range(3000).selectExpr("id", "'c' as chrom", "1000000 + id % 7 as start", "1000100 + id % 7 as end")
    levels = [[*x] for x in I._levels([long, reads], I.BIN)]
    assert len(levels[0]) == 1 and levels[0][0] > 3 and levels[1] == [0]
    sides = [I._cells(long, I.BIN, *levels, 0), I._cells(reads, I.BIN, *levels[::-1], 1)]
    assert sides[0].count() <= I.SPAN + 1 and sides[1].count() <= 2 * 3000
    monkeypatch.setattr(I, "CELL_ROWS", 100)
    a, b = I._dealt(sides)
    tasks = b.groupBy(*I.CELL, "_i", "_j").count().agg(F.count("*"), F.max("count")).first()
    assert tasks[0] >= 30 and tasks[1] < 200 and a.select("_j").distinct().count() >= 30
    assert I.overlap_pairs(long, reads).count() == 3000


@pytest.mark.parametrize("rows", [1 << 20, 5])
def test_counts_and_means_without_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(B, "RANGE_ROWS", rows)
    a, b = random_intervals(11, 60), random_intervals(12, 90)
    a += [(60, None, 0, 5), (61, "c9", 3, 8), (62, "c0", 5, 2)]
    b += [(90, None, 0, 5), *((91 + k, "c1", 100, 140) for k in range(50))]
    values = [random.Random(k).choice([0.0, 1.5, -2.0, 7.25, 1e6]) for k in range(len(b))]
    track = spark.createDataFrame([(*r, v) for r, v in zip(b, values, strict=True)], "id long, chrom string, start long, end long, value double")
    shared = lambda x, y: max(0, min(x[3], y[3]) - max(x[2], y[2])) if x[1] == y[1] and x[1] else 0
    got = {r["id"]: r["n_overlaps"] for r in I.overlap_count(ivs(spark, a), track, ["id"]).collect()}
    assert got == {x[0]: sum(shared(x, y) > 0 for y in b) for x in a}
    by_sign = I.overlap_totals(ivs(spark, a), track, ["id"], {"up": (F.col("value") > 0).cast("long"), "down": (F.col("value") < 0).cast("long")})
    assert {r["id"]: (r["up"], r["down"]) for r in by_sign.collect()} == {x[0]: tuple(sum(shared(x, y) > 0 and v * s > 0 for y, v in zip(b, values, strict=True)) for s in (1, -1)) for x in a}
    means = {r["id"]: r["signal"] for r in I.signal_mean(ivs(spark, a), track, ["id"]).collect()}
    for x in a:
        assert means[x[0]] == pytest.approx(sum(v * shared(x, y) for y, v in zip(b, values, strict=True)) / max(1, x[3] - x[2]), abs=1e-6)
    points = spark.createDataFrame([(k, "c0", 37 * k % 500, "-" if k % 3 else "+", k % 2) for k in range(40)], "k long, chrom string, pos long, strand string, g long")
    profile = {(r["g"], r["bin"]): (r["n"], r["signal"]) for r in I.metaprofile(points, track, 40, 8, "g", "k").collect()}
    sums, members = {}, {0: set(), 1: set()}
    for p in points.collect():
        for k in range(10):
            x = (0, "c0", p["pos"] - 40 + 8 * k, p["pos"] - 32 + 8 * k)
            if any(shared(x, y) and v for y, v in zip(b, values, strict=True)):
                members[p["g"]].add(p["k"])
            at = p["g"], 9 - k if p["strand"] == "-" else k
            sums[at] = sums.get(at, 0) + sum(v * shared(x, y) for y, v in zip(b, values, strict=True)) / 8
    assert set(profile) == set(sums)
    for at, (n, v) in profile.items():
        assert n == len(members[at[0]]) and v == pytest.approx(sums[at] / n, abs=1e-5)


def test_maximum_over_overlaps_without_pairs(spark):
    a, b = random_intervals(21, 60), random_intervals(22, 90)
    a += [(60, None, 0, 5), (61, "c9", 3, 8), (62, "c0", 5, 2), (63, "c1", 0, 10**9), (64, "c0", 7, 8)]
    b += [(90, None, 0, 5), (91, "c0", 0, 10**9), (92, "c1", 0, 1), *((93 + k, "c1", 100, 140) for k in range(50))]
    values = [None if k % 11 == 0 else float(k * 37 % 23 - 9) for k in range(len(b))]
    track = spark.createDataFrame([(*r, v) for r, v in zip(b, values, strict=True)], "id long, chrom string, start long, end long, value double")
    want = {}
    for x in a:
        hits = [(v, min(x[3], y[3]) - max(x[2], y[2])) for y, v in zip(b, values, strict=True) if x[1] and x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3])]
        known = [v for v, _ in hits if v is not None]
        if hits:
            want[x[0]] = (sum(known) if known else None, sum(known) / len(known) if known else None, max(known, default=None), len(hits), sum(n for _, n in hits))
    got = {r["id"]: tuple(r)[1:] for r in I.max_signal(ivs(spark, a), track, ["id"], "value").collect()}
    assert got == {k: pytest.approx(v) if None not in v else v for k, v in want.items()}
    assert I.max_signal(ivs(spark, a), track.where("false"), ["id"], "value").count() == 0
    plan = I.max_signal(ivs(spark, a), track, ["id"], "value")._jdf.queryExecution().optimizedPlan().toString()
    assert " least(" not in plan


def test_counting_plans_join_no_intervals(spark):
    a, b = ivs(spark, random_intervals(1, 20)), ivs(spark, random_intervals(2, 20)).withColumn("value", F.lit(1.0))
    for df in (I.overlap_count(a, b, ["id"]), I.signal_mean(a, b, ["id"]), I.metaprofile(a.selectExpr("id", "chrom", "start as pos", "'+' as strand", "1 as g"), b, 20, 5, "g", "id")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert " least(" not in plan and "CartesianProduct" not in plan and "Cross" not in plan
    deep = spark.range(10_000).selectExpr("id", "'c' as chrom", "id % 300 as start", "1000 + id % 77 as end")
    assert {r["n_overlaps"] for r in I.overlap_count(deep, deep, ["id"]).collect()} == {10_000}


@pytest.mark.parametrize("rows", [1 << 20, 7])
def test_running_totals_over_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(B, "RANGE_ROWS", rows)
    rng = random.Random(3)
    values = {(rng.choice(["a", None, "b"]), rng.randrange(-50, 50)): rng.randrange(9) for _ in range(150)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in values.items()], "g string, v long, n long")
    got = {(r["g"], r["v"]): r["below_n"] for r in B.running_totals(df, "v", ["n"], ["g"]).collect()}
    assert got == {(g, v): sum(m for (h, w), m in values.items() if h == g and w < v) for g, v in values}
    assert B.running_totals(df.where("false"), "v", ["n"]).count() == 0
    big = spark.range(60).withColumn("id", F.col("id") + 10**15)
    assert [r["number"] for r in B.number_rows(big, "id").orderBy("id").collect()] == list(range(1, 61))


def test_semi_and_anti_make_the_input(spark):
    a, b = ivs(spark, random_intervals(3, 80)), ivs(spark, random_intervals(4, 8))
    hit, miss = I.overlap_semi(a, b, ["id"]).count(), I.overlap_anti(a, b, ["id"]).count()
    assert hit + miss == 80 and hit and miss


def test_merge_joins_touching_intervals_and_is_idempotent(spark):
    rows = ivs(spark, [(1, "a", 0, 5), (2, "a", 5, 9), (3, "a", 10, 12), (4, "b", 0, 3), (5, "a", 1, 30)])
    once = I.merge(rows, width=4)
    assert {tuple(r) for r in once.collect()} == {("a", 0, 30, 4), ("b", 0, 3, 1)}
    assert {tuple(r)[:3] for r in I.merge(once).collect()} == {tuple(r)[:3] for r in once.collect()}


def test_fasta_over_many_byte_ranges(spark, tmp_path):
    rng = random.Random(1)
    contigs = [(n, "".join(rng.choice("acgtN") for _ in range(size))) for n, size in (("chr1 first", 5000), ("chr2", 0), ("chr3", 1), ("chr1 again", 777), ("", 30), ("chrM", 1234))]
    text = "ACGT\n" + "".join(f">{n}\n" + "".join(seq[k : k + 60] + rng.choice(["\n", "\n", "\n\n", " \r\n"]) for k in range(0, len(seq), 60)) for n, seq in contigs)
    (tmp_path / "x.fa").write_text(text)
    want = sorted((n.split(" ")[0], k, seq[k : k + 100].upper()) for n, seq in contigs for k in range(0, len(seq), 100))
    for size in ("134217728", "300", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = sorted(map(tuple, R.read_fasta_chunks(spark, str(tmp_path / "x.fa"), 100).collect()))
            parts = spark.read.text(str(tmp_path / "x.fa")).rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want and parts > len(text) // int(size) // 2
    assert {r["chrom"] for r in R.read_fasta_chunks(spark, str(tmp_path / "x.fa"), 64, ["chrM", "chr9"]).collect()} == {"chrM"}


def test_rows_keep_the_order_of_their_source(spark, tmp_path):
    rows = [f"c\t{k}\t{k + (k % 5 > 0)}\t{'.' if k % 2 else f'n{k}'}" for k in range(400)]
    (tmp_path / "a.bed").write_text("# comment\n" + "\n\n".join(rows[:300]) + "\n")
    (tmp_path / "b.bed").write_text("\n".join(rows[300:]))
    for size in ("134217728", "200"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = R.fill_names(R.read_bed(spark, str(tmp_path), index="row_index"), "d").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {(r["start"], r["row_index"], r["name"]) for r in got} == {(k, k, f"d_{k}" if k % 2 else f"n{k}") for k in range(400) if k % 5}


def test_numbers_by_several_columns_of_real_size(spark):
    rows = [(2, 5, 1), (1, 150_000_000, 3), (1, 250_000_000, 20_000_000), (1, 250_000_000, 2), (3, 1, 1)]
    df = spark.createDataFrame(rows, "place int, start long, id long")
    assert [tuple(r)[:3] for r in B.number_rows(df, ["place", "start", "id"]).orderBy("number").collect()] == sorted(rows)


def test_gene_sets_of_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("g1,x\n g2\n\ng1\n")
    rows = spark.createDataFrame([("a", "one.txt", "z"), ("b", None, "g3, g4,"), ("c", "none.txt", None), ("d", str(tmp_path / "one.txt"), None)], "geneset string, filename string, gene_ids string")
    got = {tuple(r) for r in R.read_gene_set_manifest(rows, str(tmp_path)).collect()}
    assert got == {("a", "g1"), ("a", "g2"), ("b", "g3"), ("b", "g4"), ("d", "g1"), ("d", "g2")}
    assert R.read_gene_set_manifest(rows.select("filename")).count() == 0


def test_tiles_restart_and_drop_the_rest(spark):
    got = I.tile(spark.createDataFrame([("c", 0, "ABCDEFG"), ("d", 3, "AB")], "chrom string, start long, seq string"), 3).collect()
    assert [(r["start"], r["end"], r["seq"]) for r in got] == [(0, 3, "ABC"), (3, 6, "DEF")]


def test_motif_spans_on_both_strands(spark):
    g = "AAGGGTAGGGTAGGGTAGGGCC"
    rc = g[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(0, g), (1, rc), (2, "ACGT")], "id long, seq string").select("id", Q.classify_both_strands("seq").alias("m"))
    got = {r["id"]: r["m"] for r in df.collect()}
    assert (got[0]["structure"], got[0]["strand"], got[0]["span_start"], got[0]["span_end"]) == ("loop1_3", "+", 2, 20)
    assert (got[1]["structure"], got[1]["strand"]) == ("loop1_3", "-") and got[2]["structure"] == "other"
    at = spark.range(1).select(Q.span_to_coords(F.lit(100), F.lit(122), F.lit("-"), F.lit(2), F.lit(20)).alias("x")).first()["x"]
    assert tuple(at) == (102, 120, 111)


def test_qcut_equals_pandas(spark):
    rng = np.random.Generator(np.random.PCG64(0))
    values = [float(v) for v in rng.integers(0, 12, 200)] + [None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double")
    got = {r["id"]: r["bin"] for r in B.qcut(df, "v", 10).collect()}
    want = pd.qcut(pd.Series(values, dtype=float), 10, labels=False, duplicates="drop") + 1
    assert got == {k: None if math.isnan(w) else int(w) for k, w in enumerate(want)}


def test_ranks_equal_pandas(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, None, -5.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double")
    got = {r["id"]: r["rank"] for r in B.avg_rank(df, "v").collect()}
    assert got == {k: None if math.isnan(r) else r for k, r in enumerate(pd.Series(values).rank())}


@pytest.mark.parametrize("rows", [1 << 20, 6])
def test_islands_over_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(B, "RANGE_ROWS", rows)
    rng = random.Random(8)
    given = [(k, rng.choice(["a", "b"]), at := rng.randrange(3000), at + rng.choice([1, 5, 20, 400 if k % 20 == 0 else 2])) for k in range(160)]
    want = set()
    for c in "ab":
        low = high = n = None
        for _, _, s, e in sorted(r for r in given if r[1] == c for r in [(0, 0, *r[2:])]):
            if high is not None and s <= high:
                high, n = max(high, e), n + 1
                continue
            if high is not None:
                want.add((c, low, high, n))
            low, high, n = s, e, 1
        want.add((c, low, high, n))
    assert {tuple(r) for r in I.merge(ivs(spark, given), width=16).collect()} == want


def test_samples_of_groups_and_first_rows(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 10 > 2 then 'big' when id < 40 then null when id % 10 = 2 then 'b' else 'c' end as g")
    keys = [(r["g"], r["id"]) for r in rows.collect()]
    order = lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest()
    for k in (1, 3, 700, 4000):
        got = {tuple(r) for r in B.sample_k(rows, k, "id", by=["g"]).select("g", "id").collect()}
        assert got == {(g, i) for g in {g for g, _ in keys} for i in sorted((i for h, i in keys if h == g), key=order)[:k]}
    first = B.first_by(rows, ["g"], [F.desc("id")])
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString() and {tuple(r) for r in first.select("g", "id").collect()} == {(g, max(i for h, i in keys if h == g)) for g in {g for g, _ in keys}}


def test_counting_runs_first_changes_no_motif_call(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("GGGGGATC" if k % 2 else "GgaTC") for _ in range(rng.choice([8, 30, 90]))) for k in range(400)] + ["", None, "GGGAGGGAGGGAGGG", "GGAGGAGGAGG", "GGAGGAGG"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(seqs)], "k long, seq string").select("k", Q.motif_class("seq").alias("m"), Q.classify_motif("seq")["structure"].alias("c"))
    for r in df.collect():
        v = seqs[r["k"]]
        want = None if v is None else next((n for n, ps in Q.MOTIFS for p in ps if re.search(p, v)), "other")
        assert r["m"] == want and r["c"] == (want or "other")
    assert {Q.least_runs(p, 2) for _, patterns in Q.MOTIFS for p in patterns} == {4}
    assert [name for name, patterns in Q.MOTIFS if min(Q.least_runs(p, 3) for p in patterns) == 4] == ["loop1_3", "loop4_5", "loop6_7", "longLoop"]


def test_sample_needs_enough_rows(spark):
    with pytest.raises(ValueError):
        B.sample_k(spark.range(5), 6, "id")
    with pytest.raises(ValueError):
        R.assert_min_rows(spark.range(5), 6)


def test_bh_is_monotone_and_treats_nulls(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(p)], "id long, p_value double")
    one = {r["id"]: r["p_adj"] for r in T.bh_adjust(df).collect()}
    assert one[0] == pytest.approx(0.05) and one[1] == one[2] == pytest.approx(0.2 / 3) and one[3] == 1.0
    out = {r["id"]: r["p_adj"] for r in T.bh_adjust(df, null_as_one=False).collect()}
    assert out[0] == pytest.approx(0.04) and out[3] is None


def test_labels(spark):
    row = spark.range(1).select(
        S.direction(F.lit(0.6), F.lit(0.01)).alias("a"), S.direction(F.lit(-0.6), F.lit(0.01)).alias("b"), S.direction(F.lit(0.6), F.lit(None).cast("double")).alias("c"),
        S.trajectory([F.lit("repressed"), F.lit("not_sig"), F.lit("repressed")], F.lit(1.0)).alias("d"), S.trajectory([F.lit("repressed"), F.lit("induced"), F.lit("not_sig")], F.lit(1.0)).alias("e"),
        S.response_label(F.lit(0.01), [F.lit("not_sig")] * 3).alias("f"), S.first_hit([F.lit("not_sig"), F.lit("induced"), F.lit("induced")], S.TIMES).alias("g"),
        S.strip_version(F.lit("ENSG1.20_PAR_Y"), "number").alias("h"), S.strip_version(F.lit("ENSG1.20_PAR_Y"), "first").alias("i"), S.strip_version(F.lit("ENSG1.20_PAR_Y"), "last").alias("j"),
        S.number_or_null(F.lit("NA")).alias("k"), S.number_or_null(F.lit("2.5")).alias("l"),
    ).first()
    assert tuple(row) == ("repressed", "induced", "not_sig", "repressed_sustained", "complex", "sig_lrt_no_pairwise", "30", "ENSG1.20_PAR_Y", "ENSG1", "ENSG1", None, 2.5)


def test_tail_probabilities():
    assert P.normal_sf(1.959963984540054) == pytest.approx(0.025)
    assert P.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and P.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert P.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert P.f_sf(4.9646027437307145, 1, 10) == pytest.approx(0.05)
    assert P.fisher_p(8, 2, 1, 5) == pytest.approx(0.034965034965)
    assert P.fisher_p(8, 2, 1, 5, "greater") == pytest.approx(0.0244755244755)
    assert P.mann_whitney_p(20, 5, 4, 0, "greater") == pytest.approx(1 / 126)
    assert P.mann_whitney_p(0, 5, 4, 0) == pytest.approx(2 / 126)


def test_published_odds_ratio(spark):
    row = T.fisher(spark.createDataFrame([(3887, 5750, 919, 2624)], "a long, b long, c long, d long"), alternative="greater").first()
    assert row["odds_ratio"] == pytest.approx(1.930, abs=1e-3) and row["p_value"] == pytest.approx(2.94e-54, rel=0.01)


def test_u_statistics_add_up(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([("ab"[k % 2], float(rng.randrange(6))) for k in range(61)], "g string, v double")
    x, y = T.mann_whitney(df, "v", "g", "a", "b").first(), T.mann_whitney(df, "v", "g", "b", "a").first()
    assert x["u"] + y["u"] == x["n_a"] * x["n_b"] and x["rank_biserial"] == pytest.approx(-y["rank_biserial"])


def test_models_equal_numpy(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x - z + rng.normal(size=200) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "y": y, "hit": (x + rng.normal(size=200) > 0).astype(float)}))
    fit = T.ols(df, "y", ["x", "z"])
    want = np.linalg.lstsq(np.c_[np.ones(200), x, z], y, rcond=None)[0]
    assert [t["coef"] for t in fit["terms"]] == pytest.approx(want.tolist())
    assert T.partial_slope(df, "y", "x", ["z"]) == pytest.approx(want[1])
    gain = T.nested_gain(df, "y", ["x"], ["z"]).first()
    assert gain["p_value"] < 1e-20 and gain["delta_aic"] > 0
    odds = {r["term"]: r for r in T.logistic_models(df, "hit", ["x"]).collect()}
    assert odds["x"]["coef"] > 0 and odds["x"]["p_value"] < 1e-6 and 0 < odds["x"]["mcfadden_r2"] < 1
    p = 1 / (1 + np.exp(-(odds["intercept"]["coef"] + odds["x"]["coef"] * x)))
    hit = np.array([r["hit"] for r in df.collect()])
    assert abs((hit - p).sum()) < 1e-6
    assert T.linear_models(df.limit(10), "y", ["x"]).count() == 0 == T.logistic_models(df.where("hit = 1"), "hit", ["x"]).count()


def test_least_squares_far_from_zero_and_over_many_parts(spark, monkeypatch):
    """A shifted column gives the same slope; parts, folds and groups that are let go early change nothing; against numpy."""
    monkeypatch.setattr(T, "HELD_GROUPS", 1)
    rng = np.random.Generator(np.random.PCG64(9))
    x, z = rng.normal(size=500), rng.normal(size=500)
    y = 3 + 2 * x - z + 0.1 * rng.normal(size=500)
    pdf = pd.DataFrame({"g": ["a", "b", None, "c"] * 125, "x": x, "far": x + 1e8, "z": z, "y": y, "twice": 2 * x - 1})
    df = spark.createDataFrame(pdf).repartition(7)
    for by in ((), ("g",)):
        near, far = ({(r["g"] if by else 0, r["term"].replace("far", "x")): r for r in T.linear_models(df, "y", [c, "z"], by=by).collect()} for c in ("x", "far"))
        assert set(near) == set(far) and len(near) == 3 * (4 if by else 1)
        for (g, term), r in near.items():
            part = pdf[pdf["g"].isna() if g is None else pdf["g"] == g] if by else pdf
            m = np.c_[np.ones(len(part)), part["x"], part["z"]]
            beta, rss = np.linalg.lstsq(m, part["y"], rcond=None)[:2]
            i = ["intercept", "x", "z"].index(term)
            assert r["n"] == len(part) and r["coef"] == pytest.approx(beta[i]) and r["se"] == pytest.approx(np.sqrt(np.linalg.inv(m.T @ m)[i, i] * rss[0] / (len(part) - 3)))
            assert r["r2"] == pytest.approx(1 - rss[0] / ((part["y"] - part["y"].mean()) ** 2).sum())
            if term != "intercept":
                other = far[g, term]
                assert other["coef"] == pytest.approx(r["coef"], rel=1e-6) and other["se"] == pytest.approx(r["se"], rel=1e-6)
    assert T.linear_models(df, "y", ["x", "twice"]).count() == 0 and T.ols(df, "y", ["x", "twice"]) is None
    gains = [T.nested_gain(df, "y", ["z"], [c]).first() for c in ("x", "far")]
    assert gains[0]["lr"] == pytest.approx(gains[1]["lr"], rel=1e-5) and gains[0]["adj_r2_base"] == pytest.approx(gains[1]["adj_r2_base"])


def test_components_of_samples(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    m = rng.normal(size=(6, 40)) * rng.uniform(0.2, 4, size=40)
    long = spark.createDataFrame([(f"g{j}", f"s{i}", float(m[i, j])) for i in range(6) for j in range(40)], "gene string, s string, v double")
    got = {r["s"]: r for r in M.sample_pca(long, "gene", "s", "v", n_keys=25, k=3).collect()}
    best = m[:, np.argsort(-m.var(axis=0))[:25]]
    u, d, _ = np.linalg.svd(best - best.mean(axis=0), full_matrices=False)
    for i in range(6):
        assert [abs(got[f"s{i}"][f"pc{c + 1}"]) for c in range(3)] == pytest.approx(np.abs(u * d)[i, :3].tolist())


def firth_by_hand(x, y):
    """Penalised estimates by many small steps along the modified score."""
    b = np.zeros(x.shape[1])
    for _ in range(3000):
        p = 1 / (1 + np.exp(-x @ b))
        inv = np.linalg.inv(x.T * (p * (1 - p)) @ x)
        h = p * (1 - p) * np.einsum("ij,jk,ik->i", x, inv, x)
        b = b + 0.3 * inv @ (x.T @ (y - p + h * (0.5 - p)))
    return b, np.sqrt(np.diag(inv))


def test_logistic_models_under_separation(spark):
    """Split outcomes, outcomes split but for ties, a group that is not split, a collinear one, and one row off a split."""
    rng = np.random.Generator(np.random.PCG64(4))
    parts, want = [], {}
    for name in ("split", "tied", "mixed", "collinear", "nearly"):
        x, z = np.sort(rng.normal(size=60)), rng.normal(size=60)
        y = (np.arange(60) >= 30).astype(float)
        if name == "tied":
            x = np.where(np.arange(60) < 45, 0.0, 5.0)
            y = np.where(np.arange(60) < 45, np.arange(60) % 2, 1.0)
        if name == "mixed":
            y = (x + rng.normal(size=60) > 0).astype(float)
        if name == "collinear":
            z = 2 * x + 1
        if name == "nearly":
            y[[10, 50]] = y[[50, 10]]
        parts.append(pd.DataFrame({"g": name, "x": x, "z": z, "y": y}))
        if name in ("split", "tied"):
            want[name] = firth_by_hand(np.c_[np.ones(60), x, z], y)
    df = spark.createDataFrame(pd.concat(parts))
    got = {}
    for r in T.logistic_models(df, "y", ["x", "z"], by=["g"]).collect():
        got.setdefault(r["g"], {})[r["term"]] = r
    assert {g: m["x"]["method"] for g, m in got.items()} == {"split": "firth", "tied": "firth", "mixed": "mle", "nearly": "mle"}
    for g, (b, se) in want.items():
        assert [got[g][t]["coef"] for t in ("intercept", "x", "z")] == pytest.approx(b.tolist(), rel=1e-5)
        assert [got[g][t]["se"] for t in ("intercept", "x", "z")] == pytest.approx(se.tolist(), rel=1e-5)
    for g in ("mixed", "nearly"):
        part = next(p for p in parts if p["g"].iloc[0] == g)
        x = np.c_[np.ones(60), part["x"], part["z"]]
        p = 1 / (1 + np.exp(-x @ np.array([got[g][t]["coef"] for t in ("intercept", "x", "z")])))
        assert np.abs(x.T @ (part["y"] - p)).max() < 1e-5
    few = T.logistic_models(df, "y", ["x"], by=["g"], rounds=2).where("g = 'split'").collect()
    assert {(r["method"], r["coef"]) for r in few} == {("unsettled", None)}


def test_blocks_of_replicates_equal_single_replicates(spark, monkeypatch):
    """Arrays and spread rows give the same; both against plain Python."""
    rng = random.Random(5)
    rows = [(f"k{k}", "ab"[k % 3 > 0], k % 2, float(rng.randrange(6)), float(rng.randrange(9)) if k % 17 else None) for k in range(120)]
    df = spark.createDataFrame(rows, "key string, g string, s long, x double, y double")
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "BLOCK_CELLS", 200)
    out = []
    for most in (1 << 21, 0):
        monkeypatch.setattr(T, "BLOCK_ROWS", most)
        ci = T.bootstrap_spearman(df, "x", "y", "key", by=["s"], times=30).orderBy("s").collect()
        test = T.permutation_test(df, "x", "y", "g", "a", "b", "key", by=["s"], times=30).orderBy("s").collect()
        whole = T.permutation_test(df, "x", "y", "g", "a", "b", "key", times=30).collect()
        out.append([tuple(round(v, 9) for v in r) for r in (*ci, *test, *whole)])
    assert out[0] == out[1] and len(out[0]) == 5
    mine = pd.DataFrame(rows, columns=["key", "g", "s", "x", "y"]).dropna().query("s == 0")
    h = np.array([int(hashlib.md5(f"{k}|42".encode()).hexdigest()[:8], 16) for k in mine["key"]])
    u = T._draws(h, np.arange(1, 31)) / 2.0**32
    copies = sum((u > c).astype(int) for c in T.COPIES)
    rho = [pd.DataFrame(np.repeat(mine[["x", "y"]].to_numpy(), copies[:, r], axis=0)).corr("spearman").iloc[0, 1] for r in range(30)]
    assert out[0][0][3:] == pytest.approx(tuple(np.percentile(rho, [2.5, 97.5])))
    side = mine.sort_values("key")
    h = np.array([int(hashlib.md5(f"{k}|42".encode()).hexdigest()[:8], 16) for k in side["key"]])
    n_a, hits = (side["g"] == "a").sum(), 0
    corr = lambda part: part[["x", "y"]].corr("spearman").iloc[0, 1]
    observed = abs(corr(side[side["g"] == "a"]) - corr(side[side["g"] == "b"]))
    for r in range(30):
        chosen = np.argsort(T._draws(h, np.array([r + 1]))[:, 0], kind="stable")
        hits += abs(corr(side.iloc[chosen[:n_a]]) - corr(side.iloc[chosen[n_a:]])) >= observed - 1e-12
    assert out[0][2][-2:] == pytest.approx((observed, hits / 30))
    draws = T._draws(np.arange(2000), np.arange(500)) / 2.0**32
    assert abs(draws.mean() - 0.5) < 0.002 and abs(np.corrcoef(draws[:, 0], draws[:, 1])[0, 1]) < 0.07 and abs(np.corrcoef(draws[0], draws[1])[0, 1]) < 0.15


def test_adjusted_p_of_many_values(spark):
    rng = random.Random(2)
    p = [round(rng.random() ** 3, 3) for _ in range(700)]
    df = spark.createDataFrame([(k, v, "ab"[k % 2] if k % 7 else None) for k, v in enumerate(p)], "id long, p_value double, f string")

    def plain(rows):
        out, low = {}, 1.0
        for rank, (k, v) in reversed(list(enumerate(sorted(rows, key=lambda x: x[1]), 1))):
            low = min(low, v * len(rows) / rank)
            out[k] = low
        return out

    got = {r["id"]: r["p_adj"] for r in T.bh_adjust(df).collect()}
    assert got == pytest.approx(plain(list(enumerate(p))))
    got = {r["id"]: r["p_adj"] for r in T.bh_adjust(df, family=["f"]).collect()}
    want = {}
    for f in ("a", "b", None):
        want |= plain([(k, v) for k, v in enumerate(p) if ("ab"[k % 2] if k % 7 else None) == f])
    assert got == pytest.approx(want)


def test_resampling(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.normal(size=120)
    pdf = pd.DataFrame({"k": range(120), "x": x, "y": x + rng.normal(size=120), "g": ["a", "b"] * 60})
    df = spark.createDataFrame(pdf)
    ci = T.bootstrap_spearman(df, "x", "y", "k", times=60).first()
    assert ci["ci_low"] < ci["rho"] < ci["ci_high"] and ci["rho"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))
    assert 0 <= T.permutation_test(df, "x", "y", "g", "a", "b", "k", times=50).first()["p_value"] <= 1


def test_group_summary_keeps_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, v double")
    got = {r["g"]: r for r in A.group_summary(df, "g", "v", ["a", "b"]).collect()}
    assert got["a"]["mean"] == 2 and got["b"]["n"] == 0 and got["b"]["mean"] is None


def test_strict_bed_fails_on_bad_lines(spark, tmp_path):
    path = tmp_path / "x.bed"
    path.write_text("# note\nc\t1\t5\tn\t0\t+\nc\t9\t9\tm\t0\t-\nc\t1\t2\tp\t0\t.\n")
    assert R.read_bed(spark, str(path), strand_at=5).count() == 2
    with pytest.raises(Exception, match="malformed"):
        R.read_bed(spark, str(path), strand_at=5, strict=True).collect()


def test_shortest_patterns_find_the_same_texts():
    import re

    rng = random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choice("GGGGACT" if rng.random() < 0.7 else "ACGT") for _ in range(rng.randrange(10, 70)))
        for _, patterns in Q.MOTIFS:
            for p in patterns:
                assert bool(re.search(p, text)) == bool(re.search(Q.shortest(p), text))


def test_sequences_of_intervals(spark):
    chunks = spark.createDataFrame([("c", 0, "ACGTA"), ("c", 5, "CCGGT"), ("c", 10, "TA")], "chrom string, start long, seq string")
    rows = spark.createDataFrame([(1, "c", 3, 11, "+"), (2, "c", 3, 11, "-"), (3, "c", 8, 20, "+"), (4, "x", 0, 2, "+")], "k long, chrom string, start long, end long, strand string")
    got = {r["k"]: r["seq"] for r in I.extract_seq(rows, chunks, ["k"], width=4).collect()}
    assert got == {1: "TACCGGTT", 2: "AACCGGTA", 3: None, 4: None}


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_quantiles_equal_numpy(spark, n):
    rng = random.Random(n)
    rows = [(float(rng.randrange(60)) / 7 if k % 11 else None, "ab"[k % 2]) for k in range(n + 1)]
    df = spark.createDataFrame(rows, "v double, g string")
    ps = [0, 0.25, 1 / 3, 0.5, 0.9, 1]
    live = [v for v, _ in rows if v is not None]
    assert B.quantiles(df, "v", ps).first()["quantiles"] == pytest.approx(np.quantile(live, ps).tolist())
    for r in B.quantiles(df, "v", ps, ["g"]).collect():
        assert r["quantiles"] == pytest.approx(np.quantile([v for v, g in rows if g == r["g"] and v is not None], ps).tolist())


def test_exploded_sides_are_never_broadcast(spark):
    # 81 edges for each of few points, 18 cells for each of few rows: small by Spark's estimate, large in fact
    points = spark.range(100).selectExpr("id", "'c' as chrom", "id * 50 as pos", "'+' as strand", "1 as g")
    track = spark.range(100).selectExpr("'c' as chrom", "id * 500 as start", "id * 500 + 500 as end", "1.0D as value")
    a = spark.range(100).selectExpr("id", "'c' as chrom", "id * 50 as start", "id * 50 + 70 as end")
    strategies = [I.metaprofile(points, track, 2000, 50, "g", "id"), I.overlap_pairs(a, a), I.max_signal(a, track, ["id"], "value")]
    for df, at in zip(strategies, ("_at#", "_bin", "_lvl#"), strict=True):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert any("SortMergeJoin" in line and at in line for line in plan.splitlines())
        assert not any("BroadcastHashJoin" in line and at in line for line in plan.splitlines())


def test_burden_makes_no_table_of_loci_and_samples(spark, monkeypatch):
    from locuspark.plans import pipelines as P

    rng = random.Random(5)
    windows = [(f"g{k % 30}", f"c{k % 2}", s, s + rng.choice([300, 1001])) for k in range(40) for s in [rng.randrange(9000)]] + [("g99", "c0", 0, 10**6)]
    loci = [(f"c{k % 2}", s, s + rng.randrange(1, 400)) for k in range(150) for s in [rng.randrange(9000)]]
    loci += loci[:20] + [(c, s - 7, e) for c, s, e in loci[:30] if s >= 7]  # equal ones, and others with an end in common
    reads = [(k % 3, "p" if k % 3 else "q", "real" if k % 4 else "sim", f"c{k % 2}", s, s + rng.randrange(1, 60)) for k in range(600) for s in [rng.randrange(9500)]]
    reads = [r for r in reads if r[0] != 2 or r[2] == "real"]  # a sample without a simulation
    totals = {(s, p): [sum(r[:3] == (s, p, kind) for r in reads) for kind in ("real", "sim")] for s, p in {r[:2] for r in reads}}
    places = {(g, c, max(s, a), min(e, b)) for g, c, s, e in windows for d, a, b in loci if c == d and s < b and a < e}
    want = {}
    for g, c, s, e in places:
        for p in ("p", "q"):
            rates = []
            for (sample, product), t in totals.items():
                if product == p:
                    n = [sum(r[:3] == (sample, p, kind) and r[3] == c and r[4] < e and r[5] > s for r in reads) for kind in ("real", "sim")]
                    real, sim = (x * 1e9 / ((e - s) * y) if y else None for x, y in zip(n, t, strict=True))
                    rates.append((real, math.log2(real + 1e-3) - (math.log2(sim + 1e-3) if sim is not None else 0)))
            want[p, f"{c}:{s}-{e}:{g}"] = (len(rates), sum(r for r, _ in rates) / len(rates), max(r for r, _ in rates), sum(d for _, d in rates) / len(rates), max(d for _, d in rates))
    given = (spark.createDataFrame(windows, "gene string, chrom string, start long, end long"), spark.createDataFrame(loci, "chrom string, start long, end long"), spark.createDataFrame(reads, "sample_id long, product string, kind string, chrom string, start long, end long"))
    told = lambda: {(r["product"], r["locus"]): (r["n_samples"], r["real_rpkm_mean"], r["real_rpkm_max"], r["damage_mean"], r["damage_max"]) for r in P.burden(*given)[0].collect()}
    monkeypatch.setattr("locuspark.operators.cells.PAIRS", 500)
    with monkeypatch.context() as m:
        m.setattr(I, "overlap_sums", None)
        m.setattr(I, "intersect", None)
        got, genes = told(), P.burden(*given)[1].collect()
    assert set(got) == set(want) and all(v == pytest.approx(want[k]) for k, v in got.items())
    for r in genes:
        own = [v for (p, name), v in want.items() if p == r["product"] and name.endswith(f":{r['gene']}")]
        assert (r["n_loci"], r["damage_max"], r["damage_mean"], r["real_rpkm_max"]) == pytest.approx((len(own), max(v[4] for v in own), sum(v[3] for v in own) / len(own), max(v[2] for v in own)))
    assert len(genes) == len({(p, name.split(":")[2]) for p, name in want})
    monkeypatch.setattr("locuspark.operators.cells.WIDE", 10)  # parts longer than any cell
    assert {k: pytest.approx(v) for k, v in told().items()} == got


def test_groups_without_rows_are_told_as_sql_tells_them(spark):
    from locuspark.plans import pipeline_queries as PQ
    from locuspark.plans import pipelines as P

    rows = spark.range(40).selectExpr("concat('g', id) as gene", "'hit' as grp", "cast(id % 7 as double) as mean_log2")
    _, pairs, expressed, _ = P.expression_tests(rows)
    assert expressed.count() == 0
    assert {tuple(r) for r in PQ.told_pairs(pairs, "against").collect()} == {(g, 40, 0, 0.0, None, 1.0) for g in ("control", "none")}
    gain = T.nested_gain(rows.selectExpr("mean_log2 as y", "cast(hash(gene) % 11 as double) as x", "1.0D as hit"), "y", ["x"], ["hit"]).collect()
    assert [tuple(r) for r in gain] == [(40, None, None, None, None, None, None)]


def test_maximum_over_many_overlaps_in_cells(spark, monkeypatch):
    rng = random.Random(31)
    a = [(k, f"c{k % 2}", s, s + rng.choice([0, 1, 7, 900, 70_000])) for k in range(120) for s in [rng.randrange(200_000)]] + [(120, None, 0, 5), (121, "c9", 3, 8), (122, "c0", 32_768, 65_536), (7, "c1", 0, 90_000)]
    b = [(k, f"c{k % 2}", s, s + rng.choice([0, 1, 7, 400, 40_000])) for k in range(400) for s in [rng.randrange(200_000)]] + [(400, None, 0, 5), (401, "c0", 32_767, 32_769), *((402 + k, "c1", 100, 140) for k in range(50))]
    values = [None if k % 11 == 0 else float(k * 37 % 23 - 9) for k in range(len(b))]
    track = spark.createDataFrame([(*r, v) for r, v in zip(b, values, strict=True)], "id long, chrom string, start long, end long, value double")
    told = lambda: {r["id"]: tuple(r)[1:] for r in I.max_signal(ivs(spark, a), track, ["id"], "value").collect()}
    joined = told()
    monkeypatch.setattr(I, "JOIN_ROWS", 0)
    monkeypatch.setattr(I, "_dyadic", None)
    monkeypatch.setattr(I, "track_totals", None)  # neither rows for each level nor for both ends
    assert told() == {k: pytest.approx(v) if None not in v else v for k, v in joined.items()}
    assert len(joined) > 60 and any(v[2] is None for v in joined.values()) == any(v[0] is None for v in joined.values())
    assert I.max_signal(ivs(spark, a), track.where("false"), ["id"], "value").count() == 0


def test_one_part_of_a_burden_analysis_works_out_no_other(spark, monkeypatch):
    from locuspark.plans import model_queries as MQ

    sf, none = "/root/testdata/sf0.001", lambda *a, **k: pytest.fail("another part was worked out")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    bm = MQ.rounded_burden(spark, sf)
    monkeypatch.setattr(MQ, "rounded_burden", lambda *a: bm)
    for query, others in ((MQ.q26_linear, ("spearman", "partial_spearman", "nested_gain")), (MQ.q26_partial, ("spearman", "linear_models", "nested_gain")), (MQ.q27_burden_by_trajectory, ("mann_whitney",)), (MQ.q28_background_summary, ("mann_whitney", "linear_models"))):
        with monkeypatch.context() as m:
            for name in others:
                m.setattr(T, name, none)
            assert query(spark, sf).columns


def test_distinct_shared_parts_without_pairs(spark, monkeypatch):
    rng = random.Random(41)
    a = [(f"g{k % 9}" if k % 7 else None, f"c{k % 2}", s, s + rng.choice([0, 1, 300, 1001])) for k in range(60) for s in [rng.randrange(9000)]] + [("g99", "c0", 0, 10**6), ("g98", None, 0, 9)]
    b = [(f"c{k % 2}", s, s + rng.randrange(0, 400)) for k in range(200) for s in [rng.randrange(9000)]]
    b += b[:30] + [(c, s - 7, e) for c, s, e in b[:30] if s >= 7] + [(None, 0, 9), ("c1", 2047, 2049)]
    want = {(g, c, max(s, x), min(e, y)) for g, c, s, e in a for d, x, y in b if c and c == d and max(s, x) < min(e, y)}
    given = spark.createDataFrame(a, "gene string, chrom string, start long, end long"), spark.createDataFrame(b, "chrom string, start long, end long")
    monkeypatch.setattr("locuspark.operators.cells.PAIRS", 500)
    with monkeypatch.context() as m:
        m.setattr(I, "overlap_pairs", None)
        got = [tuple(r) for r in I.intersect_distinct(*given, "gene").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(I, "WIDE", 10)
    assert {tuple(r) for r in I.intersect_distinct(*given, "gene").collect()} == want


def test_structures_of_windows_come_from_few_pairs(spark, monkeypatch):
    from locuspark.plans import pipelines as P

    windows = spark.range(20).selectExpr("concat('g', id) as gene", "'c' as chrom", "id * 1000 as start", "id * 1000 + 500 as end")
    loci = spark.range(4000).selectExpr("'c' as chrom", "id * 3 % 9000 as start", "id * 3 % 9000 + 20 as end", "if(id % 2 = 0, 'x', 'y') as structure")
    members = spark.range(20).selectExpr("concat('g', id) as gene", "if(id % 2 = 0, 'Q4', 'Q1') as expression_class")
    pairs, plain = [], I.overlap_pairs
    monkeypatch.setattr(I, "overlap_pairs", lambda a, b, *r: pairs.append(plain(a, b, *r)) or pairs[-1])
    got = {tuple(r) for r in P.structure_enrichment(members, windows, loci, bottoms=("Q1",))[1].select("structure", "a", "b", "c", "d").collect()}
    assert got == {("x", 5, 5, 5, 5), ("y", 5, 5, 5, 5)}
    assert pairs[0].count() <= 40


def test_replicates_of_few_groups_go_to_many_tasks_that_sort_once(spark, monkeypatch):
    df = spark.range(300).selectExpr("concat('k', id) as key", "cast(id * 7 % 31 as double) as x", "cast(id * 11 % 37 as double) as y")
    plain, seen = T._in_blocks, []

    def spied(rows, by, times, fields, one, groups=1):
        out = plain(rows, by, times, fields, one, groups)
        pdf, sorts = rows.toPandas(), []
        with monkeypatch.context() as m:
            m.setattr(T, "_ties", lambda v, own=T._ties: sorts.append(1) or own(v))
            told = one(pdf)
            for k in range(1, 5):
                told(np.array([k]))
        seen.append((rows.columns, len(sorts), out.rdd.getNumPartitions() > 0, out.select("replicate").distinct().count()))
        return out

    monkeypatch.setattr(T, "_in_blocks", spied)
    monkeypatch.setattr(T, "BLOCK_ROWS", 100)  # 300 rows still are blocks of three numbers a row
    assert T.bootstrap_spearman(df, "x", "y", "key", times=100).count() == 1
    assert seen == [(["x", "y", "h"], 2, True, 100)]


def test_motifs_are_matched_once_a_text_in_code_points(spark):
    g = "GGGTAGGGTAGGGTAGGG"
    df = spark.createDataFrame([(0, f"éé{g}C"), (1, None), (2, f"C{g}"[::-1].replace("C", "").translate(str.maketrans("GTA", "CAT")))], "id long, seq string")
    one = df.withColumn("m", Q.classify_motif("seq")).where("m.structure <> 'other'").select("id", "m.*")
    assert [tuple(r) for r in one.collect()] == [(0, "loop1_3", 2, 20)]
    assert one._jdf.queryExecution().optimizedPlan().toString().count("told(") == 1
    both = {r["id"]: tuple(r["m"]) for r in df.select("id", Q.classify_both_strands("seq").alias("m")).collect()}
    assert both == {0: ("loop1_3", 2, 20, "+"), 1: ("other", None, None, "+"), 2: ("loop1_3", 0, 18, "-")}


def test_tiles_of_a_long_sequence_in_one_pass(spark):
    import time

    long = spark.range(1).select(F.lit("c").alias("chrom"), F.lit(0).cast("long").alias("start"), F.expr("repeat('ACGTGTCA', 1000000)").alias("seq"))
    began = time.perf_counter()
    got = I.tile(long, 150).agg(F.count("*"), F.max("end"), F.max(F.length("seq"))).first()
    assert tuple(got) == (53333, 7999950, 150) and time.perf_counter() - began < 30


def test_profiles_in_cells_equal_those_of_edges(spark, monkeypatch):
    points = spark.range(60).selectExpr("id", "concat('c', id % 2) as chrom", "131000 + id * 7 as pos", "if(id % 3 = 0, '-', '+') as strand", "id % 4 as g")
    points = points.unionByName(spark.createDataFrame([(90, None, 131000, "+", 1), (91, "c1", 30, None, None), (92, "c9", 131000, "+", 2)], "id long, chrom string, pos long, strand string, g long"))
    track = spark.range(80).selectExpr("concat('c', id % 3) as chrom", "130000 + id * 31 % 2300 as start", "130040 + id * 31 % 2300 + id % 50 as end", "if(id % 9 = 0, null, id * 1.5D - 20) as value")
    run = lambda: {(r["g"], r["bin"]): (r["n"], round(r["signal"], 6)) for r in I.metaprofile(points, track, 400, 20, "g", "id").collect()}
    joined = run()
    calls, inner = [], I.profiles
    monkeypatch.setattr(I, "JOIN_ROWS", 10)
    monkeypatch.setattr(I, "profiles", lambda *a: calls.append(1) or inner(*a))
    assert run() == joined and calls and len(joined) == 160


def test_samples_of_tiles_judge_each_tile_once(spark):
    from locuspark.plans import pipelines as P

    tiles = spark.createDataFrame([("c", k * 4, k * 4 + 4, s, f"c:{k}") for k, s in enumerate(["GGCC", "GCAT", "AAAT", "GGCN", "CCCC"])], "chrom string, start long, end long, seq string, id string")
    skip = spark.createDataFrame([("c", 17, 18)], "chrom string, start long, end long")
    chosen, funnel = P.gc_sample(tiles, {"excluded": skip}, 0.4, 2, "id")
    assert {tuple(r) for r in chosen.collect()} == {("c", 0, 4, "GGCC", "c:0"), ("c", 4, 8, "GCAT", "c:1")}
    assert {r["reason"]: r["n"] for r in funnel.collect()} == {"excluded": 1, "not_acgt": 1, "gc": 1, "kept": 2}
    assert not any("Join" in line and "seq" in line for line in funnel._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert "LocalRelation" not in funnel._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_files_and_sequences_are_read_once(spark):
    from locuspark.plans import model_queries, operator_queries

    plan = lambda q: q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan(operator_queries.canonical_tss).count("Relation [value") == 1
    assert "lower(" not in plan(model_queries.interval_sequences)


def test_scores_within_few_groups_leave_rows_where_they_are(spark):
    df = spark.range(3_000_000).selectExpr("id % 2 as g", "cast(id % 1000 as double) as v", "cast(id % 7 as double) as w")
    both = B.zscores(df, {"zv": "v", "zw": "w"}, by=["g"])
    for plan in (x._jdf.queryExecution().sparkPlan().toString() for x in (both, B.zscore(df, "v", "zv", by=["g"]))):
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    row = both.where("v = 4 and w = 4").first()
    n, mean = 1_500_000, 499.0
    assert row["zv"] == pytest.approx((4 - mean) / math.sqrt(sum((v - mean) ** 2 for v in range(0, 1000, 2)) / 500 * n / (n - 1)))


def test_a_read_is_listed_where_parts_may_begin(spark):
    from locuspark.operators import cells as C

    reads = spark.createDataFrame([("c", s, s + 20, 0, 1) for s in (2048, 2500, 2547, 2548, 4000, 4090)], "chrom string, start long, end long, _sample int, _real int")
    windows = spark.createDataFrame([("g", "c", s, s + 500) for s in (1900, 3900)], "gene string, chrom string, start long, end long")
    listed = C._listed(reads, 2048, F.col("start") - 499, F.col("end") - 1, F.lit(2))
    assert sorted((r["start"], r["_bin"]) for r in listed.collect()) == [(2048, 0), (2048, 1), (2500, 0), (2500, 1), (2547, 1), (2548, 1), (4000, 1), (4090, 1), (4090, 2)]
    got = C.shared_part_rates(windows, None, reads, 500, [(0, 6, 0)], True)
    assert {(r["start"], round(r["real_rpkm_mean"] * 500 * 6 / 1e9)) for r in got.collect()} == {(1900, 1), (3900, 2)}


def test_partial_correlations_of_several_columns_keep_one_row(spark, monkeypatch):
    from locuspark.plans import pipelines as P

    rng = random.Random(17)
    some = lambda v: None if rng.random() < 0.1 else v
    rows = [("p" if k % 3 else "q", f"g{k}", some(float(rng.randrange(40))), some(float(rng.randrange(9))), *(some(float(rng.randrange(12))) for _ in S.TIMES)) for k in range(400)] + [("r", "g", 1.0, 2.0, None, None, None)]
    df = spark.createDataFrame(rows, "product string, gene string, damage_mean double, log2_tpm double, " + ", ".join(f"lfc_{t} double" for t in S.TIMES))
    plain = P._unpivot(df, ["product", "damage_mean", "log2_tpm"], ["lfc"])
    want = {(r["product"], r["time"]): (r["n"], r["rho"], r["p_value"]) for r in T.partial_spearman(plain, "damage_mean", "lfc", "log2_tpm", by=["product", "time"]).collect()}
    monkeypatch.setattr(T, "_rank_cells", None)  # no row for each column
    for rows_of_range in (B.RANGE_ROWS, 5):
        monkeypatch.setattr(B, "RANGE_ROWS", rows_of_range)
        got = {(r["product"], r["time"]): (r["n"], r["rho"], r["p_value"]) for r in P.burden_partial(df).collect()}
        assert {k: pytest.approx(v) for k, v in want.items()} == got and len(got) == 2 * len(S.TIMES)


def test_a_burden_table_is_written_once(spark, monkeypatch):
    from locuspark.plans import model_queries as MQ
    from locuspark.plans import pipeline_queries as PQ
    from locuspark.plans import pipelines as P

    sf, written, asked = "/root/testdata/sf0.001", [], []
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    for module in (MQ, PQ, P, B):
        plain = module.staged
        monkeypatch.setattr(module, "staged", lambda df, name, plain=plain: written.append((name, df.columns)) or plain(df, name))
    MQ.q26_linear(spark, sf)
    assert sum({"log2_tpm", "damage_mean"} <= set(columns) for _, columns in written) == 1
    assert [name for name, _ in written].count("signal") == 2
    assert all("trajectory" not in columns for _, columns in written)
    for query in (MQ.q26_partial, MQ.q27_burden_by_trajectory, MQ.q27_pairs, MQ.q28_background):
        written.clear()
        query(spark, sf)
        assert written and all(name != "signal" and "strength" not in columns for name, columns in written)


def test_replicates_hold_few_bytes_a_row():
    """A task holds the rows of its whole group, so what it holds of a row must stay small, also with no ties; ranks are those of the resampled rows."""
    import tracemalloc

    rng = np.random.Generator(np.random.PCG64(5))
    n = 400_000
    rows = pd.DataFrame({"x": rng.normal(size=n), "y": np.round(rng.normal(size=n), 2), "h": rng.integers(0, 1 << 32, n)})
    few = rows[:500]
    rho = T._resampled(*(few[c].to_numpy() for c in ("h", "x", "y")))
    for r in (1, 2, 3):
        u = T._draws(few["h"].to_numpy(), np.array([r]))[:, 0] / 2.0**32
        copies = sum((u > c).astype(int) for c in T.COPIES)
        assert rho(r) == pytest.approx(pd.DataFrame(np.repeat(few[["x", "y"]].to_numpy(), copies, axis=0)).corr("spearman").iloc[0, 1], abs=1e-12)
    assert math.isnan(T._resampled(np.arange(9), np.ones(9), np.arange(9.0))(1))
    held = {c: rows[c].to_numpy().copy() for c in ("h", "x", "y")}
    tracemalloc.start()
    rho = T._resampled(held.pop("h"), held.pop("x"), held.pop("y"))
    now, most = tracemalloc.get_traced_memory()
    rho(1)
    assert now <= 16 * n and max(most, tracemalloc.get_traced_memory()[1]) <= 80 * n
    tracemalloc.stop()
