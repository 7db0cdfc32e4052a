"""Queries for group summaries, tests and models over derived tables.

The twins get tail probabilities by quadrature, see ``sql_tools``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sequence as Q
from ..operators import binning as B
from ..operators import intervals as I
from ..operators import matrix as M
from ..operators import stats as T
from ..operators import summaries as A
from . import sql_tools as D
from .fixtures import cte, frame, sequences, table, tiles_sql
from .operator_queries import DIRS, LABELS, OVER, directions, labels, r6
from .registry import query

GROUPS = ["hit", "control", "none"]
GROUP_SQL = f"""{cte('win', 'peak', 'ctrl', 'meas', 'de')}, groups AS MATERIALIZED (SELECT gene, CASE WHEN EXISTS (SELECT 1 FROM peak b WHERE {OVER}) THEN 'hit' WHEN gene IN (SELECT gene FROM ctrl) THEN 'control' ELSE 'none' END AS grp FROM win a)"""


def gene_groups(spark, sf):
    counted = I.overlap_count(frame(spark, sf, "win"), frame(spark, sf, "peak"), ["gene"])
    flagged = A.flag_in(counted, frame(spark, sf, "ctrl"), "gene", "is_control")
    return flagged.select("gene", S.assign_group(F.col("n_overlaps") > 0, F.col("is_control"), GROUPS).alias("grp"))


@query(f"{GROUP_SQL} SELECT gene, grp FROM groups")
def assign_groups(spark, sf):
    return gene_groups(spark, sf)


@query(f"""{GROUP_SQL} SELECT g.grp, count(measure) AS n, round(avg(measure), 4) AS mean, round(quantile_cont(measure, 0.5), 4) AS median, round(quantile_cont(measure, 0.25), 4) AS q1, round(quantile_cont(measure, 0.75), 4) AS q3, count(*) FILTER (measure > 1500000) AS n_above
FROM (VALUES ('hit'), ('control'), ('none'), ('absent')) g(grp) LEFT JOIN groups USING (grp) LEFT JOIN meas USING (gene) GROUP BY 1""")
def group_summaries(spark, sf):
    rows = gene_groups(spark, sf).join(frame(spark, sf, "meas"), "gene")
    out = A.group_summary(rows, "grp", "measure", [*GROUPS, "absent"], above=1_500_000)
    return out.select("grp", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "q1", "q3")), "n_above")


@query(f"{GROUP_SQL} SELECT grp, count(*) AS n, count(padj_12) AS n_tested, count(*) FILTER (padj_12 < 0.05) AS n_sig, round(count(*) FILTER (padj_12 < 0.05) / nullif(count(padj_12), 0), 6) AS fraction FROM groups JOIN de USING (gene) GROUP BY 1")
def significant_fractions(spark, sf):
    rows = gene_groups(spark, sf).join(frame(spark, sf, "de"), "gene")
    return A.sig_summary(rows, ["grp"], "padj_12").withColumn("fraction", F.round("fraction", 6))


@query(f"{GROUP_SQL} SELECT grp, count(lfc_12) AS n, round(avg(lfc_12), 6) AS mean_lfc, round(median(lfc_12), 6) AS median_lfc, count(*) FILTER (padj_12 < 0.05 AND lfc_12 > 0) AS n_repressed, count(*) FILTER (padj_12 < 0.05 AND lfc_12 < 0) AS n_induced FROM groups JOIN de USING (gene) GROUP BY 1")
def fold_change_summary(spark, sf):
    rows = gene_groups(spark, sf).join(frame(spark, sf, "de"), "gene")
    return A.fc_summary(rows, ["grp"], "lfc_12", "padj_12").select("grp", "n", r6("mean_lfc"), r6("median_lfc"), "n_repressed", "n_induced")


LONG = "SELECT gene, 12 AS time, dir_12 AS direction, lfc_12 AS lfc, padj_12 AS padj FROM dirs UNION ALL SELECT gene, 30, dir_30, lfc_30, padj_30 FROM dirs UNION ALL SELECT gene, 60, dir_60, lfc_60, padj_60 FROM dirs"


def long_directions(spark, sf):
    de = directions(frame(spark, sf, "de"))
    return de.select("gene", F.explode(F.array(*(F.struct(F.lit(t).alias("time"), F.col(f"dir_{t}").alias("direction"), F.col(f"lfc_{t}").alias("lfc"), F.col(f"padj_{t}").alias("padj")) for t in S.TIMES))).alias("x")).select("gene", "x.*")


@query(f"{DIRS}, long AS ({LONG}) SELECT time, count(*) FILTER (direction = 'repressed') AS n_repressed, count(*) FILTER (direction = 'induced') AS n_induced, count(*) AS n, round(avg(lfc), 6) AS mean_lfc, round(count(*) FILTER (direction = 'repressed') / nullif(count(*) FILTER (direction = 'induced'), 0), 6) AS ratio FROM long GROUP BY 1")
def directions_by_time(spark, sf):
    return A.direction_counts(long_directions(spark, sf), ["time"]).select("time", "n_repressed", "n_induced", "n", r6("mean_lfc"), r6("ratio"))


TRAJ = ["complex", "repressed_sustained", "repressed_transient", "induced_sustained", "induced_transient", "lrt_only", "not_responsive"]


@query(f"""{LABELS}, c AS (SELECT trajectory, CASE WHEN abs(lfc_60) > 1 THEN 'strong' ELSE 'weak' END AS size, count(*) AS n FROM labels GROUP BY ALL),
g AS (SELECT t.t AS trajectory, s.s AS size FROM (SELECT unnest({TRAJ!r}) AS t) t, (SELECT unnest(['strong', 'weak', 'none']) AS s) s)
SELECT trajectory, size, coalesce(n, 0) AS n, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY size), 0), 6) AS fraction FROM g LEFT JOIN c USING (trajectory, size)""")
def trajectory_contingency(spark, sf):
    rows = labels(spark, sf).withColumn("size", F.when(F.abs("lfc_60") > 1, "strong").otherwise("weak"))
    return A.contingency(rows, "trajectory", "size", TRAJ, ["strong", "weak", "none"]).withColumn("fraction", F.round("fraction", 6))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def crosstab_status(spark, sf):
    return A.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query(f"{cte('peak')} SELECT chrom, round(sum(signal), 4) AS signal_sum, round(avg(signal), 6) AS signal_mean, max(signal) AS signal_max, count(*) AS n_peaks FROM peak GROUP BY 1")
def signal_by_key(spark, sf):
    return A.signal_summary(frame(spark, sf, "peak"), ["chrom"], "signal").select("chrom", F.round("signal_sum", 4).alias("signal_sum"), r6("signal_mean"), "signal_max", "n_peaks")


@query(f"{cte('read')} SELECT sample_id, kind, count(*) AS total FROM read GROUP BY ALL")
def library_sizes(spark, sf):
    return frame(spark, sf, "read").groupBy("sample_id", "kind").agg(F.count("*").alias("total"))


@query("SELECT l_partkey, max_by(l_orderkey, l_quantity * 1000000000 - l_orderkey) AS best FROM lineitem GROUP BY 1")
def arg_maximum(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max_by("l_orderkey", F.struct("l_quantity", -F.col("l_orderkey"))).alias("best"))


@query(f"""{cte('mtx')}, ok AS (SELECT gene, avg(ln(value)) AS lg FROM mtx WHERE value > 0 GROUP BY 1 HAVING count(*) = 7)
SELECT sample_id, round(exp(quantile_cont(ln(value) - lg, 0.5)), 6) AS size_factor FROM mtx JOIN ok USING (gene) GROUP BY 1""")
def sample_size_factors(spark, sf):
    return M.size_factors(frame(spark, sf, "mtx"), "gene", "sample_id", "value").select("sample_id", r6("size_factor"))


@query(f"""{GROUP_SQL}, m AS (SELECT DISTINCT gene FROM meas WHERE measure > 1500000)
SELECT grp, count(*) AS n_annotated, count(m.gene) AS n_retained, count(*) - count(m.gene) AS n_filtered, round(100.0 * count(m.gene) / count(*), 6) AS percent_retained FROM groups LEFT JOIN m USING (gene) GROUP BY 1""")
def group_retention(spark, sf):
    out = A.retention(gene_groups(spark, sf), frame(spark, sf, "meas").where("measure > 1500000"), "grp", "gene")
    return out.select("grp", "n_annotated", "n_retained", "n_filtered", r6("percent_retained"))


DECILE = "1 + len(list_filter((SELECT list_distinct(quantile_cont(measure, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM meas), lambda e: e < measure))"


@query(f"{GROUP_SQL}, d AS (SELECT grp, {DECILE} AS bin FROM groups JOIN meas USING (gene)) SELECT bin, count(*) AS n, round(avg(CAST(grp = 'hit' AS INT)), 6) AS fraction_hit, round(avg(CAST(grp = 'control' AS INT)), 6) AS fraction_control FROM d GROUP BY 1")
def decile_fractions(spark, sf):
    rows = B.qcut(gene_groups(spark, sf).join(frame(spark, sf, "meas"), "gene"), "measure", 10)
    flags = rows.withColumns({g: F.col("grp") == g for g in ("hit", "control")})
    return A.bin_fractions(flags, "bin", ["hit", "control"]).select("bin", "n", r6("fraction_hit"), r6("fraction_control"))


@query("""WITH m AS (SELECT o_custkey AS gene, CASE WHEN o_custkey % 2 = 0 THEN 'Q4' ELSE 'Q1' END AS class, o_orderpriority AS structure FROM orders),
t AS (SELECT class, count(DISTINCT gene) AS n_class FROM m GROUP BY 1), p AS (SELECT structure, class, count(DISTINCT gene) AS n_present FROM m GROUP BY ALL)
SELECT structure, class, n_present, n_class, round(n_present / n_class, 6) AS fraction FROM p JOIN t USING (class)""")
def structure_presence(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("gene"), F.when(F.col("o_custkey") % 2 == 0, "Q4").otherwise("Q1").alias("class"), F.col("o_orderpriority").alias("structure"))
    return A.class_presence(rows.select("gene", "class").distinct(), rows, "gene", "structure", "class").withColumn("fraction", F.round("fraction", 6))


def _sweep_sql() -> str:
    rows = []
    for t in (0.01, 0.05, 0.1, 0.2):
        for name, cond in (("others", "grp <> 'hit'"), ("control", "grp = 'control'")):
            rows.append(f"SELECT {t}::DOUBLE AS threshold, '{name}' AS comparator, count(*) FILTER (grp = 'hit' AND padj_12 < {t}) AS a, count(*) FILTER (grp = 'hit' AND padj_12 >= {t}) AS b, count(*) FILTER ({cond} AND padj_12 < {t}) AS c, count(*) FILTER ({cond} AND padj_12 >= {t}) AS d FROM groups JOIN de USING (gene)")
    return " UNION ALL ".join(rows)


@query(f"{GROUP_SQL} SELECT *, round(a * d / nullif(b * c, 0), 6) AS odds_ratio FROM ({_sweep_sql()})")
def threshold_sweep(spark, sf):
    cells = A.sweep(gene_groups(spark, sf).join(frame(spark, sf, "de"), "gene"), "grp", "hit", "control", [0.01, 0.05, 0.1, 0.2], "padj_12")
    return T.fisher(cells, alternative="greater").select("threshold", "comparator", "a", "b", "c", "d", r6("odds_ratio"))


@query(f"""{cte('win', 'track')} SELECT gene, round(coalesce(sum(value * (least(a."end", b."end") - greatest(a.start, b.start))), 0) / (any_value(a."end") - any_value(a.start)), 4) AS signal FROM win a LEFT JOIN track b ON {OVER} GROUP BY 1""")
def window_signal(spark, sf):
    return I.signal_mean(frame(spark, sf, "win"), frame(spark, sf, "track"), ["gene"]).select("gene", F.round("signal", 4).alias("signal"))


@query(f"""{cte('gene', 'track')}, p AS (SELECT gene, chrom, tss, strand, CASE WHEN gene IN (SELECT gene FROM (SELECT concat('ENSG', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS gene FROM part WHERE p_size % 10 = 0)) THEN 'control' ELSE 'other' END AS grp FROM gene),
b AS (SELECT *, tss - 2000 + k * 50 AS s, CASE WHEN strand = '-' THEN 79 - k ELSE k END AS bin FROM p, (SELECT unnest(range(0, 80)) AS k)),
w AS (SELECT b.gene AS gene, grp, bin, value * (least(s + 50, t."end") - greatest(s, t.start)) AS x FROM b JOIN track t ON b.chrom = t.chrom AND t.start < s + 50 AND t."end" > s),
v AS (SELECT gene, grp, bin, sum(x) / 50 AS v FROM w GROUP BY ALL),
n AS (SELECT grp, count(DISTINCT gene) AS n FROM v GROUP BY 1)
SELECT n.grp AS grp, g.bin AS bin, n, round(coalesce(sum(v), 0) / n, 4) AS signal FROM n CROSS JOIN (SELECT unnest(range(0, 80)) AS bin) g LEFT JOIN v ON v.grp = n.grp AND v.bin = g.bin GROUP BY n.grp, g.bin, n""")
def group_metaprofile(spark, sf):
    genes = A.flag_in(frame(spark, sf, "gene"), frame(spark, sf, "ctrl"), "gene", "c")
    points = genes.select("gene", "chrom", F.col("tss").alias("pos"), "strand", F.when(F.col("c"), "control").otherwise("other").alias("grp"))
    return I.metaprofile(points, frame(spark, sf, "track"), 2000, 50, "grp", "gene").withColumn("signal", F.round("signal", 4))


@query(f"{LABELS} SELECT trajectory, round(median(lfc_12), 6) AS lfc_12, round(median(lfc_60), 6) AS lfc_60 FROM labels GROUP BY 1")
def median_courses(spark, sf):
    return labels(spark, sf).groupBy("trajectory").agg(*(F.round(F.median(c), 6).alias(c) for c in ("lfc_12", "lfc_60")))


@query(f"""{cte('peak')} SELECT assay, count(*) AS n, count(*) FILTER (signal > 100) AS n_retained, round(count(*) FILTER (signal > 100) / count(*), 6) AS fraction FROM peak GROUP BY 1""")
def filter_report(spark, sf):
    return A.filter_summary(frame(spark, sf, "peak"), F.col("signal") > 100, ["assay"]).withColumn("fraction", F.round("fraction", 6))


@query(f"""WITH t AS (SELECT chrom, start, length(translate(seq, 'AT', '')) / 150.0 AS gc FROM ({tiles_sql()}))
SELECT CASE WHEN start >= 3000 THEN 0 WHEN gc <= 0.5 THEN 1 ELSE 2 END AS step, CASE WHEN start >= 3000 THEN 'near_start' WHEN gc <= 0.5 THEN 'gc' ELSE 'kept' END AS reason, count(*) AS n FROM t GROUP BY ALL""")
def selection_funnel(spark, sf):
    return A.funnel(I.tile(sequences(spark, sf), 150), [("near_start", F.col("start") < 3000), ("gc", Q.gc_fraction("seq") > 0.5)])


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS members FROM part GROUP BY 1")
def member_lists(spark, sf):
    return A.joined_members(table(spark, sf, "part"), ["p_brand"], "p_type")


@query("SELECT least(n, 3) AS n_rows, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def rows_per_key(spark, sf):
    return A.bucket_count(table(spark, sf, "orders"), "o_custkey")


@query(f"{DIRS}, long AS ({LONG}) SELECT time, count(*) AS n, count(padj) AS n_tested, count(*) FILTER (padj <= 0.05) AS n_sig FROM long GROUP BY 1")
def contrast_summary(spark, sf):
    return A.sig_summary(long_directions(spark, sf), ["time"], inclusive=True).drop("fraction")


# tests


@query(f"""WITH x AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM x),
s AS (SELECT count(*) FILTER (g = 'A') AS n_a, count(*) FILTER (g = 'R') AS n_b, sum(rk) FILTER (g = 'A') AS ra FROM r)
SELECT *, {D.p6(D.u_p('u', 'n_a', 'n_b', 'ties'))} AS p_value FROM (SELECT n_a, n_b, CAST(ra - n_a * (n_a + 1) / 2.0 AS DOUBLE) AS u, CAST((SELECT sum(c * c * c - c) FROM (SELECT count(*) AS c FROM x GROUP BY v)) AS DOUBLE) AS ties, round(1 - 2 * (ra - n_a * (n_a + 1) / 2.0) / (n_a * n_b), 6) AS rank_biserial FROM s)""")
def two_sample_ranks(spark, sf):
    return T.mann_whitney(frame(spark, sf, "two"), "value", "grp", "A", "R").select("n_a", "n_b", "u", "ties", r6("rank_biserial"), r6("p_value"))


@query(f"""WITH r AS (SELECT l_linenumber AS stratum, l_returnflag AS g, l_quantity AS v, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2.0 AS rk FROM lineitem),
k AS (SELECT stratum, g, count(*) AS m, sum(rk) AS s FROM r GROUP BY ALL), t AS (SELECT stratum, sum(c * c * c - c) AS ties FROM (SELECT l_linenumber AS stratum, count(*)::DOUBLE AS c FROM lineitem GROUP BY l_linenumber, l_quantity) GROUP BY 1),
h AS (SELECT stratum, sum(m)::DOUBLE AS n, count(*) AS groups, sum(s * s / m) AS ss FROM k GROUP BY 1)
SELECT stratum, n, groups, round(h, 5) AS h, {D.p6(D.chi2_sf('h', '(groups - 1)'))} AS p_value FROM (SELECT stratum, CAST(n AS BIGINT) AS n, groups, (12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM h JOIN t USING (stratum))""")
def k_sample_ranks(spark, sf):
    return T.kruskal(frame(spark, sf, "two"), "value", "grp", by=["stratum"]).select("stratum", "n", "groups", F.round("h", 5).alias("h"), r6("p_value"))


@query(f"""WITH c AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL), n AS (SELECT sum(o) AS n FROM c),
g AS (SELECT a.l_returnflag, b.l_linestatus, a.r, b.c, coalesce(o, 0) AS o FROM (SELECT l_returnflag, sum(o) AS r FROM c GROUP BY 1) a CROSS JOIN (SELECT l_linestatus, sum(o) AS c FROM c GROUP BY 1) b LEFT JOIN c USING (l_returnflag, l_linestatus))
SELECT n, df, round(chi2, 4) AS chi2, {D.p6(D.chi2_sf('chi2', 'df'))} AS p_value FROM (SELECT CAST(n AS BIGINT) AS n, (SELECT (count(DISTINCT l_returnflag) - 1) * (count(DISTINCT l_linestatus) - 1) FROM c) AS df, sum((o - r * c / n) * (o - r * c / n) / (r * c / n)) AS chi2 FROM g, n GROUP BY n)""")
def chi_square(spark, sf):
    return T.chi2_contingency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("n", "df", F.round("chi2", 4).alias("chi2"), r6("p_value"))


@query(f"""WITH r AS (SELECT l_returnflag AS grp, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT grp, n, round(rho, 6) AS rho, {D.p6(D.correlation_p('rho', 'n'))} AS p_value FROM (SELECT grp, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY 1)""")
def rank_correlation(spark, sf):
    return T.spearman(frame(spark, sf, "two"), "value", "price", by=["grp"]).select("grp", "n", r6("rho"), r6("p_value"))


@query(f"SELECT grp, n, round(r, 6) AS r, {D.p6(D.correlation_p('r', 'n'))} AS p_value FROM (SELECT l_returnflag AS grp, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1)")
def linear_correlation(spark, sf):
    return T.pearson(frame(spark, sf, "two"), "value", "price", by=["grp"]).select("grp", "n", r6("r"), r6("p_value"))


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y,
 rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS z FROM lineitem), c AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r)
SELECT n, round(rho, 6) AS rho, {D.p6(D.correlation_p('rho', 'n'))} AS p_value FROM (SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS rho FROM c)""")
def partial_rank_correlation(spark, sf):
    return T.partial_spearman(frame(spark, sf, "two"), "value", "price", "discount").select("n", r6("rho"), r6("p_value"))


BH = """SELECT {keep}, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * m / r) OVER (PARTITION BY {family} ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) END, 6) AS p_adj FROM (
SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY p NULLS LAST) AS r, count(p) OVER (PARTITION BY {family}) AS m FROM ({rows}))"""


@query(f"{cte('de')} " + BH.format(keep="gene", family="1", rows="SELECT gene, coalesce(padj_12, 1) AS p FROM de"))
def adjust_nulls_as_one(spark, sf):
    return T.bh_adjust(frame(spark, sf, "de"), "padj_12").select("gene", r6("p_adj"))


@query(f"{DIRS}, long AS ({LONG}) " + BH.format(keep="gene, time", family="time", rows="SELECT gene, time, padj AS p FROM long"))
def adjust_by_family(spark, sf):
    return T.bh_adjust(long_directions(spark, sf), "padj", ["time"], null_as_one=False).select("gene", "time", r6("p_adj"))


@query(f"""{cte('de', 'sets')}, bg AS (SELECT gene, padj_12 < 0.05 AS q FROM de WHERE padj_12 IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (q) AS nq FROM bg)
{D.adjusted(f"""SELECT *, {D.fisher_p('a', 'b', 'c', 'd', 'greater')} AS p_value FROM (SELECT set_name, set_size, a, nq - a AS b, set_size - a AS c, n - nq - set_size + a AS d, round(a * (n - nq - set_size + a) / nullif((nq - a) * (set_size - a), 0), 6) AS odds_ratio
FROM (SELECT set_name, count(*) AS set_size, count(*) FILTER (q) AS a FROM sets JOIN bg USING (gene) GROUP BY 1 HAVING count(*) BETWEEN 5 AND 500), n)""")}""")
def over_representation(spark, sf):
    bg = frame(spark, sf, "de").where("padj_12 is not null")
    out = T.over_representation(bg.where("padj_12 < 0.05"), bg, frame(spark, sf, "sets"))
    return out.select("set_name", "set_size", "a", "b", "c", "d", r6("odds_ratio"), r6("p_value"), r6("p_adj"))


@query("""SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coef, count(*) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem
UNION ALL SELECT 'value', round(regr_slope(l_extendedprice, l_quantity), 4), count(*), round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem""")
def linear_model(spark, sf):
    fit = T.ols(frame(spark, sf, "two"), "price", ["value"])
    return spark.createDataFrame([(t["term"], round(t["coef"], 4), fit["n"], round(fit["r2"], 6)) for t in fit["terms"]], "term string, coef double, n long, r2 double")


@query(f"{cte('mtx')} SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 4) AS distance FROM mtx a JOIN mtx b USING (gene) WHERE a.sample_id < b.sample_id GROUP BY ALL")
def sample_distances(spark, sf):
    return M.sample_distance(frame(spark, sf, "mtx"), "gene", "sample_id", "value").withColumn("distance", F.round("distance", 4))


@query(f"""{cte('iv')} SELECT a.event_id AS event_id_a, b.event_id AS event_id_b FROM iv a JOIN iv b ON {OVER} WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""")
def stream_annotation(spark, sf):
    """A stream of intervals against a static table, run to its end."""
    from ..sources.staging import shared_path, staged
    from ..streaming import annotate_stream

    iv = frame(spark, sf, "iv")
    folder, out, state = (shared_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    iv.where("event_type = 'signup'").write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    static = staged(iv.where("event_type = 'purchase'"), "static")
    pairs = annotate_stream(stream, static, width=512).select("event_id_a", "event_id_b")
    pairs.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(pairs.schema).parquet(out)
