"""One small query per operator, over tables derived from the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sequence as Q
from ..operators import binning as B
from ..operators import intervals as I
from ..operators import matrix as M
from ..operators import summaries as A
from ..sources import readers as R
from ..sources.staging import shared_path
from .fixtures import G_RICH, SIZE, cte, frame, sequences, sql, table, tiles_sql
from .registry import query

OVER = 'a.chrom = b.chrom AND a.start < b."end" AND a."end" > b.start'
CHROMS = [f"chr{k}" for k in range(1, 11)]
TEN = ", ".join(f"'{c}'" for c in CHROMS)


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


def assays(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    peaks = frame(spark, sf, "peak")
    return peaks.where("assay = 'click'"), peaks.where("assay = 'view'")


def directions(de: DataFrame) -> DataFrame:
    return de.withColumns({f"dir_{t}": S.direction(f"lfc_{t}", f"padj_{t}") for t in S.TIMES})


def _dir(t: int) -> str:
    return f"CASE WHEN padj_{t} < 0.05 AND lfc_{t} > 0.5 THEN 'repressed' WHEN padj_{t} < 0.05 AND lfc_{t} < -0.5 THEN 'induced' ELSE 'not_sig' END AS dir_{t}"


DIR_CTE = f"dirs AS (SELECT *, {', '.join(map(_dir, S.TIMES))} FROM de)"
DIRS = f"{cte('de')}, {DIR_CTE}"

# sources and sinks


@query(f"""{cte('peak')} SELECT chrom, start, "end", CAST(event_id AS VARCHAR) AS name, round(signal, 6) AS signal FROM peak WHERE chrom IN ({TEN}) AND "end" > start""")
def src_bed(spark, sf):
    path = shared_path(spark, "bed")
    R.write_bed(frame(spark, sf, "peak").select("chrom", "start", "end", F.col("event_id").alias("name"), F.col("signal").alias("score"), F.lit("+").alias("strand")), path)
    return R.read_bed(spark, path, signal_at=4, strand_at=5, contigs=CHROMS, strict=True).select("chrom", "start", "end", "name", F.round("signal", 6).alias("signal"))


@query("""SELECT concat('chr', CAST(gene % 22 + 1 AS VARCHAR)) AS chrom, CAST(gene AS VARCHAR) AS gene_id, CAST(tx AS VARCHAR) AS transcript_id, tss FROM (
SELECT o_custkey AS gene, o_orderkey AS tx, (o_orderkey * 7919) % 1000000 + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 499 END AS tss,
 row_number() OVER (PARTITION BY o_custkey ORDER BY bases DESC, o_orderkey) AS n
FROM (SELECT o_custkey, o_orderkey, sum(CAST(l_quantity AS BIGINT)) AS bases FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)) WHERE n = 1""")
def canonical_tss(spark, sf):
    tx = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("t"))
    tx = tx.withColumns({"start": (F.col("t") * 7919) % 1000000 + 1, "strand": F.when(F.col("g") % 2 == 0, "+").otherwise("-")})
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_quantity").cast("long").alias("n"))
    exons = line.join(tx, "t").withColumns({"feature": F.lit("exon"), "end": F.col("start") + F.col("n") - 1})
    both = tx.join(line.select("t").distinct(), "t", "left_semi").withColumns({"feature": F.lit("transcript"), "end": F.col("start") + 499}).unionByName(exons.drop("n"))
    attrs = F.format_string('gene_id "%s"; transcript_id "%s"; gene_name "g%s"; gene_type "protein_coding"; transcript_type "protein_coding";', F.col("g").cast("string"), F.col("t").cast("string"), F.col("g").cast("string"))
    chrom = F.concat(F.lit("chr"), (F.col("g") % 22 + 1).cast("string"))
    path = shared_path(spark, "gtf")
    both.select(F.concat_ws("\t", chrom, F.lit("db"), "feature", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)).write.text(path)
    gtf = R.read_gtf(spark, path)
    exon, whole = F.col("feature") == "exon", F.col("feature") == "transcript"
    place = F.max(F.when(whole, F.struct("chrom", "start", "end", "strand"))).alias("at")  # exons and transcripts from one look at the file
    bases = F.coalesce(F.sum(F.when(exon, F.col("end") - F.col("start") + 1)), F.lit(0)).alias("bases")
    starts = gtf.groupBy("gene_id", "transcript_id").agg(place, bases).where("at is not null").select("gene_id", "transcript_id", "bases", "at.*")
    longest = B.first_by(starts, ["gene_id"], [F.desc("bases"), F.col("transcript_id").cast("long")])
    return longest.select("chrom", "gene_id", "transcript_id", S.tss("start", "end", "strand").alias("tss"))


@query(f"SELECT chrom, CAST(start AS BIGINT) AS start, round(length(translate(seq, 'AT', '')) / 150.0, 6) AS gc FROM ({tiles_sql()}) WHERE length(translate(seq, 'AT', '')) / 150.0 > 0.28")
def fasta_gc_tiles(spark, sf):
    path = shared_path(spark, "fasta")
    wrapped = F.regexp_replace("seq", "(.{1,70})", "$1\n")
    sequences(spark, sf).select(F.concat(F.lit(">"), "chrom", F.lit(" whole\n"), wrapped)).write.text(path)
    tiles = I.tile(R.read_fasta_chunks(spark, path, chunk=150 * 64), 150)
    return tiles.where(Q.only_acgt("seq")).select("chrom", "start", F.round(Q.gc_fraction("seq"), 6).alias("gc")).where("gc > 0.28")


@query(sql("sets"))
def src_gmt(spark, sf):
    path = shared_path(spark, "gmt")
    sets = frame(spark, sf, "sets").groupBy("set_name").agg(F.collect_list("gene").alias("g"))
    sets.select(F.concat_ws("\t", "set_name", F.lit("desc"), F.array_join("g", "\t"))).write.text(path)
    return R.read_gmt(spark, path)


@query(f"{cte('sets')} SELECT * FROM sets WHERE set_name LIKE '%1' UNION ALL SELECT * FROM sets WHERE set_name LIKE '%2'")
def src_gene_set_manifest(spark, sf):
    """Some sets listed in the manifest, others in files that it names."""
    listed = frame(spark, sf, "sets").where("set_name like '%1'").groupBy("set_name").agg(F.concat_ws(", ", F.collect_list("gene")).alias("genes"))
    path = shared_path(spark, "sets")
    filed = frame(spark, sf, "sets").where("set_name like '%2'").withColumn("n", F.regexp_replace("set_name", "[^0-9]", ""))
    filed.select(F.concat("gene", F.lit(",x")), "n").write.partitionBy("n").text(path)
    files = filed.select("set_name", "n").distinct().select("set_name", F.concat(F.lit("n="), "n").alias("genes_file"))
    return R.read_gene_set_manifest(listed.withColumnRenamed("set_name", "name").unionByName(files.withColumnRenamed("set_name", "name"), allowMissingColumns=True), path)


@query("""SELECT CAST(l_partkey AS VARCHAR) AS gene_id, concat('SU_', CAST(l_linenumber AS VARCHAR), '00') AS sample_id, round(sum(l_quantity), 6) AS tpm, round(sum(l_extendedprice), 4) AS num_reads,
round(sum(l_quantity * l_tax) / nullif(sum(l_quantity), 0), 6) AS length FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL""")
def transcripts_to_genes(spark, sf):
    path = shared_path(spark, "quant")
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("SU_"), "l_linenumber", F.lit("00")).alias("dir"), F.concat_ws("|", "l_partkey", "l_orderkey", "l_linenumber").alias("Name"), F.lit(1.0).alias("Length"), F.col("l_tax").alias("EffectiveLength"), F.col("l_quantity").alias("TPM"), F.col("l_extendedprice").alias("NumReads"))
    rows.write.partitionBy("dir").csv(path, sep="\t", header=True)
    quant = R.read_quant(spark, path, r"^dir=(SU_([123])(00))$", ["00"])
    tx2gene = quant.select("transcript_id", F.substring_index("transcript_id", "|", 1).alias("gene_id")).distinct()
    return M.tx_to_gene(quant, tx2gene).select("gene_id", "sample_id", r6("tpm"), F.round("num_reads", 4).alias("num_reads"), r6("length"))


@query("""SELECT l_linenumber AS sample_id, count(DISTINCT l_partkey) AS n_transcripts, count(DISTINCT CASE WHEN l_partkey % 10 <> 0 THEN l_partkey END) AS n_mapped,
count(DISTINCT CASE WHEN l_partkey % 10 = 0 THEN l_partkey END) AS n_unmapped FROM lineitem GROUP BY 1""")
def mapping_qc(spark, sf):
    quant = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("sample_id"), F.col("l_partkey").alias("transcript_id"))
    tx2gene = table(spark, sf, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("transcript_id"), F.col("p_brand").alias("gene_id"))
    return M.mapping_summary(quant, tx2gene).drop("fraction_mapped")


@query(f"{cte('de')} SELECT gene, lfc_12, padj_12 FROM de")
def src_tsv(spark, sf):
    path = shared_path(spark, "tsv")
    R.write_tsv(frame(spark, sf, "de").select("gene", "lfc_12", "padj_12"), path)
    return R.read_tsv(spark, path, ["lfc_12", "padj_12"])


@query(f"{cte('gene')} SELECT DISTINCT chrom, 0 AS start, 1000000 AS \"end\" FROM gene")
def contig_intervals(spark, sf):
    path = shared_path(spark, "fai")
    frame(spark, sf, "gene").select("chrom").distinct().select(F.concat_ws("\t", "chrom", F.lit(str(SIZE)), F.lit("7"))).write.text(path)
    return R.contig_intervals(R.read_contig_sizes(spark, path, ["chr1"]))


@query(f"""{cte('track')} SELECT chrom, start, "end", round(value, 4) AS value FROM track""")
def src_bedgraph(spark, sf):
    path = shared_path(spark, "bedgraph")
    frame(spark, sf, "track").select("chrom", "start", "end", "value").write.csv(path, sep="\t")
    return R.read_bedgraph(spark, path).withColumn("value", F.round("value", 4))


@query(f"""{cte('peak')} SELECT chrom, start, "end", assay AS name FROM peak""")
def union_bed_files(spark, sf):
    paths = [shared_path(spark, f"bed-{k}") for k in range(3)]
    for path, x in zip(paths, assays(spark, sf), strict=False):
        x.select("chrom", "start", "end", F.col("assay").alias("name")).write.csv(path, sep="\t")
    return R.union_files(spark, paths).select("chrom", "start", "end", "name")


@query("SELECT count(*) AS n FROM part")
def min_rows_gate(spark, sf):
    return R.assert_min_rows(table(spark, sf, "part"), 100, "part").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey % 3 = 1")
def sample_manifest(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("method", F.when(F.col("s_nationkey") % 3 == 1, "DS").otherwise("XR"))
    return R.manifest(rows, "DS", name="s_name").select("s_suppkey", "s_name")


@query("SELECT concat(min(CASE WHEN n_nationkey % 5 = 2 THEN n_name END), '_vs_', min(CASE WHEN n_nationkey % 5 = 3 THEN n_name END)) AS contrast FROM nation")
def contrast_name(spark, sf):
    t = table(spark, sf, "nation").agg(F.min(F.when(F.col("n_nationkey") % 5 == 2, F.col("n_name"))).alias("numerator"), F.min(F.when(F.col("n_nationkey") % 5 == 3, F.col("n_name"))).alias("denominator"))
    return R.contrast_label(t)


@query("SELECT p_name, p_brand, concat_ws('|', p_type, p_brand, CAST(p_size AS VARCHAR)) AS label FROM part")
def project_annotation(spark, sf):
    return table(spark, sf, "part").select("p_name", "p_brand", F.concat_ws("|", "p_type", "p_brand", F.col("p_size").cast("string")).alias("label"))


# scalars and filters


@query(f"""{cte('gene')} SELECT gene_id, regexp_replace(gene_id, '\\.\\d+$', '') AS number, split_part(gene_id, '.', 1) AS first, regexp_replace(gene_id, '\\.[^.]+$', '') AS last FROM gene""")
def strip_versions(spark, sf):
    return frame(spark, sf, "gene").select("gene_id", *(S.strip_version("gene_id", m).alias(m) for m in ("number", "first", "last")))


@query(f"""{cte('peak')} SELECT event_id, greatest(start - 500, 0) AS start, least("end" + 500, 1000000) AS "end" FROM peak""")
def slop_windows(spark, sf):
    peaks = frame(spark, sf, "peak")
    sizes = peaks.select("chrom").distinct().withColumn("size", F.lit(SIZE))
    return I.slop(peaks, 500, sizes).select("event_id", "start", "end")


@query(f"""{cte('peak')} SELECT event_id, (start + "end") // 2 AS start, (start + "end") // 2 + 1 AS "end" FROM peak""")
def centers(spark, sf):
    return I.center(frame(spark, sf, "peak")).select("event_id", "start", "end")


def _motif_sql(column: str) -> str:
    """CASE over all patterns in order; the span starts where the leftmost match first occurs."""
    name = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, ps in Q.MOTIFS for p in ps)
    text = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN regexp_extract({column}, '{p}', 0)" for n, ps in Q.MOTIFS for p in ps)
    return f"CASE {name} ELSE 'other' END AS structure, CASE {text} END AS hit"


@query(f"SELECT structure, count(*) AS n FROM (SELECT {_motif_sql('seq')} FROM ({tiles_sql(G_RICH)})) GROUP BY 1")
def motif_classes(spark, sf):
    tiles = I.tile(sequences(spark, sf, G_RICH), 150)
    return tiles.select(Q.motif_class("seq").alias("structure")).groupBy("structure").agg(F.count("*").alias("n"))


@query(f"""SELECT chrom, CAST(start AS BIGINT) AS start, structure, CAST(start + strpos(seq, hit) - 1 AS BIGINT) AS structure_start, CAST(start + strpos(seq, hit) - 1 + length(hit) AS BIGINT) AS structure_end
FROM (SELECT *, {_motif_sql('seq')} FROM ({tiles_sql()})) WHERE structure <> 'other'""")
def motif_spans(spark, sf):
    tiles = I.tile(sequences(spark, sf), 150).withColumn("m", Q.classify_motif("seq")).where("m.structure <> 'other'")
    at = Q.span_to_coords("start", "end", F.lit("+"), "m.span_start", "m.span_end")
    return tiles.select("chrom", "start", "m.structure", at["structure_start"].alias("structure_start"), at["structure_end"].alias("structure_end"))


@query(f"""WITH t AS ({tiles_sql()}), p AS (SELECT *, {_motif_sql('seq')} FROM t), m AS (SELECT chrom, start, {_motif_sql("reverse(translate(seq, 'ACGT', 'TGCA'))")}, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM t)
SELECT p.chrom AS chrom, CAST(p.start AS BIGINT) AS start, CASE WHEN p.structure <> 'other' THEN '+' ELSE '-' END AS strand, CASE WHEN p.structure <> 'other' THEN p.structure ELSE m.structure END AS structure,
CAST(CASE WHEN p.structure <> 'other' THEN p.start + strpos(p.seq, p.hit) - 1 ELSE p."end" - (strpos(rc, m.hit) - 1 + length(m.hit)) END AS BIGINT) AS structure_start
FROM p JOIN m ON p.chrom = m.chrom AND p.start = m.start WHERE p.structure <> 'other' OR m.structure <> 'other'""")
def motif_both_strands(spark, sf):
    tiles = I.tile(sequences(spark, sf), 150).withColumn("m", Q.classify_both_strands("seq")).where("m.structure <> 'other'")
    at = Q.span_to_coords("start", "end", "m.strand", "m.span_start", "m.span_end")
    return tiles.select("chrom", "start", "m.strand", "m.structure", at["structure_start"].alias("structure_start"))


@query(f"""{cte('peak')} SELECT event_id, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), start, event_id) AS number, concat('peak_', CAST(row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), start, event_id) AS VARCHAR)) AS name FROM peak""")
def names_by_order(spark, sf):
    rows = B.number_rows(frame(spark, sf, "peak").select("event_id", "start", S.karyotype_order("chrom").alias("place")), ["place", "start", "event_id"])
    return rows.select("event_id", "number", F.concat(F.lit("peak_"), F.col("number").cast("string")).alias("name"))


@query(f"""{cte('peak')}, rows AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM peak)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('set_', CAST(i AS VARCHAR)) ELSE assay END AS name FROM rows WHERE event_id % 7 <> 0""")
def fill_empty_names(spark, sf):
    peaks = frame(spark, sf, "peak").orderBy("event_id")
    name = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, ".").otherwise("None")).otherwise(F.col("assay"))
    end = F.when(F.col("event_id") % 7 == 0, F.col("start")).otherwise(F.col("end"))  # rows that the reader counts and drops
    path = shared_path(spark, "unnamed")
    R.write_bed(peaks.select("chrom", "start", end.alias("end"), name.alias("name"), F.col("event_id").cast("string").alias("place")), path)
    rows = R.fill_names(R.read_bed(spark, path, signal_at=4, index="row_index"), "set")
    return rows.select(F.col("signal").cast("long").alias("event_id"), "name")


@query("SELECT p_partkey, CASE WHEN contains(p_brand, '1') THEN '+' ELSE '-' END AS strand FROM part")
def strand_from_name(spark, sf):
    name = F.when(F.col("p_brand").contains("1"), "x_minus.bed").otherwise("x_plus.bed")
    return table(spark, sf, "part").select("p_partkey", S.strand_of_file(name).alias("strand"))


@query("SELECT p_partkey, round(log2(p_retailprice + 1), 6) AS log2p1, round(ln(1 + p_retailprice), 6) AS log1p, round(-log10(greatest((p_partkey % 100) / 100.0, 1e-300)), 6) AS score FROM part")
def log_transforms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(S.log2p1("p_retailprice"), 6).alias("log2p1"), F.round(F.log1p("p_retailprice"), 6).alias("log1p"), F.round(S.neg_log10((F.col("p_partkey") % 100) / 100.0), 6).alias("score"))


@query(f"{cte('mtx')} SELECT gene, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, bool_and(value = 0) AS all_zero FROM mtx WHERE sample_id IN (1, 2, 3) GROUP BY 1")
def sample_statistics(spark, sf):
    return M.sample_stats(frame(spark, sf, "mtx"), "gene", "value", [1, 2, 3]).select("gene", r6("mean"), r6("sd"), "all_zero")


@query(f"{cte('de')} SELECT gene, greatest(abs(lfc_12), abs(lfc_30), abs(lfc_60)) AS abs_lfc_max FROM de")
def row_maximum(spark, sf):
    return frame(spark, sf, "de").select("gene", S.max_of(*(F.abs(f"lfc_{t}") for t in S.TIMES)).alias("abs_lfc_max"))


def _traj() -> str:
    d = "[dir_12, dir_30, dir_60]"
    return f"""CASE WHEN list_contains({d}, 'repressed') AND list_contains({d}, 'induced') THEN 'complex'
WHEN list_contains({d}, 'repressed') THEN CASE WHEN dir_60 = 'repressed' THEN 'repressed_sustained' ELSE 'repressed_transient' END
WHEN list_contains({d}, 'induced') THEN CASE WHEN dir_60 = 'induced' THEN 'induced_sustained' ELSE 'induced_transient' END
WHEN lrt_padj < 0.05 THEN 'lrt_only' ELSE 'not_responsive' END"""


def _response() -> str:
    d = "[dir_12, dir_30, dir_60]"
    return f"""CASE WHEN lrt_padj IS NULL OR lrt_padj >= 0.05 THEN 'not_sig' WHEN len(list_filter({d}, lambda x: x <> 'not_sig')) = 0 THEN 'sig_lrt_no_pairwise'
WHEN len(list_distinct(list_filter({d}, lambda x: x <> 'not_sig'))) > 1 THEN 'ambiguous'
ELSE concat(list_filter({d}, lambda x: x <> 'not_sig')[1], CASE WHEN dir_60 <> 'not_sig' THEN '_sustained' ELSE '_transient' END) END"""


def _hits(ts) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN dir_{t} <> 'not_sig' THEN '{t}' END" for t in ts) + ", 'NA')"


LABEL_CTE = f"labels AS (SELECT *, {_traj()} AS trajectory, {_response()} AS response, {_hits((12, 30, 60))} AS first_hit, {_hits((60, 30, 12))} AS last_hit FROM dirs)"
LABELS = f"{DIRS}, {LABEL_CTE}"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    de = directions(frame(spark, sf, "de"))
    dirs = [f"dir_{t}" for t in S.TIMES]
    return de.withColumns({"trajectory": S.trajectory(dirs, "lrt_padj"), "response": S.response_label("lrt_padj", dirs), "first_hit": S.first_hit(dirs, S.TIMES), "last_hit": S.first_hit(dirs[::-1], S.TIMES[::-1])})


@query(f"{LABELS} SELECT gene, dir_12, dir_30, dir_60, trajectory, response, first_hit, last_hit FROM labels")
def response_labels(spark, sf):
    return labels(spark, sf).select("gene", "dir_12", "dir_30", "dir_60", "trajectory", "response", "first_hit", "last_hit")


@query(f"{LABELS} SELECT gene, coalesce(dir_60 = 'repressed', false) AS repressed_60, dir_60 = 'induced' AS induced_60, trajectory = 'repressed_sustained' AS repressed_sustained FROM labels")
def indicators(spark, sf):
    return labels(spark, sf).select("gene", S.flag(F.col("dir_60") == "repressed").alias("repressed_60"), S.flag(F.col("dir_60") == "induced").alias("induced_60"), S.flag(F.col("trajectory") == "repressed_sustained").alias("repressed_sustained"))


@query("SELECT p_partkey, round(p_retailprice * 1e9 / (p_size * 1e6), 4) AS rpkm, round(log2((p_retailprice + 1e-3) / (p_size + 1e-3)), 6) AS damage FROM part WHERE p_size > 0")
def burden_scalars(spark, sf):
    return table(spark, sf, "part").where("p_size > 0").select("p_partkey", F.round(S.rpkm("p_retailprice", "p_size", F.lit(1e6)), 4).alias("rpkm"), F.round(S.log2_ratio("p_retailprice", "p_size"), 6).alias("damage"))


@query(f"""{cte('win')} SELECT concat(chrom, ':', CAST(start AS VARCHAR), '-', CAST("end" AS VARCHAR), ':', gene) AS locus FROM win""")
def locus_ids(spark, sf):
    return frame(spark, sf, "win").select(S.locus_id("chrom", "start", "end", "gene").alias("locus"))


@query(f"{cte('de')} SELECT gene, CASE WHEN padj_12 < 0.001 THEN '***' WHEN padj_12 < 0.01 THEN '**' WHEN padj_12 < 0.05 THEN '*' ELSE 'ns' END AS mark FROM de")
def significance_marks(spark, sf):
    return frame(spark, sf, "de").select("gene", S.stars("padj_12").alias("mark"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 20")
def quality_filter(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity >= 20").select("l_orderkey", "l_linenumber")


@query("SELECT l_partkey, l_suppkey, max(l_quantity) AS quality FROM lineitem GROUP BY 1, 2")
def dedup_fragments(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("quality"), "l_orderkey")
    return B.first_by(rows, ["l_partkey", "l_suppkey"], [F.desc("quality"), "l_orderkey"]).select("l_partkey", "l_suppkey", "quality")


@query(f"""{cte('peak')} SELECT event_id, CASE WHEN start // 100000 = ("end" - 1) // 100000 AND start // 100000 % 2 = 0 THEN concat(chrom, 'n') END AS chrom,
CASE WHEN start // 100000 = ("end" - 1) // 100000 AND start // 100000 % 2 = 0 THEN start - start // 100000 * 100000 + 7 END AS start FROM peak""")
def remap_intervals(spark, sf):
    peaks = frame(spark, sf, "peak")
    starts = peaks.select("chrom").distinct().select("chrom", F.explode(F.expr("sequence(0L, 900000L, 200000L)")).alias("start"))
    blocks = starts.select("chrom", "start", (F.col("start") + 100000).alias("end"), F.concat("chrom", F.lit("n")).alias("to_chrom"), F.lit(7).cast("long").alias("to_start"))
    mapped, unmapped = I.remap(peaks, blocks, ["event_id"])
    return mapped.select("event_id", "chrom", "start").unionByName(unmapped.select("event_id", F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("long").alias("start")))


@query(f"{cte('mtx')} SELECT gene, sample_id, value FROM mtx WHERE gene IN (SELECT gene FROM mtx GROUP BY gene HAVING count(*) FILTER (value >= 100) >= 3)")
def count_prefilter(spark, sf):
    return M.prefilter(frame(spark, sf, "mtx"), "gene", "value", 100, 3)


@query(f"{cte('mtx')} SELECT gene, avg(value) AS mean FROM mtx WHERE sample_id IN (1, 2) GROUP BY 1")
def samples_of_time(spark, sf):
    names = {f"s{k}_t0{k % 2}": k for k in range(1, 8)}
    chosen = M.select_samples(list(names), "00", {n: "00" for n, k in names.items() if k in (1, 2)})
    return M.sample_stats(frame(spark, sf, "mtx"), "gene", "value", [names[n] for n in chosen]).select("gene", "mean")


@query(f"{cte('meas')} SELECT gene FROM meas WHERE measure > 0 AND log2(measure + 1) > log2(2)")
def threshold_filter(spark, sf):
    return frame(spark, sf, "meas").where((F.col("measure") > 0) & (S.log2p1("measure") > F.log2(F.lit(2.0)))).select("gene")


# joins


@query(f"""{cte('iv')} SELECT a.event_id AS event_id_a, b.event_id AS event_id_b, least(a."end", b."end") - greatest(a.start, b.start) AS overlap_bp FROM iv a JOIN iv b ON {OVER} WHERE a.event_type = 'click' AND b.event_type <> 'click'""")
def overlap_inner(spark, sf):
    iv = frame(spark, sf, "iv")
    return I.overlap_pairs(iv.where("event_type = 'click'"), iv.where("event_type <> 'click'"), width=512).select("event_id_a", "event_id_b", "overlap_bp")


@query(f"""{cte('win', 'peak')} SELECT a.gene, count(b.event_id) AS n_overlaps FROM win a LEFT JOIN peak b ON {OVER} GROUP BY 1""")
def overlap_counts(spark, sf):
    return I.overlap_count(frame(spark, sf, "win"), frame(spark, sf, "peak"), ["gene"]).select("gene", "n_overlaps")


@query(f"""{cte('win', 'peak')} SELECT a.gene, round(sum(signal), 6) AS signal_sum, max(signal) AS signal_max, count(*) AS n_peaks, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS overlap_bp FROM win a JOIN peak b ON {OVER} GROUP BY 1""")
def overlap_signal(spark, sf):
    out = I.max_signal(frame(spark, sf, "win"), frame(spark, sf, "peak"), ["gene"], "signal")
    return out.select("gene", r6("signal_sum"), "signal_max", "n_peaks", "overlap_bp")


@query(f"""{cte('peak')} SELECT event_id FROM peak a WHERE assay = 'click' AND EXISTS (SELECT 1 FROM peak b WHERE b.assay = 'view' AND a.chrom = b.chrom AND b.start <= (a.start + a."end") // 2 AND b."end" > (a.start + a."end") // 2)""")
def overlap_semi_center(spark, sf):
    clicks, views = assays(spark, sf)
    return I.overlap_semi(I.center(clicks), views, ["event_id"]).select("event_id")


@query(f"""{cte('peak')} SELECT event_id FROM peak a WHERE assay = 'click' AND NOT EXISTS (SELECT 1 FROM peak b WHERE b.assay = 'view' AND {OVER})""")
def overlap_exclusion(spark, sf):
    clicks, views = assays(spark, sf)
    return I.overlap_anti(clicks, views, ["event_id"]).select("event_id")


@query(f"""{cte('win', 'peak')}, f AS (SELECT gene, EXISTS (SELECT 1 FROM peak b WHERE assay = 'click' AND {OVER}) AS c, EXISTS (SELECT 1 FROM peak b WHERE assay = 'view' AND {OVER}) AS v FROM win a)
SELECT CASE WHEN c AND v THEN 'click+view' WHEN c THEN 'click' WHEN v THEN 'view' ELSE 'kept' END AS reason, count(*) AS n FROM f GROUP BY 1""")
def exclusion_reasons(spark, sf):
    clicks, views = assays(spark, sf)
    return I.exclude_with_reasons(frame(spark, sf, "win"), {"click": clicks, "view": views}, ["gene"])[1]


@query(f"{cte('gene', 'meas', 'de')} SELECT gene.gene, measure, lfc_12 FROM gene LEFT JOIN meas ON gene.gene = meas.gene LEFT JOIN de ON gene.gene = de.gene AND padj_12 IS NOT NULL")
def left_equi_chain(spark, sf):
    return A.left_chain(frame(spark, sf, "gene").select("gene"), [frame(spark, sf, "meas"), frame(spark, sf, "de").where("padj_12 is not null").select("gene", "lfc_12")], "gene")


@query(f"""{cte('gene', 'meas', 'de', 'ctrl')} SELECT CASE WHEN m IS NULL THEN 0 WHEN d IS NULL THEN 1 ELSE 2 END AS step, CASE WHEN m IS NULL THEN 'meas' WHEN d IS NULL THEN 'de' ELSE 'kept' END AS reason, count(*) AS n
FROM (SELECT gene.gene, meas.gene AS m, de.gene AS d FROM gene LEFT JOIN meas ON gene.gene = meas.gene LEFT JOIN de ON gene.gene = de.gene AND padj_12 IS NOT NULL) GROUP BY ALL""")
def join_losses(spark, sf):
    return A.inner_chain(frame(spark, sf, "gene").select("gene"), {"meas": frame(spark, sf, "meas"), "de": frame(spark, sf, "de").where("padj_12 is not null").select("gene", "lfc_12")}, "gene")[1]


@query(f"{cte('gene', 'ctrl')} SELECT gene, gene IN (SELECT gene FROM ctrl) AS in_ctrl FROM gene")
def membership_flag(spark, sf):
    return A.flag_in(frame(spark, sf, "gene").select("gene"), frame(spark, sf, "ctrl"), "gene", "in_ctrl")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def lookup_first(spark, sf):
    return B.first_by(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query(f"""{cte('win', 'peak')} SELECT DISTINCT gene, a.chrom AS chrom, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM win a JOIN peak b ON {OVER}""")
def clipped_loci(spark, sf):
    return I.intersect_distinct(frame(spark, sf, "win"), frame(spark, sf, "peak"), "gene")


@query("""WITH x AS (SELECT 'A' AS g, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'R', l_extendedprice FROM lineitem WHERE l_returnflag = 'R'),
e AS (SELECT g, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM x GROUP BY g), b AS (SELECT g, 1 + len(list_filter(q, lambda k: k < v)) AS bin, v FROM x JOIN e USING (g)),
s AS (SELECT g, bin, count(*) AS n, avg(v) AS m FROM b GROUP BY ALL)
SELECT a.bin AS bin, a.n AS n_a, b.n AS n_b, round(a.m - b.m, 4) AS difference FROM s a JOIN s b USING (bin) WHERE a.g = 'A' AND b.g = 'R' AND a.n >= 3 AND b.n >= 3""")
def matched_strata(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"))
    bins = B.qcut(rows, "v", 4, by=["g"]).groupBy("g", "bin").agg(F.count("*").alias("n"), F.avg("v").alias("m")).where("n >= 3")
    a, b = (bins.where(f"g = '{g}'").select("bin", F.col("n").alias(f"n_{k}"), F.col("m").alias(f"m_{k}")) for g, k in (("A", "a"), ("R", "b")))
    return a.join(b, "bin").select("bin", "n_a", "n_b", F.round(F.col("m_a") - F.col("m_b"), 4).alias("difference"))


@query(f"{cte('gene', 'ctrl')} SELECT gene, NOT (gene IN (SELECT gene FROM ctrl) OR p_size > 40) AS neither FROM gene")
def neither_flag(spark, sf):
    g = A.flag_in(frame(spark, sf, "gene"), frame(spark, sf, "ctrl"), "gene", "c")
    return g.select("gene", (~(F.col("c") | (F.col("p_size") > 40))).alias("neither"))


# windows, sorts, sets


@query(f"{cte('iv')}, m AS (SELECT *, max(\"end\") OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), k AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT chrom, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n_merged FROM k GROUP BY chrom, island")
def merge_islands(spark, sf):
    return I.merge(frame(spark, sf, "iv"), width=1 << 12)


@query("""WITH e AS (SELECT list_distinct(quantile_cont(p_size, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q FROM part)
SELECT p_partkey, 1 + len(list_filter(list_sort(q)[2:len(q) - 1], lambda k: k < p_size)) AS bin FROM part, e""")
def quantile_bins(spark, sf):
    return B.qcut(table(spark, sf, "part"), "p_size", 10).select("p_partkey", "bin")


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part WHERE p_size > 5)
SELECT p_partkey, CASE WHEN p_size <= 5 THEN 0 ELSE 1 + len(list_filter(q, lambda k: k < p_retailprice)) END AS bin FROM part, e""")
def quantile_bins_with_zero(spark, sf):
    return B.qcut(table(spark, sf, "part"), "p_retailprice", 4, zero=F.col("p_size") <= 5).select("p_partkey", "bin")


RANK = "rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0"


@query(f"SELECT p_partkey, {RANK} AS rank FROM part")
def tied_ranks(spark, sf):
    return B.avg_rank(table(spark, sf, "part"), "p_size", by=["p_brand"]).select("p_partkey", "rank")


@query(f"SELECT p_partkey, round(CASE WHEN n = 1 THEN r ELSE (r - 1) / (n - 1) END, 6) AS rank_norm FROM (SELECT p_partkey, {RANK} AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def normalised_ranks(spark, sf):
    return B.rank_norm(table(spark, sf, "part"), "p_size", by=["p_brand"]).select("p_partkey", r6("rank_norm"))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) / stddev_samp(p_retailprice) OVER (PARTITION BY p_brand), 6) AS z FROM part")
def z_scores(spark, sf):
    return B.zscore(table(spark, sf, "part"), "p_retailprice", by=["p_brand"]).select("p_partkey", r6("z"))


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5(concat(CAST(p_partkey AS VARCHAR), '|42')), p_partkey) AS n FROM part) WHERE n <= 100")
def sample_fixed(spark, sf):
    return B.sample_k(table(spark, sf, "part"), 100, "p_partkey").select("p_partkey")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat(CAST(p_partkey AS VARCHAR), '|7')), p_partkey) AS n FROM part) WHERE n <= 5")
def sample_per_group(spark, sf):
    return B.sample_k(table(spark, sf, "part"), 5, "p_partkey", seed=7, by=["p_brand"]).select("p_partkey")


@query(f"{cte('peak')} SELECT event_id, chrom, start FROM peak")
def sort_lexical(spark, sf):
    return I.sort_bed(frame(spark, sf, "peak")).select("event_id", "chrom", "start")


@query(f"""{cte('peak')} SELECT event_id, CAST(substr(chrom, 4) AS INT) AS place FROM peak""")
def sort_karyotype(spark, sf):
    return frame(spark, sf, "peak").select("event_id", S.karyotype_order("chrom").alias("place"), "start").orderBy("place", "start").select("event_id", "place")


@query(f"{cte('de')} SELECT gene, padj_12 FROM de ORDER BY padj_12 NULLS LAST, gene LIMIT 50")
def top_results(spark, sf):
    return frame(spark, sf, "de").select("gene", "padj_12").orderBy(F.col("padj_12").asc_nulls_last(), "gene").limit(50)


@query("SELECT event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS place, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def sort_by_preference(spark, sf):
    counts = table(spark, sf, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.count("*").alias("n"))
    key = S.preferred_order("event_type", ["signup", "purchase"])
    return counts.orderBy(key).select("event_type", key["place"].cast("int").alias("place"), "n")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(f"""{cte('peak')} SELECT chrom, start, "end" FROM peak""")
def union_rows(spark, sf):
    a, b = assays(spark, sf)
    return a.select("chrom", "start", "end").unionByName(b.select("chrom", "start", "end"))


@query(f"{cte('ctrl', 'sets')} SELECT coalesce(a.gene, b.gene) AS gene, a.gene IS NOT NULL AS in_a, b.gene IS NOT NULL AS in_b FROM (SELECT DISTINCT gene FROM ctrl) a FULL JOIN (SELECT DISTINCT gene FROM sets WHERE set_name LIKE '%1') b ON a.gene = b.gene")
def set_algebra(spark, sf):
    return A.key_sets(frame(spark, sf, "ctrl"), frame(spark, sf, "sets").where("set_name like '%1'"), "gene")
