"""Readers. All take explicit columns; text is never guessed at. Missing values are NA, empty or NaN."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import number_or_null
from .staging import staged

FASTA_CHUNK = 1 << 15


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with their place in the source: file, where their byte range begins, and a number that grows within the range."""
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _fields(spark: SparkSession, path: str | Sequence[str], comment: str = "#") -> DataFrame:
    """Tab-separated fields of each line that is not empty or a comment, with its place."""
    lines = _lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith(comment))
    return lines.select(F.split("value", "\t").alias("f"), "file", "block", "row")


def row_index(rows: DataFrame, name: str = "row_index") -> DataFrame:
    """Rows with a place (file, block, row) numbered from 0 in the order of their source: files by path, ranges, rows.

    Only each byte range's number of rows is put in order; rows themselves are counted within their range.
    """
    held = staged(rows, "placed")
    ranges = held.groupBy("file", "block").agg(F.count("*").alias("_n"))
    files = ranges.groupBy("file").agg(F.sum("_n").alias("_all"))
    before = files.select("file", F.coalesce(F.sum("_all").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_file"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.withColumn("_block", F.coalesce(earlier, F.lit(0))).join(before, "file").select("file", "block", (F.col("_file") + F.col("_block")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("row")) - 1
    return held.withColumn("_place", place).join(offsets, ["file", "block"]).withColumn(name, (F.col("_offset") + F.col("_place")).cast("long")).select(*rows.columns, name)


def _at(k: int | None, kind: str = "string") -> Column:
    return F.lit(None).cast(kind) if k is None else F.get("f", F.lit(k)).cast(kind)


def read_bed(spark: SparkSession, path: str | Sequence[str], name_at: int | None = 3, signal_at: int | None = None, strand_at: int | None = None, contigs: Sequence[str] | None = None, strict: bool = False, index: str | None = None) -> DataFrame:
    """chrom, start, end, name, signal, strand of BED or narrowPeak files.

    Empty intervals and contigs outside the list are dropped. ``strict`` fails on a line of
    under three fields, or, with a strand column, on a strand other than + or -. ``index`` names a
    column for the number of the row in its source, from 0, counted before rows are dropped.
    """
    fields = _fields(spark, path)
    numbered = [index] if index else []
    rows = (row_index(fields, index) if index else fields).select(*numbered, F.size("f").alias("n"), _at(0).alias("chrom"), _at(1, "long").alias("start"), _at(2, "long").alias("end"), _at(name_at).alias("name"), number_or_null(_at(signal_at)).alias("signal"), _at(strand_at).alias("strand"))
    if strict:
        bad = F.col("n") < 3 if strand_at is None else (F.col("n") < 3) | ~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False))
        rows = rows.where(F.when(bad, F.raise_error(F.lit("malformed interval line")).cast("boolean")).otherwise(True))
    rows = rows.where("end > start").drop("n")
    return rows.where(F.col("chrom").isin(list(contigs))) if contigs else rows


def fill_names(df: DataFrame, dataset: str, index: str = "row_index", name: str = "name") -> DataFrame:
    """Names that are empty or say nothing become the data set's name with the row's number in its source."""
    empty = F.coalesce(F.trim(name), F.lit("")).isin("", ".", "nan", "None")
    return df.withColumn(name, F.when(empty, F.concat(F.lit(f"{dataset}_"), F.col(index).cast("string"))).otherwise(F.col(name)))


def read_bedgraph(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _fields(spark, path).select(_at(0).alias("chrom"), _at(1, "long").alias("start"), _at(2, "long").alias("end"), number_or_null(_at(3)).alias("value"))


def read_contig_sizes(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """chrom, size; fails if a required contig is missing."""
    sizes = _fields(spark, path).select(_at(0).alias("chrom"), _at(1, "long").alias("size"))
    found = {r[0] for r in sizes.where(F.col("chrom").isin(list(required))).select("chrom").distinct().collect()} if required else set()
    if missing := set(required) - found:
        raise ValueError(f"contigs without a size: {sorted(missing)}")
    return sizes


def contig_intervals(sizes: DataFrame) -> DataFrame:
    return sizes.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))


def read_gtf(spark: SparkSession, path: str, features: Sequence[str] = ("transcript", "exon"), biotype: str | None = "protein_coding") -> DataFrame:
    """chrom, feature, start, end (1-based, inclusive), strand and the usual attributes of the chosen features."""
    rows = _fields(spark, path).where(_at(2).isin(list(features)))

    def attribute(name: str) -> Column:
        got = F.regexp_extract(_at(8), rf'\b{name} "([^"]+)"', 1)
        return F.when(got != "", got).alias(name)

    out = rows.select(_at(0).alias("chrom"), _at(2).alias("feature"), _at(3, "long").alias("start"), _at(4, "long").alias("end"), _at(6).alias("strand"), *map(attribute, ("gene_id", "transcript_id", "gene_name", "gene_type", "transcript_type")))
    return out.where((F.col("gene_type") == biotype) & (F.col("transcript_type") == biotype)) if biotype else out


def read_fasta_chunks(spark: SparkSession, path: str, chunk: int = FASTA_CHUNK, contigs: Sequence[str] | None = None) -> DataFrame:
    """chrom, start, seq: each contig, upper case, in rows of ``chunk`` bases.

    Spark reads byte ranges of a file; bases are counted within ranges, and what an unfinished contig
    had before a range comes from the ranges' own totals (a row for each range). So a contig over many
    ranges is read by many tasks, and none holds more than a line and the chunks it puts together. Bases before the
    first header have no contig and are left out.
    """
    text = F.upper(F.regexp_replace("value", r"\s+", ""))
    header = F.col("value").startswith(">")
    lines = _lines(spark, path).select("file", "block", "row", F.when(header, F.struct(F.col("row").alias("record"), F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("chrom"))).alias("head"), F.when(~header, text).alias("seq"))
    lines = staged(lines.withColumn("bases", F.coalesce(F.length("seq"), F.lit(0)).cast("long")).where("head is not null or bases > 0"), "fasta")
    within = Window.partitionBy("file", "block").orderBy("row")
    counted = lines.withColumn("upto", F.coalesce(F.sum("bases").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    known = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = counted.withColumns({"own": F.last("head", ignorenulls=True).over(known), "at_head": F.last(F.when(F.col("head").isNotNull(), F.col("upto")), ignorenulls=True).over(known)})
    last = lines.where("head is not null").groupBy("file", "block").agg(F.max("head").alias("head"))
    tails = lines.join(last.select("file", "block", F.col("head.record").alias("_record")), ["file", "block"], "left").groupBy("file", "block").agg(F.sum(F.when(F.col("row") > F.coalesce("_record", F.lit(-1)), F.col("bases")).otherwise(0)).alias("tail"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = tails.join(last, ["file", "block"], "left").withColumn("total", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    carried = ranges.select("file", "block", F.last("head", ignorenulls=True).over(earlier).alias("carried"), (F.col("total") - F.coalesce(F.last(F.when(F.col("head").isNotNull(), F.col("total")), ignorenulls=True).over(earlier), F.lit(0))).alias("before"))
    placed = own.where("bases > 0").join(carried, ["file", "block"])
    at = F.when(F.col("own").isNull(), F.col("before") + F.col("upto")).otherwise(F.col("upto") - F.col("at_head"))
    named = placed.select(F.coalesce("own", "carried").alias("head"), at.alias("at"), "bases", "seq").where("head is not null").select("head.chrom", F.col("head.record").alias("record"), "at", "bases", "seq")
    if contigs:
        named = named.where(F.col("chrom").isin(list(contigs)))
    parts = named.select("*", F.explode(F.sequence(F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.col("bases") - 1) / chunk))).alias("k"))
    low = F.greatest(F.col("at"), F.col("k") * chunk)
    piece = F.substr("seq", (low - F.col("at") + 1).cast("int"), (F.least(F.col("at") + F.col("bases"), (F.col("k") + 1) * chunk) - low).cast("int"))
    whole = parts.select("chrom", "record", "k", F.struct(low.alias("at"), piece.alias("piece")).alias("p")).groupBy("chrom", "record", "k").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("chrom", (F.col("k") * chunk).cast("long").alias("start"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))


def read_tsv(spark: SparkSession, path: str | Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """A table with a header, all text; NA and empty become null, listed columns numbers."""
    rows = spark.read.csv(path if isinstance(path, str) else list(path), sep="\t", header=True, inferSchema=False)
    clean = [number_or_null(F.col(f"`{c}`")).alias(c) if c in numbers else F.when(~F.col(f"`{c}`").isin("", "NA"), F.col(f"`{c}`")).alias(c) for c in rows.columns]
    return rows.select(*clean)


def read_quant(spark: SparkSession, path: str, sample_pattern: str, times: Sequence[str]) -> DataFrame:
    """Transcript rows of many samples: sample, replicate and time come from the folder's name.

    ``sample_pattern`` has groups for the sample, the replicate and the time, in this order.
    """
    rows = spark.read.csv(path, sep="\t", header=True, schema="Name string, Length double, EffectiveLength double, TPM double, NumReads double")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    parts = [F.regexp_extract(folder, sample_pattern, k).alias(n) for k, n in ((1, "sample_id"), (2, "replicate"), (3, "timepoint"))]
    named = rows.select(*parts, F.col("Name").alias("transcript_id"), F.col("Length").alias("length"), F.col("EffectiveLength").alias("eff_length"), F.col("TPM").alias("tpm"), F.col("NumReads").alias("num_reads"))
    return named.where((F.col("sample_id") != "") & F.col("timepoint").isin(list(times)))


#: Names of a sample's four files: of reads and of simulated reads, by strand.
TRACKS = ("real_plus", "real_minus", "sim_plus", "sim_minus")


def manifest(samples: DataFrame, method: str, folder: str = "", name: str = "name") -> DataFrame:
    """Samples of one method from a table of configurations, with the paths of their four BED files below ``folder``."""
    paths = {f"{t}_bed": F.concat(F.lit(f"{folder.rstrip('/')}/" if folder else ""), F.col(name).cast("string"), F.lit(f"/{t}.bed")) for t in TRACKS}
    return samples.where(F.col("method") == method).withColumns(paths)


def read_samples(spark: SparkSession, samples: DataFrame, name: str = "name") -> DataFrame:
    """name, kind (real, sim), strand and the intervals of all files of a manifest that exist; samples are few."""
    parts = []
    for row in samples.select(F.col(name).cast("string").alias("name"), *(f"{t}_bed" for t in TRACKS)).collect():
        for t in TRACKS:
            for p in existing(spark, [row[f"{t}_bed"]]):
                kind, strand = t.split("_")
                bed = read_bed(spark, p).select("chrom", "start", "end")
                parts.append(bed.select(F.lit(row["name"]).alias("name"), F.lit(kind).alias("kind"), F.lit("+" if strand == "plus" else "-").alias("strand"), "chrom", "start", "end"))
    if not parts:
        return spark.createDataFrame([], "name string, kind string, strand string, chrom string, start long, end long")
    return functools.reduce(DataFrame.unionByName, parts)


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """set_name, gene of a gene-set file; short lines and empty names are dropped."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    return lines.select(_at(0).alias("set_name"), F.explode(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0)))).alias("gene")).select("set_name", F.trim("gene").alias("gene")).where("gene <> ''")


#: Names under which a manifest may give a set's name, its file of genes, and its genes.
SET_NAMES, SET_FILES, SET_GENES = ("set_name", "name", "geneset", "id"), ("genes_file", "file", "filename", "path"), ("genes", "gene_list", "gene_ids", "members")


def read_gene_set_manifest(rows: DataFrame, folder: str = "") -> DataFrame:
    """set_name, gene from rows that name a file of genes (first field of each line), or else list genes separated by commas.

    A file is looked for below ``folder`` unless its path is absolute; a set whose file does not exist is empty. Files are read together.
    """
    at = {kind: next((c for c in names if c in rows.columns), None) for kind, names in (("name", SET_NAMES), ("file", SET_FILES), ("genes", SET_GENES))}
    empty = rows.sparkSession.createDataFrame([], "set_name string, gene string")
    if at["name"] is None:
        return empty
    path, genes = (F.col(at[k]).cast("string") if at[k] else F.lit(None).cast("string") for k in ("file", "genes"))
    sets = rows.select(F.col(at["name"]).cast("string").alias("set_name"), path.alias("path"), genes.alias("genes"))
    listed = sets.where("path is null").select("set_name", F.explode(F.split("genes", ",")).alias("gene"))
    return listed.unionByName(_genes_of_files(sets.where("path is not null"), folder)).select("set_name", F.trim("gene").alias("gene")).where("gene <> ''").distinct()


def _genes_of_files(sets: DataFrame, folder: str) -> DataFrame:
    """set_name, gene of the sets' files; their paths come to the driver, which lists them."""
    spark, found = sets.sparkSession, []
    for name, path in sets.select("set_name", "path").collect():
        full = path if path.startswith("/") or "://" in path or not folder else f"{folder.rstrip('/')}/{path}"
        for p in existing(spark, [full]):
            found += [(name, f) for f in spark.read.text(p).inputFiles()]
    if not found:
        return spark.createDataFrame([], "set_name string, gene string")
    lines = spark.read.text(sorted({f for _, f in found})).select(F.input_file_name().alias("file"), F.split("value", ",")[0].alias("gene"))
    return lines.join(spark.createDataFrame(found, "set_name string, file string"), "file").select("set_name", "gene")


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that Spark can list."""
    found = []
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p).schema  # noqa: B018  lists the path only
            found.append(p)
        except AnalysisException:
            continue
    return found


def union_files(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """read_bed over those of the files that exist."""
    return read_bed(spark, existing(spark, paths), **options)


def assert_min_rows(df: DataFrame, n: int, label: str = "table") -> DataFrame:
    """``df`` if it has at least ``n`` rows, else an error; reads no more than it needs."""
    found = df.limit(n).count()
    if found < n:
        raise ValueError(f"{label}: {found} rows, at least {n} wanted")
    return df


def contrast_label(df: DataFrame) -> DataFrame:
    """First known numerator and denominator as ``numerator_vs_denominator``."""
    first = df.agg(F.first("numerator", ignorenulls=True).alias("n"), F.first("denominator", ignorenulls=True).alias("d"))
    return first.select(F.concat_ws("_vs_", "n", "d").alias("contrast"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, nullValue="NA", emptyValue="")


def write_bed(df: DataFrame, path: str, score: str | None = "score") -> None:
    """BED without a header; scores get six decimals."""
    out = df.withColumn(score, F.format_string("%.6f", F.col(score))) if score and score in df.columns else df
    out.write.csv(path, sep="\t", header=False, nullValue=".", emptyValue="")
