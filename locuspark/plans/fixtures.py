"""Interval, gene and measurement tables derived from the given star schema.

Each is one expression list over one table, so the Spark frame and the SQL text of its twin
come from the same place; ``{s}`` is the text type and ``{d}`` integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SIZE = 1_000_000
G_RICH = "GATGCGAGTGGCGGAGCGTGGACGTGGAC"
G_POOR = "GATGCGACTGACTGAGCATCGACGTATAC"

_GENE_ID = "concat('ENSG', lpad(cast(p_partkey as {s}), 8, '0'), '.', cast(p_size as {s}))"
_KEY = "concat('ENSG', lpad(cast(p_partkey as {s}), 8, '0'))"
_TSS = "(p_partkey * 7919) % 1000000"
_CHROM = "concat('chr', cast({} % 22 + 1 as {{s}}))"
_AT = "(event_id * 104729) % 1000000"

#: name: (table, where, expressions, group by)
TABLES = {
    "gene": ("part", None, [f"{_GENE_ID} as gene_id", f"{_KEY} as gene", f"{_CHROM.format('p_partkey')} as chrom", f"{_TSS} as tss", "case when p_partkey % 2 = 0 then '+' else '-' end as strand", "p_partkey", "p_size", "p_brand"], None),
    "win": ("part", None, [f"{_KEY} as gene", f"{_CHROM.format('p_partkey')} as chrom", f"greatest({_TSS} - 500, 0) as start", f"least({_TSS} + 501, 1000000) as \"end\"", "case when p_partkey % 2 = 0 then '+' else '-' end as strand"], None),
    "peak": ("events", "event_type in ('click', 'view')", ["event_id", "event_type as assay", f"{_CHROM.format('user_id')} as chrom", f"{_AT} as start", f"{_AT} + 50 + event_id % 400 as \"end\"", "value as signal"], None),
    "ctrl": ("part", "p_size % 10 = 0", [f"{_KEY} as gene"], None),
    "iv": ("events", None, ["event_id", "event_type", "concat('c', cast(user_id % 25 as {s})) as chrom", "{minutes} as start", "{minutes} + 60 + event_id % 600 as \"end\""], None),
    "mtx": ("lineitem", None, [f"{_KEY.replace('p_partkey', 'l_partkey')} as gene", "l_linenumber as sample_id", "sum(l_quantity) as value"], "1, 2"),
    "meas": ("lineitem", None, [f"{_KEY.replace('p_partkey', 'l_partkey')} as gene", "sum(l_extendedprice) as measure"], "1"),
    "de": ("part", None, [f"{_KEY} as gene", *(x for t in (12, 30, 60) for x in (f"((p_partkey * {t} * 37) % 401 - 200) / 100.0e0 as lfc_{t}", f"case when p_partkey % 17 = 0 then null else ((p_partkey * {t} * 53) % 1000) / 1000.0e0 end as padj_{t}")), "case when p_partkey % 13 = 0 then null else ((p_partkey * 29) % 1000) / 5000.0e0 end as lrt_padj"], None),
    "read": ("events", "event_type in ('purchase', 'error', 'signup')", ["event_id", "case when event_type = 'signup' then 'sim' else 'real' end as kind", "user_id % 4 as sample_id", "user_id % 2 as product", f"{_CHROM.format('user_id')} as chrom", f"{_AT} as start", f"{_AT} + 20 as \"end\""], None),
    "sets": ("part", None, ["p_brand as set_name", f"{_KEY} as gene"], None),
    "track": ("orders", None, [f"{_CHROM.format('o_custkey')} as chrom", "((o_orderkey * 193) % 1000000) {d} 500 * 500 as start", "((o_orderkey * 193) % 1000000) {d} 500 * 500 + 500 as \"end\"", "avg(o_totalprice) as value"], "1, 2, 3"),
    "two": ("lineitem", None, ["l_returnflag as grp", "l_quantity as value", "l_extendedprice as price", "l_discount as discount", "l_linenumber as stratum"], None),
}


def _fill(text: str, duck: bool) -> str:
    minutes = "epoch_us(ts) // 60000000" if duck else "unix_micros(cast(ts as timestamp)) div 60000000"
    out = text.replace("{s}", "varchar" if duck else "string").replace("{d}", "//" if duck else "div").replace("{minutes}", minutes)
    return out if duck else out.replace('"end"', "`end`")


def sql(name: str, duck: bool = True) -> str:
    table, where, exprs, group = TABLES[name]
    return _fill(f"SELECT {', '.join(exprs)} FROM {table}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {group}" if group else ""), duck)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = TABLES[name][0]
    text = sql(name, duck=False).replace(f" FROM {source}", " FROM {source}", 1)
    return spark.sql(text, source=table(spark, sf_dir, source))


def sequences(spark: SparkSession, sf_dir: str, alphabet: str = G_POOR) -> DataFrame:
    """chrom, start, seq: each document as a contig of bases."""
    return table(spark, sf_dir, "documents").selectExpr("concat('d', cast(doc_id as string)) as chrom", "0L as start", f"regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz .,', '{alphabet}'), '[^ACGT]+', '') as seq")


def tiles_sql(alphabet: str = G_POOR, size: int = 150) -> str:
    """DuckDB: chrom, start, end, seq of whole tiles."""
    return f"""SELECT chrom, k * {size} AS start, (k + 1) * {size} AS "end", substr(seq, CAST(k * {size} + 1 AS BIGINT), {size}) AS seq
FROM (SELECT chrom, seq, unnest(range(0, length(seq) // {size})) AS k FROM (
  SELECT concat('d', CAST(doc_id AS VARCHAR)) AS chrom, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz .,', '{alphabet}'), '[^ACGT]', '', 'g') AS seq FROM documents))"""


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({sql(n)})" for n in names)
