"""The queries of this package by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, html, langid, licenses, mixing, near_dedup, pii, quality, tokens, url_filter, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in licenses.TEMPLATES)
    words = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')".format
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT license, {grams} AS tg FROM (SELECT license, {words('body')} AS w FROM (VALUES {quoted}) AS v(license, body))),
d AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents),
plain AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\n]+', ' ', 'g') AS text FROM d),
parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM plain
  UNION ALL SELECT doc_id, part FROM (SELECT doc_id, unnest(string_split_regex(text, '\n *\n')) AS part FROM plain) WHERE contains(part, chr(10))
  UNION ALL SELECT doc_id, text FROM plain WHERE contains(text, chr(10))),
units AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words('part')} AS w FROM parts)),
pairs AS (
  SELECT doc_id, license, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice
  FROM units JOIN t ON 2 * least(len(g), len(tg)) >= {licenses.DICE} * (len(g) + len(tg)))
SELECT doc_id, license, count(*) AS n_units, round(max(dice), 6) AS best_dice FROM pairs WHERE dice >= {licenses.DICE} GROUP BY ALL
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", "removed_words")


OP3_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
win AS (SELECT uid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT uid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
rep AS (SELECT uid, i FROM win QUALIFY count(*) OVER (PARTITION BY uid, g) > 1),
cov AS (SELECT uid, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS j) GROUP BY uid),
raw AS (SELECT uid, host, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT uid, host, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT uid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY uid),
doc_lines AS (SELECT uid, host, norm, sum(len(norm) - len(replace(norm, ' ', '')) + 1) AS n FROM lines GROUP BY ALL),
sorted AS (
  SELECT uid, list_sort(list(md5(norm)) FILTER (length(norm) >= {quality.KEY_LINE_CHARS})) AS longer, list_sort(list(md5(norm))) AS hashes
  FROM doc_lines GROUP BY uid),
keys AS (SELECT uid, coalesce(longer, hashes) AS ks FROM sorted),
held AS (
  SELECT DISTINCT doc_lines.host, norm, md5(text) AS body, CASE WHEN ks[1] <> md5(norm) THEN ks[1] ELSE coalesce(ks[2], md5(text)) END AS key
  FROM doc_lines JOIN keys USING (uid) JOIN d USING (uid)),
freq AS (
  SELECT host, norm FROM held GROUP BY host, norm
  HAVING count(*) >= {quality.MIN_DOCS} AND count(DISTINCT key) >= {quality.MIN_KEY_SHARE} * count(*)),
gone AS (SELECT uid, sum(n) AS removed_words FROM doc_lines JOIN freq USING (host, norm) GROUP BY uid),
counts AS (
  SELECT d.uid, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN cov USING (uid) LEFT JOIN dup USING (uid) LEFT JOIN gone USING (uid)),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * (n_words - removed_words) >= {quality.MIN_LEFT_PERCENT} * n_words AS kept, CAST(removed_words AS BIGINT) AS removed_words
FROM judged
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages")).where("gap_bytes IS NULL")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {warc.MIN_SHARED} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(_table(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    """The same sweeps and cap rounds, one materialised step each."""
    steps, now = [], "w0"
    for k in range(mixing.SWEEPS):
        for d in mixing.DIMENSIONS:
            new = f"w{k}_{d}"
            steps.append(f"""{new} AS MATERIALIZED (
  SELECT source, lang, topic, tokens, weight * target / have AS weight
  FROM {now} JOIN (SELECT {d}, sum(weight) AS have FROM {now} GROUP BY {d}) USING ({d}) JOIN target_{d} USING ({d}))""")
            now = new
    steps.append(f"c0 AS MATERIALIZED (SELECT {mixing.KEEP} * sum(tokens) AS scale FROM cells)")
    for k in range(mixing.CAP_ROUNDS):
        steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT scale * {mixing.KEEP} * (SELECT sum(tokens) FROM cells) / (SELECT sum(tokens * least(1.0, scale * weight / tokens)) FROM {now}) AS scale FROM c{k})""")
    targets = ",\n".join(
        f"""target_{d} AS MATERIALIZED (SELECT {d}, part / sum(part) OVER () AS target FROM (SELECT {d}, pow(sum(tokens), {mixing.ALPHA}) AS part FROM cells GROUP BY {d}))"""
        for d in mixing.DIMENSIONS
    )
    return f"""
WITH labelled AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN text IS NULL THEN '(none)' WHEN contains(text, ' | ') THEN 'table'
              WHEN contains(text, '### ') OR contains(text, '$$$ ') THEN 'noise' WHEN contains(text, '!! ') THEN 'shouting'
              WHEN length(text) >= 2000 THEN 'long prose' ELSE 'short prose' END AS topic,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM labelled GROUP BY ALL HAVING sum(tokens) > 0),
{targets},
w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells),
{", ".join(steps)},
mix AS (SELECT source, lang, topic, weight, least(1.0, (SELECT scale FROM c{mixing.CAP_ROUNDS}) * weight / tokens) AS probability FROM {now})
SELECT doc_id, source, lang, topic, l.tokens AS tokens, round(coalesce(weight, 0), 6) AS weight, round(coalesce(probability, 0), 6) AS probability,
       CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < coalesce(probability, 0) AS sampled
FROM labelled l LEFT JOIN mix USING (source, lang, topic)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item that a document holds."""
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start_word", "n_words")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(_table(spark, sf_dir, "pages"))


def _glob_regex(glob: str) -> str:
    """The pattern of a whole string for a glob, of which no character but those of names, ``/`` and ``.`` is plain."""
    kinds = {"run": "[^/?]*", "all": "(.|\\n)*", "one": "[^/?]"}
    return "".join(kinds.get(kind) or f"[{char}]" for kind, char in url_filter.positions(glob))


def _op12_sql() -> str:
    texts = [f"({k}, '{verdict}', {f"'{rule}'" if rule else 'NULL'}, '{glob}', '{_glob_regex(glob)}')" for k, (verdict, rule, glob) in enumerate(url_filter.ranked(url_filter.RULES, url_filter.GLOBS))]
    return f"""
WITH globs AS (SELECT * FROM (VALUES {", ".join(texts)}) AS v(place, verdict, rule, pattern, regex)),
parts AS (
  SELECT row_number() OVER () AS uid, page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([?][^#]*)?', ['host', 'path', 'query']), {{'host': '', 'path': '', 'query': ''}}) AS u
  FROM pages),
urls AS (SELECT uid, page_id, translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.path AS path, u.query AS query FROM parts),
hits AS (SELECT uid, arg_min(globs, place) AS best FROM urls JOIN globs ON regexp_full_match('.' || host || path || query, regex) GROUP BY uid)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict, best.pattern AS pattern
FROM urls LEFT JOIN hits USING (uid)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(_table(spark, sf_dir, "documents"))
    restored = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def _op13_sql() -> str:
    groups = ", ".join(f"CAST(('0x' || substr(h, {8 * k + 1}, 8)) AS BIGINT) AS h{k + 1}" for k in range(4))
    marks = " OR ".join(f"contains(text, '{x}')" for x in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, {groups} FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR {marks} OR h3 % 100 >= {fim.FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM g),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{fim.PREFIX}' || prefix || '{fim.SUFFIX}' || suffix || '{fim.MIDDLE}' || middle
                        ELSE '{fim.SUFFIX}' || suffix || '{fim.PREFIX}' || prefix || '{fim.MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_near_dedup, op3_quality_rules, op4_warc, op5_language, op6_mixing, op7_decontaminate, op8_main_text, op9_personal_data, op10_token_counts, op11_whitening, op12_url_filter, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op4_warc": OP4_SQL, "op3_quality_rules": OP3_SQL, "op6_mixing": _op6_sql(), "op12_url_filter": _op12_sql(), "op13_fill_in_middle": _op13_sql()}
