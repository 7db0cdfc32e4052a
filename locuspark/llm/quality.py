"""Quality rules: per-document counts, and cross-document line frequency per host.

Lines are normalised (white space to one space, trimmed, lower case) and hashed. For each
host the distinct documents that hold a line are counted (rows with one text are one
document); a line of at least ``MIN_DOCS`` of them that otherwise differ is boilerplate and is
removed, however large the host is. "Differ" is measured by each
holder's *content key*, the smallest hash of its longer lines other than the line itself, or
that of its whole text if it has none: copies of a text share few keys, so the lines of a
text that was copied often are not taken for boilerplate. ``min_key_share=0`` turns that off
and leaves the plain count. A document that keeps under ``MIN_LEFT_PERCENT`` of its words is
rejected as depleted.

Defined results: null or empty text has no words, zero counts and fails the base rule; a
null host is a host of its own, apart from the empty one; repeated rows all get a row;
columns other than doc_id, text and source are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, edited, packed, slices, staged, text_bytes, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_DOCS = 10
MIN_KEY_SHARE = 0.5
KEY_LINE_CHARS = 40
MIN_LEFT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_SPACES = re.compile("[\\x20\\x09-\\x0D]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "uid long, doc_id long, host string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS) + ", keys array<long>, lines array<struct<line: long, n: long>>"


def _repeated_words(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Words of each row that lie in a WINDOW-word window found twice or more in that row."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    win = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        win = win * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    order = at[np.lexsort((win[at], row[at]))]
    same = (win[order][1:] == win[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    covered = np.zeros(len(h) + 1, np.int32)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return np.bincount(row[np.cumsum(covered[:-1]) > 0], minlength=n_rows)


def normal_line(line: str) -> str:
    return _SPACES.sub(" ", line).strip(" ").lower()


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.md5(line.encode(), usedforsecurity=False).digest()[:8], "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def read_lines(text: str | None) -> tuple[int, list[int], list[dict]]:
    """Lines equal to an earlier one, the two smallest hashes for content keys, and words by hash of each normalised line."""
    seen, n_dup, by_hash, longer = set(), 0, {}, set()
    for line in (text or "").split("\n"):
        if not (x := normal_line(line)):
            continue
        n_dup += line in seen
        seen.add(line)
        h = _hash(x)
        by_hash[h] = by_hash.get(h, 0) + x.count(" ") + 1
        if len(x) >= KEY_LINE_CHARS:
            longer.add(h)
    return n_dup, [_signed(h) for h in sorted(longer or by_hash)[:2]], [{"line": _signed(h), "n": n} for h, n in by_hash.items()]


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[at[1:]] - total[at[:-1]]


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns uid, doc_id, host, text_hash, text in; those of ``_SCHEMA`` out."""
    line_type = pa.list_(pa.struct([("line", pa.int64()), ("n", pa.int64())]))
    for batch in batches:
        text = batch.column(4)
        for low, high in slices(text):
            part = text.slice(low, high - low)
            b, at = text_bytes(part)
            row, _, _, h = words(part)
            solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
            n_dup, keys, lines = zip(*map(read_lines, part.to_pylist()), strict=True)
            counts = [np.bincount(row, minlength=len(part)), _per_row(solid & ((b & 0xC0) != 0x80), at), _per_row(_IS_SYMBOL[b], at), np.array(n_dup), _repeated_words(row, h, len(part))]
            same = [batch.column(k).slice(low, high - low) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*same, *(pa.array(c.astype(np.int64)) for c in counts), pa.array(keys, pa.list_(pa.int64())), pa.array(lines, line_type)],
                names=["uid", "doc_id", "host", "text_hash", *COUNTS, "keys", "lines"],
            )


def measured(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    return staged(rows.mapInArrow(measure, _SCHEMA), "quality")


def host_key() -> Column:
    """The host with null apart from all strings."""
    return F.when(F.col("host").isNull(), "").otherwise(F.concat(F.lit("="), "host")).alias("host")


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_key_share: float = MIN_KEY_SHARE) -> DataFrame:
    """host (as ``host_key``) and line of the boilerplate lines; texts and, in the share of keys, copies count once."""
    lines = rows.select(host_key(), "keys", "text_hash", F.explode("lines.line").alias("line"))
    other = F.when(F.get("keys", F.lit(0)) != F.col("line"), F.get("keys", F.lit(0))).otherwise(F.coalesce(F.get("keys", F.lit(1)), "text_hash"))
    texts = lines.select("host", "line", other.alias("key"), "text_hash").distinct()
    by_key = texts.groupBy("host", "line", "key").agg(F.count("*").alias("texts"))
    by_line = by_key.groupBy("host", "line").agg(F.sum("texts").alias("n_docs"), F.count("*").alias("n_keys"))
    return by_line.where((F.col("n_docs") >= min_docs) & (F.col("n_keys") >= min_key_share * F.col("n_docs"))).select("host", "line")


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, min_left_percent: int = MIN_LEFT_PERCENT, min_key_share: float = MIN_KEY_SHARE) -> DataFrame:
    """One row per document: the base counts, base_failed, removed_words, kept, boilerplate (line hashes)."""
    rows = measured(docs)
    lines = rows.select("uid", host_key(), F.explode("lines").alias("x")).select("uid", "host", "x.line", "x.n")
    hit = attach(lines, frequent_lines(rows, min_docs, min_key_share), ["host", "line"], ["uid"])
    removed = hit.groupBy("uid").agg(F.sum("n").alias("removed_words"), F.collect_set("line").alias("boilerplate"))
    out = rows.drop("lines", "keys").join(removed, "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < min_left_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def without_lines(text: str, boilerplate: list[int]) -> str:
    """The text without the lines of the given hashes."""
    drop = set(boilerplate)
    return "\n".join(x for x in text.split("\n") if _signed(_hash(normal_line(x))) not in drop)


def filter_documents(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without rejected documents and without boilerplate lines, columns as before."""
    out = verdicts(docs, **limits).where("kept").select(F.col("doc_id").alias("id"), "text_hash", "boilerplate").dropDuplicates(["id", "text_hash"])
    rows = packed(docs)
    kept = rows.join(out, rows["key_id"].eqNullSafe(out["id"]) & (rows["key_hash"] == out["text_hash"]))
    return edited(kept, "boilerplate", docs.schema, without_lines)
