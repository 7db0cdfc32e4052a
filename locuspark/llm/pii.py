"""Personal data: four base patterns, and identifiers found by bootstrapped contexts.

Spans of the base patterns (email, ip, card, phone) and long hexadecimal digests are seed
entities. A lexical pattern is the pair of words before an identifier-like token; patterns
and token values form a graph. Confidence goes back and forth: a pattern is as good as the
share of all its occurrences in the corpus that confident values follow, given at least
``MIN_SUPPORT`` distinct ones, and a value is as good as its best accepted pattern. After
``ROUNDS`` rounds, all texts are read again, and what follows a pattern of at least
``MIN_CONFIDENCE`` is reported as kind ``id``, whatever its length and digits.

Defined results: null and empty texts have no spans; a span found by context that touches a
base span is dropped; repeated rows get a row each; a null doc_id stays null; other columns
are ignored. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, attach, bitmap, edited, packed, slices, staged, text_bytes, words

KINDS = ["email", "ip", "card", "phone", "id"]
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
ROUNDS = 3
MIN_ID_CHARS = 8
SEED_HEX = 32

#: Fixed patterns. A look-behind only skips starts within a run of digits that failed at its head.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: An identifier-like token: no white space, quotes or marks, at least two digits.
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/+=:@-]*[A-Za-z0-9=]")
#: What stands after a pattern: a token of any length, maybe in quotes or brackets.
_AFTER = re.compile(r"[\"'(\[{<]*([A-Za-z0-9](?:[A-Za-z0-9._/+=:@-]*[A-Za-z0-9=])?)")
_HEX = re.compile(rf"[0-9A-Fa-f]{{{SEED_HEX},}}")
_DIGIT = re.compile(r"[0-9]")
_SPACE = re.compile("[\\x20\\x09-\\x0D]+")
_PLACE = np.uint64(0xD6E8FEB86659FD93)

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("ctx", pa.int64()), ("value", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_())]))
_SCHEMA = "uid long, doc_id long, text_hash long, base array<struct<kind: string, start: long, end: long>>, found array<struct<ctx: long, value: long, start: long, end: long, seed: boolean>>"

Batches = Iterator[pa.RecordBatch]


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each starts where the run of name characters before its @ does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    if not _ANY.search(text):
        return []
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def _left(text: str, start: int) -> str | None:
    """The two words before ``start``, or None; a quote right before it is passed over."""
    while start and text[start - 1] in "\"'([{<":
        start -= 1
    if not start or not _SPACE.match(text, start - 1):
        return None
    reach = 64
    while True:
        head = max(0, start - reach)
        parts = [x for x in _SPACE.split(text[head:start]) if x]
        if head == 0 or len(parts) > 2:
            return " ".join(parts[-2:]) if len(parts) >= 2 else None
        reach *= 4


def _touches(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in spans)


def identifiers(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int, bool]]:
    """Left words, value, start, end, seed of the base spans and other identifier-like tokens."""
    out = [(left, text[s:e], s, e, True) for _, s, e in base if (left := _left(text, s))]
    taken, at = sorted((s, e) for _, s, e in base), 0
    for m in _TOKEN.finditer(text) if _ANY.search(text) else ():
        s, e = m.span()
        if e - s < MIN_ID_CHARS or len(_DIGIT.findall(m[0])) < 2:
            continue
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if _touches(taken[at : at + 8], s, e):
            continue
        if left := _left(text, s):
            out.append((left, m[0], s, e, bool(_HEX.fullmatch(m[0]))))
    return out


def _pair_hashes(pairs: list[str]) -> np.ndarray:
    _, _, _, h = words(pa.array(pairs, pa.string()))
    return (h[0::2] * _PLACE + h[1::2]).view(np.int64)


def scan(batches: Batches) -> Batches:
    """uid, doc_id, text_hash, text in; those of ``_SCHEMA`` out."""
    for batch in batches:
        for low, high in slices(batch.column(3)):
            bases, founds, lefts = [], [], []
            for text in batch.column(3).slice(low, high - low).to_pylist():
                base = base_spans(text or "")
                ids = identifiers(text, base) if text else []
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                founds.append([{"ctx": 0, "value": _hash(v), "start": s, "end": e, "seed": seed} for _, v, s, e, seed in ids])
                lefts += [x[0] for x in ids]
            ctx = iter(_pair_hashes(lefts).tolist() if lefts else [])
            for f in founds:
                for x in f:
                    x["ctx"] = next(ctx)
            same = [c.slice(low, high - low) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*same, pa.array(bases, _SPANS), pa.array(founds, _FOUND)], names=["uid", "doc_id", "text_hash", "base", "found"])


def followers(known: np.ndarray) -> Callable[[Batches], Batches]:
    """doc_id, text_hash, text in; ctx, start, end of the value after each pair of words whose bit is set out."""
    packed = np.packbits(known)

    def find(batches: Batches) -> Batches:
        known = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.column(2).slice(low, high - low)
                row, s, e, h = words(part)
                pair = (h[:-2] * _PLACE + h[1:-1])[row[:-2] == row[2:]]
                hit = known[pair >> np.uint64(64 - BITMAP_BITS)]
                at, pair = np.flatnonzero(row[:-2] == row[2:])[hit] + 2, pair[hit].view(np.int64)
                b, edge = text_bytes(part)
                rows, out, done = row[at], [], (-1, 0, 0)
                for ctx, r, start, end in zip(pair.tolist(), rows.tolist(), s[at].tolist(), e[at].tolist(), strict=True):
                    m = _AFTER.match(b[start:end].tobytes().decode())
                    if m:
                        if done[0] != r:
                            done = (r, int(edge[r]), 0)
                        done = (r, start, done[2] + len(b[done[1] : start].tobytes().decode()))
                        out.append((r, ctx, done[2] + m.start(1), done[2] + m.end(1)))
                if out:
                    r, ctx, start, end = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                    same = [batch.column(k).slice(low, high - low).take(r) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, ctx, start, end], names=["doc_id", "text_hash", "ctx", "start", "end"])

    return find


def pair_counter(known: np.ndarray) -> Callable[[Batches], Batches]:
    """text in; occurrences of each pair of words whose bit is set, by batch, out."""
    packed = np.packbits(known)

    def count(batches: Batches) -> Batches:
        known = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for low, high in slices(batch.column(0)):
                row, _, _, h = words(batch.column(0).slice(low, high - low))
                pair = (h[:-1] * _PLACE + h[1:])[row[:-1] == row[1:]]
                ctx, n = np.unique(pair[known[pair >> np.uint64(64 - BITMAP_BITS)]], return_counts=True)
                if len(ctx):
                    yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(n.astype(np.int64))], names=["ctx", "n"])

    return count


def confident_contexts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """ctx, confidence of the patterns that the bootstrap accepts."""
    found = rows.select(F.explode("found").alias("x")).select("x.*")
    edges = found.groupBy("ctx", "value").agg(F.max("seed").cast("double").alias("seed"), F.count("*").alias("n"))
    support = edges.groupBy("ctx").agg(F.count("*").alias("values")).where(F.col("values") >= MIN_SUPPORT).select("ctx")
    support = staged(support, "contexts")
    edges = staged(attach(edges, support, ["ctx"], ["value"]), "edges")
    totals = docs.select("text").mapInArrow(pair_counter(bitmap(support, "ctx")), "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("total"))
    totals = staged(totals, "totals")
    accepted, now = None, edges.withColumn("conf", F.col("seed"))
    for _ in range(ROUNDS):
        scored = now.groupBy("ctx").agg(F.sum("conf").alias("support"), F.sum(F.col("conf") * F.col("n")).alias("hits")).join(totals, "ctx")
        accepted = staged(scored.select("ctx", "support", (F.col("hits") / F.col("total")).alias("confidence")).where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT)), "patterns")
        if accepted.isEmpty():
            break
        values = attach(edges, accepted.select("ctx", "confidence"), ["ctx"], ["value"]).groupBy("value").agg(F.max("confidence").alias("gained"))
        now = staged(attach(edges, values, ["value"], ["ctx"], how="left").select("ctx", "value", "seed", "n", F.greatest("seed", F.coalesce("gained", F.lit(0.0))).alias("conf")), "edges")
    return accepted.select("ctx", "confidence")


def spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, spans (array of kind, start, end)."""
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    rows = staged(slim.mapInArrow(scan, _SCHEMA), "identifiers")
    accepted = confident_contexts(rows, docs)
    after = slim.drop("uid").mapInArrow(followers(bitmap(accepted, "ctx")), "doc_id long, text_hash long, ctx long, start long, end long")
    value = F.struct("start", "end")
    new = attach(after, accepted, ["ctx"], ["text_hash", "start"]).groupBy("doc_id", "text_hash").agg(F.collect_set(value).alias("new"))
    new = staged(new.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash"), "values")
    both = rows.join(new, rows["doc_id"].eqNullSafe(new["_id"]) & (rows["text_hash"] == new["_hash"]), "left")
    free = F.filter("new", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    ids = F.transform(F.array_sort(free), lambda x: F.struct(F.lit("id").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return both.select("doc_id", "text_hash", F.concat("base", F.coalesce(ids, F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint>>)"))).alias("spans"))


def _joined(spans_of: Iterator[dict]) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in sorted(spans_of, key=lambda x: (KINDS.index(x["kind"]), x["start"])))


def digest(batches: Batches) -> Batches:
    """doc_id, spans in; the counts, the digest of the base spans and all spans as text out."""
    for batch in (x.slice(k, 1024) for x in batches for k in range(0, len(x), 1024)):
        out = []
        for found in batch.column(1).to_pylist():
            n = [sum(x["kind"] == k for x in found) for k in KINDS]
            base = _joined(x for x in found if x["kind"] != "id")
            out.append((*n[:4], hashlib.sha256(base.encode()).hexdigest(), _joined(found), n[4]))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_id"])


def report(docs: DataFrame) -> DataFrame:
    return spans(docs).select("doc_id", "spans").mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_id long")


def masked(text: str, found: list[dict]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the first, then the longer, stays."""
    parts, at = [], 0
    for x in sorted(found, key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= at:
            parts += [text[at : x["start"]], f"[{x['kind'].upper()}]"]
        at = max(at, x["end"])
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans masked and n_chars counted anew; columns as before."""
    found = spans(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("id"), "text_hash", "spans").dropDuplicates(["id", "text_hash"])
    rows = packed(docs)
    both = rows.join(found, rows["key_id"].eqNullSafe(found["id"]) & (rows["key_hash"] == found["text_hash"]), "left")
    return edited(both, "spans", docs.schema, masked)
