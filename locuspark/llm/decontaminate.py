"""Benchmark decontamination by SimHash of item-sized windows and exact verification.

Each benchmark item has a 64-bit SimHash of its words. In a document, a window of as many
words as some item has is a candidate if enough of its five-word shingles occur in items of
just that many words; a window that fails this cannot reach the similarity, so nothing is lost.
Candidate windows get fingerprints. Fingerprints are cut into ``BLOCKS`` blocks; two that
differ in at most ``RADIUS`` bits differ in at most ``FLIPS`` bits of some block. An item is
listed under every value that its blocks can take so, a window under its own, and an
equi-join on (size, block number, value) finds all pairs within the radius. They are verified
by the exact Jaccard similarity of the two weighted bags of five-word shingles. An item of
fewer words is one shingle.

Candidate windows of a document that overlap make one span, whose text is written once,
however many windows it has; equal spans of different documents are looked up and verified
once. Tasks hold two bitmaps, of the items' shingles and of their shingles with the item's size: some
32 bits for each shingle of the benchmark, from 2**22 to 2**27 bits in all. A larger benchmark fills
them more, which lets more windows pass to the exact steps and loses none. Distinct item
lengths are the only other thing sent.

Defined results: null and empty texts match nothing; repeated items are reported each, repeated document rows once; a null doc_id
is reported as null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, SHINGLE_WORDS, attach, bag, bitmap, mix, shingles, slices, staged, text_bytes, weighted_jaccard, words

SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
WIDTH = 64 // BLOCKS
FLIPS = RADIUS // BLOCKS
#: Words whose bit counts are held at a time.
SPAN = 1 << 16
#: A bitmap has 2**TOKEN_BITS bits for each shingle, and at most 2**MOST_BITS.
TOKEN_BITS, MOST_BITS = 5, 27

Batches = Iterator[pa.RecordBatch]

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Running sums of +1 or -1 for each bit of each word, with a zero row first."""
    bits = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    return np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def fingerprints(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(sums[start + size] > sums[start], axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def sized(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of shingles as those of an item of ``size`` words."""
    with np.errstate(over="ignore"):
        return mix(tokens + np.uint64(size) * _STEP)


def read_items(batches: Batches) -> Batches:
    """item_id, text in; item_id, text, size, fingerprint, tokens (shingle hashes, alone and with the size) out."""
    for batch in batches:
        out = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row, _, _, h = words(pa.array([t], pa.string()))
            if len(h):
                x = np.unique(shingles(row, h)[1])
                print_ = int(fingerprints(bit_sums(h), np.zeros(1, np.int64), len(h))[0])
                out.append((i, t, len(h), print_, x.view(np.int64).tolist(), sized(x, len(h)).view(np.int64).tolist()))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item_id", "item", "size", "item_print", "tokens", "sized_tokens"])


def merged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of each window's span; windows come by their start, and those of a span overlap."""
    reach = np.maximum.accumulate(start + size)
    return np.cumsum(np.r_[False, start[1:] >= reach[:-1]])


def span_finder(known: np.ndarray, known_sized: np.ndarray, sizes: list[int], similarity: float) -> Callable[[Batches], Batches]:
    """doc_id, text_hash, text in; a row for each span of candidate windows out, equal spans of a text once."""
    parts = {n: max(1, n - SHINGLE_WORDS + 1) for n in sizes}
    need = {n: math.ceil(2 * m * similarity / (1 + similarity) - 1e-9) for n, m in parts.items()}
    packed, shift = (np.packbits(known, bitorder="little"), np.packbits(known_sized, bitorder="little")), 64 - int(len(known)).bit_length() + 1

    def has(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        at = (tokens >> np.uint64(shift)).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def starts(n: int, tokens: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Where windows of n words begin that have enough shingles of items of n words."""
        m = parts[n]
        total = np.r_[0, np.cumsum(hit)]
        start = np.flatnonzero(total[m:] - total[: len(total) - m] >= need[n])
        if len(start):
            here = np.flatnonzero(hit[start[0] : start[-1] + m]) + start[0]
            mine = np.zeros(len(total), np.int64)
            mine[here + 1] = has(packed[1], sized(tokens[here], n))
            total = np.cumsum(mine)
            start = start[total[start + m] - total[start] >= need[n]]
        return start

    def windows(h: np.ndarray, tokens: dict[int, np.ndarray], hits: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and fingerprint of the candidate windows of one text, by start."""
        found = [np.zeros((3, 0), np.int64)]
        for n in sizes:
            k = min(n, SHINGLE_WORDS)
            if len(h) < n or np.count_nonzero(hits[k]) < need[n]:
                continue
            start = starts(n, tokens[k], hits[k])
            while len(start):
                now = start[start < start[0] + SPAN]
                prints = fingerprints(bit_sums(h[now[0] : now[-1] + n]), now - now[0], n)
                found.append(np.vstack([now, np.full(len(now), n), prints]))
                start = start[len(now) :]
        every = np.hstack(found)
        return every[:, np.lexsort((every[1], every[0]))]

    def find(batches: Batches) -> Batches:
        lengths = sorted({min(n, SHINGLE_WORDS) for n in sizes})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("print", pa.int64())]))
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.column(2).slice(low, high - low)
                row, s, e, h = words(part)
                tokens, hits, some = {}, {}, np.zeros(len(part), bool)
                for size in lengths:
                    x = np.zeros(max(0, len(h) - size + 1), np.uint64)
                    for k in range(size if len(x) else 0):
                        x = x * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(x)]
                    tokens[size] = mix(x + np.uint64(size))
                    hits[size] = has(packed[0], tokens[size]) & (row[: len(x)] == row[len(h) - len(x) :])
                    least = min(n for i, n in need.items() if min(i, SHINGLE_WORDS) == size)
                    some |= np.bincount(row[: len(x)][hits[size]], minlength=len(part)) >= least
                b, out = text_bytes(part)[0], []
                for r in np.flatnonzero(some):
                    a, z = np.searchsorted(row, [r, r + 1])
                    cut = {size: slice(a, max(a, z - size + 1)) for size in lengths}
                    start, size, prints = windows(h[a:z], {k: tokens[k][c] for k, c in cut.items()}, {k: hits[k][c] for k, c in cut.items()})
                    span, seen = merged(start, size) if len(start) else start, set()
                    for own in np.split(np.arange(len(start)), np.flatnonzero(np.diff(span)) + 1) if len(start) else []:
                        base, end = int(start[own[0]]), int((start[own] + size[own]).max())
                        text = b[s[a + base] : e[a + end - 1]].tobytes().decode()
                        if text not in seen:
                            seen.add(text)
                            out.append((low + r, base, text, [{"start": x, "size": y, "print": v} for x, y, v in zip((start[own] - base).tolist(), size[own].tolist(), prints[own].tolist(), strict=True)]))
                if out:
                    at, *cols = zip(*out, strict=True)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), kind), strict=True))], names=["doc_id", "text_hash", "base", "span", "windows"])

    return find


def _blocks(column: str) -> Column:
    """The blocks of a fingerprint with their numbers, to explode."""
    return F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col(column), k * WIDTH).bitwiseAND((1 << WIDTH) - 1).alias("v")) for k in range(BLOCKS)))


def _near_blocks(column: str) -> Column:
    """As ``_blocks``, with every value within ``FLIPS`` bits of each block."""
    masks = F.lit([sum(1 << k for k in ks) for n in range(FLIPS + 1) for ks in itertools.combinations(range(WIDTH), n)]).cast("array<bigint>")
    return F.flatten(F.transform(_blocks(column), lambda x: F.transform(masks, lambda mask: F.struct(x["k"].alias("k"), x["v"].bitwiseXOR(mask).alias("v")))))


def verify(batches: Batches) -> Batches:
    """span_key, item_id, span, item, starts in; the best similarity of the item with one of the windows, and the first such start."""
    for batch in batches:
        out = []
        for span, item, starts in zip(*(batch.column(c).to_pylist() for c in ("span", "item", "starts")), strict=True):
            row, _, _, h = words(pa.array([span, item], pa.string()))
            k = np.searchsorted(row, 1)
            n, (_, *want) = len(h) - k, bag(*shingles(row[k:], h[k:]))
            like = [weighted_jaccard(bag(*shingles(row[x : x + n], h[x : x + n]))[1:], want) for x in sorted(starts)]
            best = max(like)
            out.append((best, sorted(starts)[like.index(best)], n))
        cols = zip(*out, strict=True) if out else [[]] * 3
        kinds = [pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("span_key"), batch.column("item_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["span_key", "item_id", "similarity", "start", "size"])


def _bits(items: DataFrame) -> int:
    n = items.agg(F.sum(F.size("tokens"))).first()[0] or 1
    return min(MOST_BITS, max(BITMAP_BITS, math.ceil(math.log2(n)) + TOKEN_BITS))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, start_word, n_words of the best window of each leaked item."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(read_items, "item_id long, item string, size long, item_print long, tokens array<long>, sized_tokens array<long>")
    items = staged(items.withColumn("item_key", F.monotonically_increasing_id()), "items")
    bits = _bits(items)
    known, known_sized = (bitmap(items.select(F.explode(c).alias("token")), "token", bits) for c in ("tokens", "sized_tokens"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    found = rows.mapInArrow(span_finder(known, known_sized, sizes, similarity), "doc_id long, text_hash long, base long, span string, windows array<struct<start: long, size: long, print: long>>")
    found = staged(found.withColumn("span_key", F.xxhash64("span")), "found")
    spans = staged(found.groupBy("span_key").agg(F.first("span").alias("span"), F.first("windows").alias("windows")), "spans")
    windows = spans.select("span_key", F.inline("windows"))
    # windows and the items' blocks are made by explode and many rows, so they are never broadcast
    left = windows.select("size", "print").distinct().select("*", F.explode(_blocks("print")).alias("block"))
    right = items.select("item_key", "size", "item_print", F.explode(_near_blocks("item_print")).alias("block"))
    near = left.join(right.hint("merge"), ["size", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    close = near.select("size", "print", "item_key").distinct()
    pairs = windows.join(close.hint("merge"), ["size", "print"]).groupBy("span_key", "item_key").agg(F.collect_set("start").alias("starts"))
    texts = attach(pairs.join(spans.select("span_key", "span"), "span_key"), items.select("item_key", "item_id", "item"), ["item_key"], ["span_key"], salts=4)
    like = texts.select("span_key", "item_id", "span", "item", "starts").mapInArrow(verify, "span_key long, item_id long, similarity double, start long, size long")
    like = staged(like.where(F.col("similarity") >= similarity), "like")
    both = found.select("doc_id", "text_hash", "base", "span_key").join(like, "span_key")
    top = both.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("base") - F.col("start")).alias("s"), "size")).alias("x"))
    return top.select("doc_id", "text_hash", "item_id", F.col("x.similarity").alias("similarity"), (-F.col("x.s")).alias("start_word"), F.col("x.size").alias("n_words"))


def drop_leaky(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = staged(leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"])
    return docs.join(bad, same, "left_anti")
