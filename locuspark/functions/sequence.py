"""Column functions on nucleotide strings."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c


#: Motif classes in order of priority, each with its patterns in order.
MOTIFS = [
    ("loop1_3", [r"([gG]{3,}\w{1,3}){3,}[gG]{3,}"]),
    ("loop4_5", [r"([gG]{3,}\w{4,5}){3,}[gG]{3,}"]),
    ("loop6_7", [r"([gG]{3,}\w{6,7}){3,}[gG]{3,}"]),
    ("longLoop", [
        r"([gG]{3,}\w{1,12}){3,}[gG]{3,}",
        r"[gG]{3,}\w{1,7}[gG]{3,}\w{13,21}[gG]{3,}\w{1,7}[gG]{3,}",
    ]),
    ("simpleBulge", [
        r"[gG]{1,}\w{1,7}[gG]{2,}\w{1,7}([gG]{3,}\w{1,7}){2,}[gG]{3,}",
        r"[gG]{3,}\w{1,7}[gG]{1,}\w{1,7}[gG]{2,}\w{1,7}[gG]{3,}\w{1,7}[gG]{3,}",
        r"([gG]{3,}\w{1,7}){2,}[gG]{1,}\w{1,7}[gG]{2,}\w{1,7}[gG]{3,}",
        r"([gG]{3,}\w{1,7}){3,}[gG]{1,}\w{1,7}[gG]{2,}",
    ]),
    ("complexBulge", [
        r"[gG]{1,}\w{1,5}[gG]{2,}\w{1,7}[gG]{3,}\w{1,7}[gG]{1,}\w{1,5}[gG]{2,}\w{1,7}[gG]{3,}",
        r"[gG]{3,}\w{1,7}[gG]{1,}\w{1,5}[gG]{2,}\w{1,7}[gG]{3,}\w{1,7}[gG]{1,}\w{1,5}[gG]{2,}",
    ]),
    ("twoTetrads", [r"([gG]{2,}\w{1,7}){3,}[gG]{2,}"]),
]


def gc_fraction(seq: Column | str) -> Column:
    """Share of G and C; null for an empty sequence."""
    s = _c(seq)
    return F.length(F.translate(s, "ATN", "")) / F.nullif(F.length(s), F.lit(0))


def only_acgt(seq: Column | str) -> Column:
    return ~_c(seq).rlike("[^ACGT]")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def shortest(pattern: str) -> str:
    """A pattern that is found in the same texts with less backtracking: repeats of a group go no further than they must.

    More repeats than the least can be cut off before or behind the rest of the match, as a group of these
    patterns begins with the run that may stand after it.
    """
    return re.sub(r"\)\{(\d+),\}", r"){\1}", pattern)


def least_runs(pattern: str, size: int) -> int:
    """Separate runs of ``size`` Gs that every match of the pattern holds."""
    copied = re.sub(r"\(([^()]*)\)\{(\d+),?\d*\}", lambda m: m[1] * int(m[2]), pattern)
    return sum(int(n) >= size for n in re.findall(r"\[gG\]\{(\d+),\}", copied))


def _first_found(s: pa.Array, patterns: Sequence[str]) -> np.ndarray:
    """The number of the first pattern that is found in each text, else -1. Arrow's matcher (RE2, as in DuckDB) does not backtrack."""
    number, left = np.full(len(s), -1), np.flatnonzero(s.is_valid().to_numpy(zero_copy_only=False))
    for k, p in enumerate(patterns):
        hit = pc.match_substring_regex(s.take(pa.array(left)), p).to_numpy(zero_copy_only=False)
        number[left[hit]] = k
        left = left[~hit]
    return number


def _without_groups(pattern: str) -> str:
    """The pattern with groups that capture nothing."""
    return re.sub(r"(\\.|\[\^?\]?[^\]]*\])|\((?!\?)", lambda m: m[1] or "(?:", pattern)


def _spans(s: pa.Array, patterns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the first pattern that is found, and start and end of its leftmost match in code points."""
    number = _first_found(s, patterns)
    start, end = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    for k in np.unique(number[number >= 0]):
        rows = np.flatnonzero(number == k)
        texts = s.take(pa.array(rows))
        at = pc.find_substring_regex(texts, patterns[k]).to_numpy(zero_copy_only=False)
        hit = pc.extract_regex(texts, f"(?P<hit>{_without_groups(patterns[k])})").field("hit")
        if pc.sum(pc.binary_length(texts)).as_py() != pc.sum(pc.utf8_length(texts)).as_py():  # places are bytes
            at = np.array([len(x.encode()[:n].decode()) for x, n in zip(texts.to_pylist(), at, strict=True)])
        start[rows], end[rows] = at, at + pc.utf8_length(hit).to_numpy(zero_copy_only=False)
    return number, start, end


def _complement(s: pa.Array) -> pa.Array:
    """``reverse_complement`` of texts without nulls."""
    s = pa.array(s.to_pylist(), s.type) if s.offset else s
    _, offsets, data = s.buffers()
    table = np.arange(256, dtype=np.uint8)
    table[list(b"ACGTacgt")] = list(b"TGCAtgca")
    swapped = pa.py_buffer(table[np.frombuffer(data, np.uint8)]) if data else data
    return pc.utf8_reverse(pa.Array.from_buffers(s.type, len(s), [None, offsets, swapped]))


SPAN = "structure string, span_start int, span_end int"


def _structs(names: Sequence[str], number: np.ndarray, start: np.ndarray, end: np.ndarray, **more: pa.Array) -> pa.StructArray:
    none = number < 0
    cols = {"structure": pa.array([*names, "other"], pa.string()).take(pa.array(np.where(none, len(names), number)))}
    cols |= {c: pa.array(x.astype(np.int32), mask=none) for c, x in (("span_start", start), ("span_end", end))} | more
    return pa.StructArray.from_arrays(list(cols.values()), names=list(cols))


def motif_class(seq: Column | str, classes: Sequence[tuple[str, Sequence[str]]] = MOTIFS) -> Column:
    """The first class with a match, else other; no span is looked for."""
    names, flat = [n for n, ps in classes for _ in ps], [p for _, ps in classes for p in ps]

    def told(s: pa.Array) -> pa.Array:
        number = _first_found(s, flat)
        return pa.array([*names, "other"], pa.string()).take(pa.array(np.where(number < 0, len(names), number), mask=s.is_null().to_numpy(zero_copy_only=False)))

    return _arrow(told, "string")(_c(seq))


def classify_motif(seq: Column | str, classes: Sequence[tuple[str, Sequence[str]]] = MOTIFS) -> Column:
    """struct(structure, span_start, span_end): the first class with a match, its first pattern, leftmost match; else other."""
    names, flat = [n for n, ps in classes for _ in ps], [p for _, ps in classes for p in ps]

    def told(s: pa.Array) -> pa.Array:
        return _structs(names, *_spans(s, flat))

    return _arrow(told, SPAN)(_c(seq))


def _arrow(told, kind: str):
    """A function of Arrow arrays that a plan works out once: filters on its result stay behind it."""
    told.__annotations__ = {"s": pa.Array, "return": pa.Array}
    return F.arrow_udf(told, kind).asNondeterministic()


def classify_both_strands(seq: Column | str, classes: Sequence[tuple[str, Sequence[str]]] = MOTIFS) -> Column:
    """struct(structure, span_start, span_end, strand): the plus strand wins unless it is other."""
    names, flat = [n for n, ps in classes for _ in ps], [p for _, ps in classes for p in ps]

    def told(s: pa.Array) -> pa.Array:
        found = _spans(s, flat)
        rest = np.flatnonzero((found[0] < 0) & s.is_valid().to_numpy(zero_copy_only=False))
        minus = np.zeros(len(s), np.int64)
        for x, other in zip(found, _spans(_complement(s.take(pa.array(rest))), flat), strict=True):
            x[rest] = other
        minus[rest] = found[0][rest] >= 0
        return _structs(names, *found, strand=pa.array(["+", "-"]).take(pa.array(minus)))

    return _arrow(told, f"{SPAN}, strand string")(_c(seq))


def span_to_coords(start: Column | str, end: Column | str, strand: Column | str, span_start: Column | str, span_end: Column | str) -> Column:
    """struct(structure_start, structure_end, structure_center) of a span within an interval."""
    low = F.when(_c(strand) == "-", _c(end) - _c(span_end)).otherwise(_c(start) + _c(span_start))
    high = F.when(_c(strand) == "-", _c(end) - _c(span_start)).otherwise(_c(start) + _c(span_end))
    return F.struct(low.alias("structure_start"), high.alias("structure_end"), F.floor((low + high) / 2).alias("structure_center"))
