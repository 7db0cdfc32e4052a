"""URL rules by a bit-parallel automaton: all glob patterns at once over each canonical URL.

A glob is a row of positions; ``?`` is any one character but ``/`` and ``?``, ``*`` any run of
those, ``**`` any run of characters at all; a backslash takes the meaning off the next. Positions of all patterns lie side by side in
64-bit words (Shift-And with wildcards): one mask per kind of character says which positions
it steps over, another at which positions a wildcard waits. A step shifts the state, masks it
and keeps the waiting positions, for all patterns and all URLs of a batch together; a carry
leads from word to word, so a pattern may be longer than a word. Characters that no pattern
names share one kind, so tables grow with the rules only.

The canonical URL is ``.`` and the host, the path, and the query after ``?``; scheme and
fragment go. A ``Rule`` of a host and a path prefix becomes the glob ``*.host path **``:
the leading dot makes the host itself and its subdomains alike. Of the rules that match, the
longest decides, of equally long ones that which blocks, then the first in order of its
text. Where none matches, the method's globs decide in the same way, and what no glob
matches is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path and is allowed
unless a glob matches the empty host; URLs of any length are read whole; repeated rows get a
row each; a null page_id stays null; other columns are ignored; an empty table gives no rows;
without rules and globs all is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of URLs that are stepped through together.
BLOCK_CHARS = 1 << 20

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` for a host with its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> list[str]:
        """Without a path, what follows the host must be a path, a query or nothing, not more of a name."""
        host = f"*.{plain(self.host)}"
        return [f"{host}{plain(self.path)}**"] if self.path else [host, f"{host}/**", f"{host}\\?**"]

    def __post_init__(self):
        if set("/?#") & set(self.host) or set("?#") & set(self.path) or self.path[:1] not in ("", "/"):
            raise ValueError(f"no host and path: {self.text}")


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: What decides where no rule does: hosts of gambling and adult sites, forms, carts, feeds and files that hold no prose.
GLOBS = (
    ("block", ".*casino*/**"),
    ("block", ".*adult*/**"),
    ("block", ".*poker*/**"),
    ("block", "*.xxx/**"),
    ("block", ".*/login**"),
    ("block", ".*/wp-login.php**"),
    ("block", ".*/**/cart/**"),
    ("block", ".*/**/feed/"),
    ("block", ".*/**.pdf"),
    ("block", ".*/**.zip"),
    ("block", ".*/**.jpg"),
    ("block", ".*/**.png"),
    ("block", ".*/**\\?replytocom=**"),
    ("allow", ".*.gov/**"),
)


def positions(glob: str) -> list[tuple[str, str]]:
    """(kind, character) of each position: ``char``, ``one``, ``run`` or ``all``; a backslash makes the next character a plain one."""
    out, k = [], 0
    while k < len(glob):
        if glob[k] == "\\" and k + 1 < len(glob):
            out.append(("char", glob[k + 1]))
            k += 2
        elif glob.startswith("**", k):
            out.append(("all", ""))
            k += 2
        else:
            out.append({"*": ("run", ""), "?": ("one", "")}.get(glob[k], ("char", glob[k])))
            k += 1
    return out


def plain(text: str) -> str:
    """A glob that matches ``text`` alone."""
    return re.sub(r"[*?\\]", r"\\\g<0>", text)


class Automaton:
    """Masks of all globs. A bit stands for a literal or ``?`` that has been stepped over, or for a pattern's start."""

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        bit, starts, self.ends = 0, [], []
        steps: list[tuple[int, str, str]] = []
        waits: list[tuple[int, str]] = []
        for glob in self.globs:
            starts.append(bit)
            for kind, char in positions(glob):
                if kind in ("run", "all"):
                    waits.append((bit, kind))
                else:
                    bit += 1
                    steps.append((bit, kind, char))
            self.ends.append(bit)
            bit += 1
        n = max(1, (bit + 63) // 64)
        self.known = np.array(sorted({ord(c) for _, kind, c in steps if kind == "char"} | {ord("/"), ord("?")}), np.uint32)
        kinds = len(self.known) + 1
        self.step, self.wait, self.first = np.zeros((kinds, n), np.uint64), np.zeros((kinds, n), np.uint64), np.zeros(n, np.uint64)
        barred = self.kind(np.array([ord("/"), ord("?")], np.uint32))
        free = np.ones(kinds, bool)
        free[barred] = False
        for at, kind, char in steps:
            where = free if kind == "one" else self.kind(np.array([ord(char)], np.uint32))
            self.step[where, at // 64] |= np.uint64(1 << at % 64)
        for at, kind in waits:
            self.wait[slice(None) if kind == "all" else free, at // 64] |= np.uint64(1 << at % 64)
        for at in starts:
            self.first[at // 64] |= np.uint64(1 << at % 64)

    def kind(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code point's kind; the last is that of all unnamed ones."""
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at, len(self.known))

    def run(self, urls: Sequence[str]) -> np.ndarray:
        """The state after each URL: a row of words for each."""
        out = np.zeros((len(urls), len(self.first)), np.uint64)
        sizes = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-sizes, kind="stable")
        for at in _blocks(order, sizes):
            out[at] = self._run([urls[k] for k in at], sizes[at])
        return out

    def _run(self, urls: list[str], sizes: np.ndarray) -> np.ndarray:
        """URLs by falling length: those that have ended drop off the end of the state."""
        kinds = self.kind(np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32))
        begin = np.cumsum(sizes) - sizes
        state = np.tile(self.first, (len(urls), 1))
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
        one, top = np.uint64(1), np.uint64(63)
        for t, n in enumerate(live.tolist()):
            c, now = kinds[begin[:n] + t], state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[c]) | (now & self.wait[c])
        return state

    def matches(self, urls: Sequence[str]) -> np.ndarray:
        """Whether each URL (row) matches each glob (column)."""
        state = self.run(urls)
        return np.column_stack([(state[:, at // 64] >> np.uint64(at % 64) & np.uint64(1)).astype(bool) for at in self.ends]) if self.ends else np.zeros((len(urls), 0), bool)


def _blocks(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of ``order`` of about BLOCK_CHARS characters, and of one URL at least."""
    upto, low = np.cumsum(sizes[order]), 0
    while low < len(order):
        before = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, before + BLOCK_CHARS, "right")))
        yield order[low:high]
        low = high


def ranked(rules: Sequence[Rule], globs: Sequence[tuple[str, str]]) -> list[tuple[str, str | None, str]]:
    """(verdict, rule text or None, glob), what decides first foremost."""
    mine = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    rest = sorted(globs, key=lambda g: (-len(g[1]), g[0] != "block", g[1]))
    return [*((r.verdict, r.text, g) for r in mine for g in r.globs), *((v, None, g) for v, g in rest)]


def first_match(machine: Automaton, urls: Sequence[str]) -> np.ndarray:
    """The number of the first glob that matches each URL; the number of globs if none does."""
    hit = np.column_stack([machine.matches(urls), np.ones(len(urls), bool)])
    return hit.argmax(axis=1)


def judge(rules: Sequence[Rule], globs: Sequence[tuple[str, str]]) -> Callable[[Batches], Batches]:
    """page_id, host, path, query in; page_id, host, path, rule, verdict, pattern out."""
    order = ranked(rules, globs)

    def decide(batches: Batches) -> Batches:
        machine = Automaton([g for _, _, g in order])
        texts = [pa.array([x[k] for x in order] + [last], pa.string()) for k, last in ((1, None), (0, "allow"), (2, None))]
        for batch in batches:
            pieces = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            first = pa.array(first_match(machine, [f".{h}{p}{q}" for h, p, q in pieces]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(t.take(first) for t in texts)], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return decide


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host with A-Z lower-cased, path, and query with its ``?``; empty without ``://``."""
    host, path, query = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", k), F.lit("")) for k in (1, 2, 3))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path, query


def verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[tuple[str, str]] = GLOBS) -> DataFrame:
    """page_id, host, path, rule (null if a glob or nothing decided), verdict, pattern (the deciding glob)."""
    host, path, query = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), query.alias("query"))
    return rows.mapInArrow(judge(rules, globs), "page_id long, host string, path string, rule string, verdict string, pattern string")


def allowed(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[tuple[str, str]] = GLOBS) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed."""
    host, path, query = parts(F.col("url"))
    order = ranked(rules, globs)

    @F.pandas_udf("boolean")
    def blocked(urls: pd.Series) -> pd.Series:
        first = first_match(Automaton([g for _, _, g in order]), urls.tolist())
        return pd.Series(np.array([v == "block" for v, _, _ in order] + [False])[first])

    return pages.where(~blocked(F.concat(F.lit("."), host, path, query)))
