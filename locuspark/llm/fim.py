"""Fill-in-the-middle: texts cut at two code points and put together in another order.

A text's possible cuts are the byte offsets at which a code point begins, and its end: a set
of whole numbers, kept as compressed bitmaps are. Offsets are split into chunks of 2^16; a
chunk's container is a list of runs, a sorted array or a bitmap, whichever is smallest
(plain ASCII is one run, a text of long code points an array or a bitmap). The containers'
cumulative cardinalities lead to the one that holds the k-th boundary, and a select inside
it gives the byte offset. So a text is never decoded, and both cuts are two look-ups.

The cuts and the form come from the first 32-bit groups h1 to h4 of the SHA-256 of
``seed:doc_id``: prefix and middle end after the smaller and the larger of h1 and h2 modulo
n + 1; a text stays plain if it is empty, holds a marker, or h3 modulo 100 is not below
``fim_percent``; the suffix goes first if h4 modulo 100 is below ``spm_percent``.

Defined results: a null text counts as empty; a null doc_id is hashed as no digits; repeated
rows are cut alike; texts of any length are cut whole; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

SEED = 1
FIM_PERCENT = 90
SPM_PERCENT = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 16

Batches = Iterator[pa.RecordBatch]


class Runs:
    """Stretches of consecutive members: where each begins, and how many members come before it."""

    def __init__(self, first: np.ndarray, below: np.ndarray):
        self.first, self.below = first.tolist(), below.tolist()

    def select(self, k: int) -> int:
        at = bisect_right(self.below, k) - 1
        return self.first[at] + k - self.below[at]


class Members:
    """All members in order."""

    def __init__(self, members: np.ndarray):
        self.members = members.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.members[k])


class Bits:
    """A bit for each number of the chunk, and the members before each group of 512."""

    GROUP = 512

    def __init__(self, mask: np.ndarray):
        self.bits = np.packbits(np.pad(mask, (0, -len(mask) % self.GROUP)), bitorder="little")
        ones = np.unpackbits(self.bits).reshape(-1, self.GROUP).sum(axis=1)
        self.below = (np.cumsum(ones) - ones).tolist()

    def select(self, k: int) -> int:
        at = bisect_right(self.below, k) - 1
        width = self.GROUP // 8
        group = np.unpackbits(self.bits[at * width : (at + 1) * width], bitorder="little")
        return at * self.GROUP + int(np.flatnonzero(group)[k - self.below[at]])


def container(mask: np.ndarray) -> Runs | Members | Bits:
    """The smallest container of the numbers at which ``mask`` is set."""
    members = np.flatnonzero(mask)
    begins = np.flatnonzero(np.diff(members, prepend=-2) != 1)
    sizes = {"runs": 4 * len(begins), "members": 2 * len(members), "bits": CHUNK // 8}
    kind = min(sizes, key=sizes.get)
    return Runs(members[begins], begins) if kind == "runs" else Members(members) if kind == "members" else Bits(mask)


class Boundaries:
    """The byte offsets of a UTF-8 text at which a code point begins, and the text's end."""

    def __init__(self, utf8: np.ndarray):
        starts = np.ones(len(utf8) + 1, bool)
        starts[:-1] = (utf8 & 0xC0) != 0x80
        self.containers, self.upto, total = [], [], 0
        for low in range(0, len(starts), CHUNK):
            mask = starts[low : low + CHUNK]
            total += int(np.count_nonzero(mask))
            self.containers.append(container(mask))
            self.upto.append(total)

    def __len__(self) -> int:
        return self.upto[-1]

    def select(self, k: int) -> int:
        """The k-th boundary, from 0."""
        at = bisect_right(self.upto, k)
        return at * CHUNK + self.containers[at].select(k - (self.upto[at - 1] if at else 0))


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearranged(seed: int, fim_percent: int, spm_percent: int) -> Callable[[Batches], Batches]:
    """doc_id, text in; doc_id, n, form, prefix_chars, middle_chars, output out."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def one(doc_id: int | None, utf8: np.ndarray) -> tuple:
        text, cuts = utf8.tobytes(), Boundaries(utf8)
        n, (h1, h2, h3, h4) = len(cuts) - 1, draws(doc_id, seed)
        if not n or h3 % 100 >= fim_percent or any(x in text for x in (p, s, m)):
            return n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = cuts.select(a), cuts.select(b)
        before, middle, after = text[:i], text[i:j], text[j:]
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, b"".join((s, after, p, before, m, middle))
        return n, "psm", a, b - a, b"".join((p, before, s, after, m, middle))

    def cut(batches: Batches) -> Batches:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for low, high in slices(batch.column(1)):
                ids = batch.column(0).slice(low, high - low)
                utf8, at = text_bytes(batch.column(1).slice(low, high - low))
                rows = [one(i, utf8[x:y]) for i, x, y in zip(ids.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return cut


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (null if plain), output (the text as it is to be trained on)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(rearranged(seed, fim_percent, spm_percent), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form. A cut text holds no marker, so each marker is where it is first found."""
    order = F.when(form == "psm", F.array(F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE))).otherwise(F.array(F.lit(SUFFIX), F.lit(PREFIX), F.lit(MIDDLE)))
    width = len(PREFIX)
    second, third = F.instr(output, order[1]), F.instr(output, order[2])
    one, two, three = F.substr(output, F.lit(width + 1), second - width - 1), F.substr(output, second + width, third - second - width), F.substr(output, third + width)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
