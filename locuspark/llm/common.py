"""What several text operators share: shared-folder tables, salted lookups and word hashes.

Word hashes are 64-bit and computed for many texts at once with numpy. A *word* is a
run of bytes other than space and 0x09-0x0D, so the same words come out of
``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy pass handles; a longer text is cut at white space.
BLOCK_BYTES = 1 << 20
#: Ways in which rows of one key are dealt out by ``attach``.
SALTS = 32
SHINGLE_WORDS = 5
BITMAP_BITS = 22

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder (``spark.checkpoint.dir``).

    Only a session whose driver and executors are one local process may leave that unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salt_of(*cols: Column | str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join ``rows`` to the one row that ``facts`` has for each key, dealing a frequent key out.

    ``facts`` is repeated once per salt and each row goes to the salt that its ``spread``
    columns give, so no task gets all rows of a key. The copies are never broadcast: Spark's
    estimates of sizes do not count what explode repeats, so they would be 32 times too low.
    """
    salted = rows.withColumn("_salt", salt_of(*spread, salts=salts))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``doc``, so no other column can clash with its columns, keyed by id and text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("key_id"), F.xxhash64("text").alias("key_hash"))


def edited(df: DataFrame, facts: str, schema: StructType, edit: Callable[[str, list], str]) -> DataFrame:
    """Rows of ``packed`` with ``text`` put through ``edit(text, facts)`` where there are facts; n_chars follows, if there is one."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = dict(zip(schema.names, batch.column(0).flatten(), strict=True))
            for low, high in slices(fields["text"]):
                cols = {k: v.slice(low, high - low) for k, v in fields.items()}
                texts, given = cols["text"].to_pylist(), batch.column(1).slice(low, high - low).to_pylist()
                changed = [bool(t and g) for t, g in zip(texts, given, strict=True)]
                texts = [edit(t, g) if c else t for t, g, c in zip(texts, given, changed, strict=True)]
                cols["text"] = pa.array(texts, cols["text"].type)
                if "n_chars" in cols:
                    n = [len(t) if c else old for t, c, old in zip(texts, changed, cols["n_chars"].to_pylist(), strict=True)]
                    cols["n_chars"] = pa.array(n, cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=schema.names)

    return df.select("doc", facts).mapInArrow(rewrite, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _PLACE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def _block_words(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in ``b``; no word goes over a cut."""
    solid = ~_is_space(b)
    if not solid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[cuts[cuts < len(b)]] |= solid[cuts[cuts < len(b)]]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    where = np.flatnonzero(solid)
    lengths = ends - starts
    place = np.arange(len(where)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    parts = _BYTE_CODE[b[where]] * _power(int(lengths.max()))[place]
    return starts, ends, mix(np.add.reduceat(parts, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * _STEP)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text each, and of one row at least."""
    _, at = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high
        low = high


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end (bytes in the column) and hash of each word of the texts, in order."""
    b, at = text_bytes(column)
    found, low = [], 0
    while low < len(b):
        high = min(len(b), low + BLOCK_BYTES)
        if high < len(b) and high not in at:
            blank = np.flatnonzero(_is_space(b[low:high]))
            while not len(blank) and high < len(b):  # a word longer than a block
                high = min(len(b), high + BLOCK_BYTES)
                blank = np.flatnonzero(_is_space(b[low:high]))
            high = low + int(blank[-1]) + 1 if len(blank) else high
        cuts = at[(at > low) & (at < high)] - low
        s, e, h = _block_words(b[low:high], cuts)
        found.append((s + low, e + low, h))
        low = high
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    s, e, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.searchsorted(at, s, "right") - 1, s, e, h


def shingles(row: np.ndarray, h: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every ``size``-word shingle; a text of fewer words has one, of all its words."""
    n = len(h)
    if not n:
        return row, h
    total, acc = h.copy(), np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        acc = acc * _PLACE + h[k : n - size + 1 + k] if len(acc) else acc
    inside = row[: len(acc)] == row[size - 1 :] if len(acc) else np.zeros(0, bool)
    long_rows, long_h = row[: len(acc)][inside], mix(acc[inside] + np.uint64(size))
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    short_rows, short_h = [], []
    for f, c in zip(first[count < size], count[count < size], strict=True):
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for v in total[f : f + c]:
                x = x * _PLACE + v
        short_rows.append(row[f])
        short_h.append(mix(np.array([x + np.uint64(c)], np.uint64))[0])
    if short_rows:
        long_rows = np.r_[long_rows, np.array(short_rows, row.dtype)]
        long_h = np.r_[long_h, np.array(short_h, np.uint64)]
        order = np.argsort(long_rows, kind="stable")
        return long_rows[order], long_h[order]
    return long_rows, long_h


def bag(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) and how often each occurs, sorted by row, then hash."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])]) if len(r) else np.zeros(0, np.int64)
    return r[first], x[first], np.diff(np.r_[first, len(r)])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two (hashes, counts) bags; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def bitmap(tokens: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of 2**bits bits with the top bits of each hash set; at most 2**(bits - 6) rows come to the driver."""
    at = F.shiftrightunsigned(F.col(column), 64 - bits + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) % 64 as int))")
    rows = tokens.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    cells = np.zeros(1 << (bits - 6), np.int64)
    for at, word in rows.toLocalIterator():
        cells[at] = word
    return np.unpackbits(cells.astype("<i8").view(np.uint8), bitorder="little").astype(bool)
