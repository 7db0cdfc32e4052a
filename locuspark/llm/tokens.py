"""Token counts of a byte-level BPE vocabulary, as its own library gives them.

Arrow functions take texts in slices balanced by bytes and return lengths only. A text is
split at safe boundaries, before a space that a non-space follows: the vocabulary's own
splitting always starts a new piece there, and its special string holds no space. The
library encodes each distinct piece of a task once, in batches; lengths add up.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a
text count as the library's default counts them; repeated rows get a row each; a null
doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

LIMIT = 1024
#: Characters of pieces whose lengths a task keeps at most; beyond it starts anew.
CACHE_CHARS = 8 << 20
SLICE_BYTES = 4 << 20

#: A piece: up to the next space that a non-space follows. Any white space counts.
_PIECE = re.compile(r"(?: (?=\S))?(?:[^ ]| (?!\S))+")
#: White space other than a lone space between words calls for the pattern.
_ODD_SPACE = re.compile(r" (?=\s|\Z)")


def pieces(text: str) -> list[str]:
    """The text in parts whose tokens do not depend on each other."""
    if _ODD_SPACE.search(text):
        return _PIECE.findall(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


def counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text in; doc_id, n_bytes, n_tokens out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        known: dict[str, int] = {}
        held = 0
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                part = batch.column(1).slice(low, high - low)
                cut = [pieces(t) if t else [] for t in part.to_pylist()]
                if held > CACHE_CHARS:
                    known.clear()
                    held = 0
                new = list({p for one in cut for p in one if p not in known})
                held += sum(map(len, new))
                known.update(zip(new, map(len, library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
                n = [sum(map(known.__getitem__, one)) for one in cut]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(text_bytes(part)[1])), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``path`` names a tokenizer file that all executors have."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counter(path), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
