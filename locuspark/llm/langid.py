"""Language identification by compression with a raw-content dictionary per language.

A dictionary holds the distinct words of a bounded sample of a language's labelled texts
(about ``SAMPLE_DOCS`` documents, chosen by a hash of id and text; each is read whole), the most
frequent last, where matches cost least. A text is cut into chunks, each chunk is
compressed with each dictionary, and the language with the smallest total
wins. The score is the margin to the runner-up: the share of bytes saved, scaled so
that ``SURE`` counts as 1. ``rejected`` marks margins under ``MIN_SCORE``.

There is one dictionary per value of ``lang``, held by the driver and all tasks: labels must be
languages, so few.

Defined results: ``und``, score 0 and rejected where a text is null, has no letter (as
``str.isalpha`` says), or no language was learned; ties go to the language first in order; a null doc_id is not held out
and not learned from; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 300
CHUNK_CHARS = 300
LEVEL = 12
SURE = 0.1
MIN_SCORE = 0.05

_NO_LETTER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(text: str) -> str:
    """Lower case, with all that is not a letter as one space."""
    plain = _NO_LETTER.sub(" ", text.lower())
    if not plain.replace(" ", "").isalpha():  # number signs and the like
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    return plain.strip()


def sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text in; lang, word and how often, by batch, out."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(letters(text).split())
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary of each language; the distinct words of about SAMPLE_DOCS texts per language come to the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(order).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SAMPLE_DOCS / n))))
    few = rows.where(order < share[F.col("lang")]).groupBy("lang", order.alias("o")).agg(F.first("text").alias("text"))
    found: dict[str, list] = {}
    for r in few.select("lang", "text").mapInArrow(sample_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        found.setdefault(r["lang"], []).append((r["n"], r["word"]))
    return {lang: " ".join(w for _, w in sorted(found[lang])).encode() for lang in sorted(found)}


def chunks(text: str) -> Iterator[bytes]:
    for k in range(0, len(text), CHUNK_CHARS):
        yield text[k : k + CHUNK_CHARS].encode()


def classifier(model: dict[str, bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, held_out, text in; doc_id, held_out, lang_pred, score, rejected out."""
    langs = sorted(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        # The dictionary itself is text, so it is used as plain content, not as a trained one.
        packers = []
        for lang in langs:
            d = zstd.ZstdCompressionDict(model[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstd.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))

        def judge(text: str | None) -> tuple[str, float]:
            plain = letters(text) if text and packers else ""
            if not plain:
                return "und", 0.0
            total = [0] * len(packers)
            for c in chunks(plain):
                for k, p in enumerate(packers):
                    total[k] += len(p.compress(c))
            order = sorted(range(len(total)), key=lambda k: (total[k], k))
            if len(order) == 1:
                return langs[0], 1.0
            margin = (total[order[1]] - total[order[0]]) / total[order[1]]
            return langs[order[0]], min(1.0, margin / SURE)

        for batch in batches:
            pred, score = zip(*map(judge, batch.column(2).to_pylist()), strict=True) if len(batch) else ((), ())
            rejected = [s < MIN_SCORE for s in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return classify


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(classifier(learn(docs)), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
