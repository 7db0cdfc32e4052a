"""Stateless operators on streams: a stream of intervals against a static table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.intervals import BIN, overlap_pairs


def annotate_stream(stream: DataFrame, static: DataFrame, width: int = BIN, suffixes: Sequence[str] = ("_a", "_b")) -> DataFrame:
    """Overlap pairs of a streaming DataFrame with a static one; no state is kept."""
    if not stream.isStreaming:
        raise ValueError("the first table must be a stream")
    return overlap_pairs(stream, static, width, suffixes)
