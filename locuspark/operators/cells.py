"""Reads counted over the parts that windows and loci share, and values of overlapping rows, within cells of a contig.

A part belongs to the cell that holds its first base, and its windows, loci and reads are all brought there, so equal parts of
a gene meet in one cell, are told apart there, and are summed up there: no part is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Narrowest and widest cells, in bases; and pairs that a task looks at together.
NARROW, WIDE, PAIRS = 1 << 11, 1 << 17, 1 << 21
#: Cells for values of overlapping rows, in bases: at least this.
VALUES = 1 << 15

LOCUS = "gene string, chrom string, start long, end long, _product int, n_samples long, real_rpkm_mean double, real_rpkm_max double, sim_rpkm_mean double, damage_mean double, damage_max double"
GENE = "gene string, _product int, n_loci long, damage_max double, damage_sum double, real_rpkm_max double, real_rpkm_sum double"


def longest(df: DataFrame) -> int:
    return df.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1


def _listed(df: DataFrame, width: int, first: Column, last: Column, of: Column, gene: Column | None = None) -> DataFrame:
    """Rows for each cell from the one of base ``first`` to that of base ``last``; ``_of`` is 0 for windows, 1 for loci, from 2 on for reads."""
    bins = F.sequence(F.floor(first / width), F.floor(last / width))
    live = df.where(F.col("chrom").isNotNull() & (F.col("start") < F.col("end")))
    named = F.lit(None).cast("string") if gene is None else gene
    return live.select("chrom", F.explode(bins).alias("_bin"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), of.cast("int").alias("_of"), named.alias("gene"))


def _parts(code: np.ndarray, ws: np.ndarray, we: np.ndarray, ps: np.ndarray | None, pe: np.ndarray | None, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gene, start, end) of the distinct parts of a cell that begin in it, about ``PAIRS`` pairs at a time; windows come in order of their gene's code."""
    step, k = PAIRS if ps is None else max(1, PAIRS // len(ps)), 0
    while k < len(ws):
        upto = int(np.searchsorted(code, code[min(k + step, len(ws)) - 1], "right"))  # all windows of a gene stay together
        s, e, g = ws[k:upto], we[k:upto], code[k:upto]
        if ps is not None:
            i, j = np.nonzero((s[:, None] < pe[None, :]) & (e[:, None] > ps[None, :]))
            s, e, g = np.maximum(s[i], ps[j]), np.minimum(e[i], pe[j]), g[i]
        here = (s >= 0) & (s < width)
        s, e, g = s[here], e[here], g[here]
        one = np.unique((g * width + s) * (2 * width + 1) + e)
        k = upto
        if len(one):
            yield one // (2 * width + 1) // width, one // (2 * width + 1) % width, one % (2 * width + 1)


def shared_parts(windows: DataFrame, loci: DataFrame, key: str, width: int) -> DataFrame:
    """Each distinct part that the windows of a key share with loci: the key, chrom, start, end; ``width`` is at least a part's length."""
    place = ["chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")]
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin")
    live = [x.where(F.col("chrom").isNotNull() & (F.col("start") < F.col("end"))) for x in (windows, loci)]
    rows = live[0].select(F.col(key).alias("_key"), *place, F.lit(True).alias("_asked"), bins).unionByName(live[1].select(*place, F.lit(False).alias("_asked"), bins), allowMissingColumns=True)
    schema = live[0].select(F.col(key).alias("_key"), *place).schema

    def cell(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = group[1].as_py() * width
        asked, loci = [], np.empty((2, 0), np.int64)
        for batch in batches:
            asks = batch.column("_asked")
            if asks.true_count:
                asked.append(batch.filter(asks).select(["_key", "start", "end"]))
            if asks.false_count:
                rest = batch.filter(pc.invert(asks))
                loci = np.unique(np.concatenate([loci, np.stack([rest.column(c).to_numpy() - low for c in ("start", "end")])], axis=1), axis=1)
        if not asked or not loci.shape[1]:
            return
        table = pa.Table.from_batches(asked)
        keys = table.column("_key").combine_chunks().dictionary_encode(null_encoding="encode")
        code = keys.indices.to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        start, end = (table.column(c).to_numpy()[order] - low for c in ("start", "end"))
        for g, s, e in _parts(code[order], start, end, *loci, width):
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(g)), pa.repeat(group[0], len(g)), pa.array(s + low), pa.array(e + low)], names=schema.names)

    return rows.groupBy("chrom", "_bin").applyInArrow(cell, schema).withColumnRenamed("_key", key)


def shared_part_rates(windows: DataFrame, loci: DataFrame | None, reads: DataFrame, most: int, samples: list[tuple[int, int, int]], whole: bool) -> DataFrame:
    """Per gene, distinct part and product its rates over the product's samples (``whole``), or what they add to the gene.

    ``windows`` has gene, chrom, start, end; ``loci`` chrom, start, end, or None where windows are the parts; ``reads`` _sample, _real, chrom,
    start, end. ``samples`` lists product number, real and simulated reads of each sample; no part is longer than ``most``. A read is listed
    only where a part that it overlaps may begin: in its own cells, and in the one before if it starts less than ``most`` bases into its first.
    """
    width = max(NARROW, 1 << (most - 1).bit_length())
    start, last = F.col("start"), F.col("end") - 1
    sides = [_listed(windows, width, start, start if loci is None else last, F.lit(0), F.col("gene"))]
    sides += [_listed(reads, width, start - (most - 1), last, 2 + 2 * F.col("_sample") + F.col("_real"))]
    sides += [_listed(loci, width, start, last, F.lit(1))] if loci is not None else []
    rows = sides[0]
    for x in sides[1:]:
        rows = rows.unionByName(x)

    paired = loci is not None

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        low = key[1].as_py() * width
        of, start, end = (table.column(c).to_numpy() for c in ("_of", "start", "end"))
        start, end = start - low, end - low
        windows_at, loci_at, reads_at = (np.flatnonzero(x) for x in (of == 0, of == 1, of > 1))
        sample, real = of[reads_at] // 2 - 1, of[reads_at] % 2
        if not len(windows_at) or paired and not len(loci_at):
            return
        genes = table.column("gene").take(pa.array(windows_at)).combine_chunks().dictionary_encode()
        code = genes.indices.to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        code, ws, we = code[order], start[windows_at][order], end[windows_at][order]
        ps, pe = np.unique(np.stack([start[loci_at], end[loci_at]]), axis=1) if paired else (None, None)
        began, ended = (np.zeros((len(samples), 2, 2 * width + 1), np.int64) for _ in "se")
        for counts, at in ((began, start), (ended, end)):
            np.add.at(counts, (sample, 1 - real, np.clip(at[reads_at], 0, 2 * width)), 1)
            np.cumsum(counts, axis=2, out=counts)
        for g, s, e in _parts(code, ws, we, ps, pe, width):
            yield from told(key[0].as_py(), low, genes.dictionary, g, s, e, began, ended)

    def told(chrom, low, names, g, s, e, began, ended) -> Iterator[pa.RecordBatch]:
        length = (e - s).astype(np.float64)
        for product in sorted({p for p, _, _ in samples}):
            rates: dict[str, list[np.ndarray]] = {"real": [], "sim": [], "damage": []}
            own = [(i, t) for i, (p, *t) in enumerate(samples) if p == product]
            for i, totals in own:
                real, sim = ((began[i, kind, e - 1] - ended[i, kind, s]) * 1e9 / (length * t) if t else None for kind, t in enumerate(totals))
                if sim is not None:
                    rates["sim"].append(sim)
                if real is not None:
                    rates["real"].append(real)
                    rates["damage"].append(np.log2(real + 1e-3) - (np.log2(sim + 1e-3) if sim is not None else 0.0))
            absent = np.ones(len(g), bool)
            over = lambda name, f: pa.array(f(np.stack(rates[name]), axis=0)) if rates[name] else pa.array(np.zeros(len(g)), mask=absent)
            damage, real_mean, real_max = over("damage", np.mean), over("real", np.mean), over("real", np.max)
            if whole:
                cols = [names.take(pa.array(g)), pa.array([chrom] * len(g), pa.string()), pa.array(s + low), pa.array(e + low), np.full(len(g), product, np.int32), np.full(len(g), len(own)), real_mean, real_max, over("sim", np.mean), damage, over("damage", np.max)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=["gene", "chrom", "start", "end", "_product", "n_samples", "real_rpkm_mean", "real_rpkm_max", "sim_rpkm_mean", "damage_mean", "damage_max"])
                continue
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            per = lambda f, x: pa.array(f.reduceat(x.to_numpy(zero_copy_only=False), starts), mask=np.full(len(starts), x.null_count > 0))
            n = np.diff(np.r_[starts, len(g)])
            cols = [names.take(pa.array(g[starts])), pa.array(np.full(len(starts), product, np.int32)), pa.array(n), per(np.maximum, over("damage", np.max)), per(np.add, damage), per(np.maximum, real_max), per(np.add, real_mean)]
            yield pa.RecordBatch.from_arrays(cols, names=["gene", "_product", "n_loci", "damage_max", "damage_sum", "real_rpkm_max", "real_rpkm_sum"])

    return rows.groupBy("chrom", "_bin").applyInArrow(cell, LOCUS if whole else GENE)


def overlap_values(a: DataFrame, b: DataFrame, key: Sequence[str], longest: int) -> DataFrame:
    """Per row of ``a`` (the key, chrom, start, end) and cell: _sum, _max and _n of the ``_v`` of the rows of ``b`` that it overlaps, _rows, and bases shared (_bp).

    Rows are brought to the cells that they touch, at most two. A pair counts in the cell that holds the later of its starts: either
    b's row starts in the interval, or it reaches over the interval's first base. Both are read off binary trees over the cell's bases,
    which are as large however many rows of b there are.
    """
    width = max(VALUES, 1 << (longest - 1).bit_length())
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin")
    names = [f"_key_{i}" for i in range(len(key))]
    place = ["chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")]
    asked = a.select(*place, F.lit(True).alias("_asked"), F.lit(None).cast("double").alias("_v"), *(F.col(k).alias(n) for k, n in zip(key, names, strict=True)), bins)
    rows = asked.unionByName(b.select(*place, F.lit(False).alias("_asked"), F.col("_v").cast("double").alias("_v"), bins), allowMissingColumns=True)
    fields = [("_sum", "double"), ("_max", "double"), ("_n", "long"), ("_rows", "long"), ("_bp", "long")]
    schema = asked.select(*names).schema
    for name, kind in fields:
        schema = schema.add(name, kind)

    def cell(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = group[1].as_py() * width
        trees = [[np.zeros(2 * width), np.full(2 * width, -np.inf), np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64)] for _ in "ab"]
        begun, over = trees
        depth = np.zeros(width + 1, np.int64)
        windows, some = [], False
        for batch in batches:
            asks = batch.column("_asked")
            if asks.true_count:
                windows.append(batch.filter(asks))
            rest = batch.filter(pc.invert(asks))
            if not rest.num_rows:
                continue
            some, values = True, rest.column("_v")
            known = values.is_valid().to_numpy(zero_copy_only=False)
            start, end, v = rest.column("start").to_numpy() - low, rest.column("end").to_numpy() - low, values.fill_null(0.0).to_numpy(zero_copy_only=False)
            put = [v, np.where(known, v, -np.inf), known.astype(np.int64), np.ones(len(v), np.int64)]
            np.add.at(depth, np.maximum(start, 0), 1)
            np.add.at(depth, np.minimum(end, width), -1)
            own = start >= 0
            _put(begun, width + start[own], [x[own] for x in put])
            for at, where in _blocks(width + np.maximum(start + 1, 0), width + np.minimum(end, width)):
                _put(over, at, [x[where] for x in put])
        if not windows or not some:
            return
        size = width // 2
        while size:
            for f, x in zip(JOINS, begun, strict=True):
                x[size : 2 * size] = f(x[2 * size : 4 * size : 2], x[2 * size + 1 : 4 * size : 2])
            size //= 2
        size = 1
        while size < width:
            for f, x in zip(JOINS, over, strict=True):
                for odd in (0, 1):
                    x[2 * size + odd : 4 * size : 2] = f(x[2 * size + odd : 4 * size : 2], x[size : 2 * size])
            size *= 2
        covered = np.r_[0, np.cumsum(np.cumsum(depth[:width]))]
        for batch in windows:
            start, end = batch.column("start").to_numpy() - low, batch.column("end").to_numpy() - low
            first, last = np.maximum(start, 0), np.minimum(end, width)
            got = [np.where(start >= 0, x[width + first], none) for x, none in zip(over, (0.0, -np.inf, 0, 0), strict=True)]
            for at, where in _blocks(width + first, width + last):
                for k, (f, x) in enumerate(zip(JOINS, begun, strict=True)):
                    got[k][where] = f(got[k][where], x[at])
            bases = covered[last] - covered[first]
            told = np.flatnonzero((got[3] > 0) | (bases > 0))
            unknown = got[2][told] == 0
            cols = [batch.column(n).take(pa.array(told)) for n in names]
            cols += [pa.array(got[0][told], mask=unknown), pa.array(got[1][told], mask=unknown), *(pa.array(x[told]) for x in (got[2], got[3], bases))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *(n for n, _ in fields)])

    return rows.groupBy("chrom", "_bin").applyInArrow(cell, schema)


def profiles(points: DataFrame, track: DataFrame, flank: int, step: int, by: str, key: str) -> DataFrame:
    """What each cell adds to the profiles of groups: rows with the group, a bin and its sum of signal, and rows with the group and the key of a point with signal.

    Points (chrom, pos, strand) and rows of the track are brought to the cells that they touch; a bin over a border has a part in each.
    A cell's running totals are arrays, so a point's bins are looked up and added up there and are no rows.
    """
    n_bins, width = 2 * flank // step, WIDE
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor((high - 1) / width))).alias("_bin")
    first = F.col("pos") - flank
    asked = points.where("chrom is not null").select("chrom", F.col(by), F.col(key), F.coalesce(F.col("strand") == "-", F.lit(False)).alias("_back"), F.lit(True).alias("_asked"), first.cast("long").alias("start"), bins(first, first + n_bins * step))
    live = track.where(F.col("chrom").isNotNull() & (F.col("start") < F.col("end")) & (F.col("value") != 0))
    rows = asked.unionByName(live.select("chrom", F.lit(False).alias("_asked"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("double").alias("_v"), bins(F.col("start"), F.col("end"))), allowMissingColumns=True)
    schema = StructType([StructField(f.name, f.dataType) for f in asked.select(by, key).schema]).add("bin", "long").add("_s", "double")
    at = np.arange(n_bins + 1) * step

    def cell(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = group[1].as_py() * width
        value, depth, asks = np.zeros(width + 1), np.zeros(width + 1, np.int64), []
        for batch in batches:
            mine = batch.column("_asked")
            if mine.true_count:
                asks.append(batch.filter(mine).select([by, key, "_back", "start"]))
            rest = batch.filter(pc.invert(mine))
            for end, sign in (("start", 1), ("end", -1)):
                where = np.clip(rest.column(end).to_numpy() - low, 0, width)
                np.add.at(value, where, sign * rest.column("_v").to_numpy())
                np.add.at(depth, where, sign)
        covered = np.cumsum(depth[:width]) > 0
        total, bases = (np.r_[0, np.cumsum(x)] for x in (np.where(covered, np.cumsum(value[:width]), 0.0), covered))
        for batch in asks:
            edges = np.clip(batch.column("start").to_numpy()[:, None] - low + at, 0, width)
            some = np.flatnonzero(bases[edges[:, -1]] > bases[edges[:, 0]])
            if not len(some):
                continue
            told = batch.take(pa.array(some))
            signal = np.diff(total[edges[some]], axis=1)
            back = told.column("_back").to_numpy(zero_copy_only=False)
            signal[back] = signal[back, ::-1]
            groups = told.column(by).dictionary_encode(null_encoding="encode")
            code = groups.indices.to_numpy()
            yield pa.RecordBatch.from_arrays([told.column(by), told.column(key), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.float64())], names=schema.names)
            for k in range(len(groups.dictionary)):
                yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array([k] * n_bins)), pa.nulls(n_bins, told.column(key).type), pa.array(np.arange(n_bins)), pa.array(signal[code == k].sum(axis=0) / step)], names=schema.names)

    return rows.groupBy("chrom", "_bin").applyInArrow(cell, schema)


#: How sums, maxima and both counts of two blocks go together.
JOINS = (np.add, np.maximum, np.add, np.add)


def _put(tree: Sequence[np.ndarray], at: np.ndarray, values: Sequence[np.ndarray]) -> None:
    for f, x, v in zip(JOINS, tree, values, strict=True):
        f.at(x, at, v)


def _blocks(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nodes of a binary tree that make up the leaves [low, high) of each row: (nodes, rows), level by level."""
    where = np.flatnonzero(low < high)
    low, high = low[where], high[where]
    while len(where):
        odd = low & 1 == 1
        yield low[odd], where[odd]
        odd_high = high & 1 == 1
        yield high[odd_high] - 1, where[odd_high]
        low, high = (low + 1) >> 1, high >> 1
        live = low < high
        low, high, where = low[live], high[live], where[live]
