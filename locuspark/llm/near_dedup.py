"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A text is the bag of its five-word shingles. A signature component is the earliest point
of Poisson processes in (weight, time): for each shingle, the weight axis is cut into
octaves [0,1), [1,2), [2,4), ...; each octave has one process of a rate equal to its width,
seeded by shingle and octave, so a shingle of weight w needs O(log w) processes. Points of
the top octave carry a level and count only if it is below w. Two texts agree in a component
with a probability equal to their weighted Jaccard similarity.

Texts with equal bags are one node. Of each bucket (nodes that share a band) the best
connected node is the hub; buckets with one hub are a group. Every node of a group is compared
with the hub, exactly: that gives links, and what each text has more and less than the hub.
Only groups whose nodes are still in different classes go on, see ``group_pairs``: pairs
whose differences from a common middle leave room for the wanted similarity are compared
exactly. No link between two nodes of a bucket is lost, and no group is paired out.

``class_id`` is the smallest doc_id of the class that has no other text; of a class
without such an id it is a negative number made from the texts' hash.

Defined results: a text without words (null, empty) is a class of its own; one of under five
words has one shingle of all its words; rows with a null doc_id get a null class; repeated
rows get a row each; a doc_id may occur with several texts, which stay apart; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bag, mix, packed, shingles, slices, staged, words

SIMILARITY = 0.8
BANDS, ROWS = 20, 5
M = BANDS * ROWS
#: Texts that are compared with one copy of their hub's text.
CHUNK = 256
#: A difference from the hub that this share of a group has goes last in the order of tokens.
OFTEN = 1 / 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = np.int64

Batches = Iterator[pa.RecordBatch]


def _processes(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element index, seed, octave width and lowest level of each process that a bag needs."""
    index, seed, width, lowest = [], [], [], []
    octave, low = 0, 0
    live = np.arange(len(h))
    while len(live):
        size = 1 if octave == 0 else 1 << (octave - 1)
        index.append(live)
        seed.append(mix(h[live] + np.uint64((octave + 1) * int(_GOLD) % (1 << 64))))
        width.append(np.full(len(live), size, np.float64))
        lowest.append(np.full(len(live), low, np.int64))
        octave, low = octave + 1, low + size
        live = live[weight[live] > low]
    return tuple(np.concatenate(x) for x in (index, seed, width, lowest)) if index else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64))


def bag_minhash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, m: int = M) -> np.ndarray:
    """Signatures (n_rows x m times of first points); infinite for rows without elements."""
    first = np.full(n_rows * m, np.inf)
    element, seed, width, lowest = _processes(h, weight)
    doc, time = row[element], np.zeros(len(element))
    above = weight[element]
    k = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(doc):
            k += np.uint64(1)
            u = mix(seed + k * _GOLD)
            v = mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width * m)
            level = lowest + ((v & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
            part = ((v >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            inside = level < above
            np.minimum.at(first, doc[inside] * m + part[inside].astype(np.int64), time[inside])
            go = time < first.reshape(n_rows, m).max(axis=1)[doc]
            doc, seed, time, width, lowest, above = (x[go] for x in (doc, seed, time, width, lowest, above))
    return first.reshape(n_rows, m)


def _mixed_sum(row: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
    out = np.zeros(n_rows, np.uint64)
    np.add.at(out, row, x)
    return out


def signatures(batches: Batches) -> Batches:
    """doc_id, text_hash, text in; doc_id, text_hash, n_shingles, bag (two longs), bands out."""
    for batch in batches:
        for low, high in slices(batch.column(2), 2 << 20):
            n = high - low
            row, _, _, h = words(batch.column(2).slice(low, n))
            r, x, w = bag(*shingles(row, h))
            sig = bag_minhash(r, x, w, n).view(np.uint64).reshape(n, BANDS, ROWS)
            key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _GOLD, n, axis=0)
            for k in range(ROWS):
                key = mix(key ^ sig[:, :, k]) + _GOLD
            item = mix(x ^ mix(w.astype(np.uint64) * _GOLD))
            count = np.bincount(r, weights=w, minlength=n).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(key.reshape(-1).view(_SIGNED)))
            bags = [pa.array(_mixed_sum(r, y, n).view(_SIGNED)) for y in (item, mix(item + _GOLD))]
            same = [batch.column(k).slice(low, n) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(count), *bags, bands], names=["doc_id", "text_hash", "n_shingles", "bag_a", "bag_b", "bands"])


def _bag_tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and token, sorted; the n-th occurrence of a shingle is a token of its own, so bags are sets."""
    row, _, _, h = words(text)
    r, x, w = bag(*shingles(row, h))
    nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) if len(w) else np.zeros(0, np.int64)
    r, x = np.repeat(r, w), mix(np.repeat(x, w) + nth.astype(np.uint64) * _GOLD).view(_SIGNED)
    order = np.lexsort((x, r))
    return r[order], x[order]


def differences(batches: Batches) -> Batches:
    """hub, salt, node, text in, a hub's own text (node is null) before those of its nodes; ``_COMPARED`` out."""
    last = np.zeros(0, np.int64)
    for batch in batches:
        for low, high in slices(batch.column(3)):
            part, n = batch.slice(low, high - low), high - low
            hub, node = part.column(0).to_pylist(), part.column(2).to_pylist()
            r, x = _bag_tokens(part.column(3))
            at, out = np.searchsorted(r, np.arange(n + 1)), []
            for k in range(n):
                own = x[at[k] : at[k + 1]]
                if node[k] is None:
                    last = own
                    continue
                place = np.minimum(np.searchsorted(last, own), max(len(last) - 1, 0))
                same = last[place] == own if len(last) else np.zeros(len(own), bool)
                both = int(same.sum())
                total = len(last) + len(own) - both
                out.append((hub[k], node[k], len(last), len(own), both / total if total else 0.0, own[~same], np.delete(last, place[same])))
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["hub", "node", "n_hub", "n", "similarity", "more", "less"])


_COMPARED = "hub long, node long, n_hub long, n long, similarity double, more array<long>, less array<long>"


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``_COMPARED`` for the pairs (hub, node): sizes of both bags, similarity, tokens that only the node or only the hub has.

    Each hub's text goes once to every ``CHUNK`` of its nodes, and nodes are dealt to chunks by hash.
    """
    chunks = pairs.groupBy("hub").agg(F.floor(F.count("*") / CHUNK).alias("chunks"))
    dealt = attach(pairs, chunks, ["hub"], ["node"]).select("hub", F.pmod(F.xxhash64("node"), F.col("chunks") + 1).alias("salt"), "node")
    hubs = chunks.join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), "chunks")).alias("salt"), F.lit(None).cast("long").alias("node"), "text")
    both = hubs.union(dealt.join(texts, "node").select("hub", "salt", "node", "text"))
    return both.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node").asc_nulls_first()).mapInArrow(differences, _COMPARED)


def components(edges: DataFrame) -> DataFrame:
    """node, label of all nodes of the edges (a, b); label is the smallest node of the component.

    Labels go along edges and then to the label's own label until none changes; every round
    is a few joins and a written table.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("low"))
        moved = staged(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label")), "labels")
        up = moved.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = staged(moved.join(up, "label", "left").select("node", "old", F.least("label", "top").alias("label")), "labels")
        if jumped.where("old <> label").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def group_pairs(members: DataFrame, labels: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Sure links and pairs still to compare (a, b) of the groups whose nodes are in different classes.

    Let K be any set of tokens, ``extra`` and ``gone`` a node's tokens outside K and those of K
    that it lacks, d their number, n the node's size and c = (1 - s) / (1 + s). Nodes x and y
    are similar if d(x) + d(y) - 2 * shared differences <= c * (n(x) + n(y)). With
    v = d - c * n, that is: shared differences >= (v(x) + v(y)) / 2.

    So where v(x) + v(y) <= 0 both are surely linked, also to the node of the smallest v: those
    are the group's core and need no comparison. All other pairs must share a difference,
    hence one in the prefixes of both, in an order that all nodes of the group keep: the rare
    extra tokens first. If they share no extra token, 2 * gone >= v(x) + v(y) holds
    for both, which leaves out most nodes. K is the hub with what most of the group has
    changed. It is chosen for speed only and no result depends on it.
    """
    c = (1 - similarity) / (1 + similarity)
    label = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = label.groupBy("hub").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("size")).where("l <> h").select("hub", "size")
    rows = staged(attach(label, mixed, ["hub"], ["node"]), "open")
    sides = [F.arrays_zip(F.col(k).alias("token"), F.array_repeat(F.lit(e), F.size(k)).alias("outside")) for k, e in (("more", True), ("less", False))]
    changed = rows.select("hub", "size", F.explode(F.concat(*sides)).alias("x"))
    counts = changed.groupBy("hub", "x.token", "x.outside").agg(F.count("*").alias("n"), F.first("size").alias("size")).where((F.col("n") > 1) & (F.col("n") >= F.col("size") * OFTEN))
    most = F.struct("n", "token")

    def listed(which: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(which, most))), lambda x: x["token"])

    flip = 2 * F.col("n") > F.col("size")
    middle = counts.groupBy("hub").agg(listed(F.lit(True)).alias("often"), listed(flip & F.col("outside")).alias("put"), listed(flip & ~F.col("outside")).alias("cut"))
    none = F.array().cast("array<bigint>")
    placed = attach(rows, middle, ["hub"], ["node"], how="left").withColumns({k: F.coalesce(k, none) for k in ("often", "put", "cut")})
    placed = placed.withColumns({"extra": F.concat(F.array_except("more", "put"), F.array_except("cut", "less")), "gone": F.concat(F.array_except("less", "cut"), F.array_except("put", "more"))})
    ordered = {k: F.concat(F.sort_array(F.array_except(k, "often")), F.array_intersect("often", k)) for k in ("extra", "gone")}
    placed = placed.select("hub", "node", "label", "n", *(x.alias(k) for k, x in ordered.items()))
    placed = staged(placed.withColumn("d", F.size("extra") + F.size("gone")).withColumn("v", F.col("d") - c * F.col("n")).withColumn("u", 2 * F.size("gone") - F.col("v")), "placed")

    lowest = placed.groupBy("hub").agg(F.min(F.struct("v", "node", "label")).alias("x")).select("hub", F.col("x.v").alias("v0"), F.col("x.node").alias("first"), F.col("x.label").alias("label0"))
    near = attach(placed, lowest, ["hub"], ["node"]).withColumn("core", F.col("v") + F.col("v0") <= 1e-9).withColumn("label", F.when(F.col("core"), F.col("label0")).otherwise(F.col("label")))
    near = staged(near, "core")
    sure = near.where("core and node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    limits = near.groupBy("hub").agg(F.min(F.when(F.col("label") != F.col("label0"), F.col("v"))).alias("v_out"), F.max("u").alias("u_max"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("hub", "v_out", "u_max")
    left = attach(near, limits, ["hub"], ["node"])
    least = F.greatest(F.lit(1.0), F.ceil((F.col("v") + F.when(F.col("core"), F.col("v_out")).otherwise(F.col("v0"))) / 2 - 1e-9), F.ceil(F.col("v") - c / similarity * F.col("n") - 1e-9))
    ways = F.when(F.col("core"), F.col("u") >= F.col("v_out") - 1e-9).otherwise(F.col("v") <= F.col("u_max") + 1e-9)
    whole = F.when(ways, F.concat("extra", "gone")).otherwise(F.col("extra"))
    prefix = F.slice(whole, F.lit(1), F.greatest(F.lit(0), F.col("d") - least + 1).cast("int"))
    tokens = left.select("hub", "node", "label", "n", "d", "v", F.posexplode(prefix).alias("place", "token"))
    tokens = staged(tokens, "prefixes")
    useful = tokens.groupBy("hub", "token").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("hub", "token")
    tokens = tokens.join(useful.hint("merge"), ["hub", "token"], "left_semi")  # one row per token of a prefix: a file's size says too little to broadcast by
    a, b = (tokens.select("hub", "token", *(F.col(x).alias(f"{x}_{k}") for x in ("node", "label", "n", "d", "v", "place"))) for k in "ab")
    shared = F.least(F.col("d_a") - F.col("place_a"), F.col("d_b") - F.col("place_b"))
    close = (F.col("label_a") < F.col("label_b")) & (2 * shared >= F.col("v_a") + F.col("v_b") - 1e-9) & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    pairs = a.join(b.hint("merge"), ["hub", "token"]).where(close)
    return sure, pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _made_up(x: Column) -> Column:
    """A negative number."""
    return -1 - F.pmod(x, F.lit(1 << 62))


def labelled(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, class_id, n_shingles for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    sig = staged(docs.mapInArrow(signatures, "doc_id long, text_hash long, n_shingles long, bag_a long, bag_b long, bands array<long>"), "signatures")
    bags = [F.when(F.col("n_shingles") > 0, F.col(k)).otherwise(F.lit(0)) for k in ("bag_a", "bag_b")]
    several = sig.where("doc_id is not null").groupBy("doc_id").agg(*(f(x).alias(f"{n}{k}") for k, x in enumerate(bags) for n, f in (("l", F.min), ("h", F.max)))).where("l0 <> h0 or l1 <> h1")
    several = staged(several.select("doc_id", F.lit(True).alias("several")), "ids")
    rows = sig.join(several, "doc_id", "left").withColumn("own_id", F.when(F.col("several").isNull(), F.col("doc_id")))
    known = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = known.groupBy("bag_a", "bag_b").agg(F.min("own_id").alias("own_id"), F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("bands").alias("bands"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    buckets = staged(attach(bands, sizes, ["band"], ["node"]), "buckets")
    degree = buckets.groupBy("node").agg(F.sum("size").alias("degree"))
    best = buckets.join(degree, "node").groupBy("band").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    groups = staged(attach(buckets, best, ["band"], ["node"]).select("hub", "node").distinct(), "groups")
    at = nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", "at.doc_id", "at.text_hash")
    texts = staged(attach(docs.where("doc_id is not null").withColumn("uid", F.monotonically_increasing_id()), at, ["doc_id", "text_hash"], ["uid"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    stars = staged(compared(groups.where("hub <> node"), texts), "stars")
    links = stars.where(F.col("similarity") >= similarity).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    labels = components(links)
    none = F.array().cast("array<bigint>")
    hubs = stars.groupBy("hub").agg(F.first("n_hub").alias("n")).select("hub", F.col("hub").alias("node"), "n", none.alias("more"), none.alias("less"))
    sure, pairs = group_pairs(hubs.union(stars.select("hub", "node", "n", "more", "less")), labels, similarity)
    found = compared(pairs.toDF("hub", "node"), texts).where(F.col("similarity") >= similarity).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    more = sure.union(found)
    for k in "ab":  # links between classes
        more = more.join(labels.select(F.col("node").alias(k), "label"), k, "left").withColumn(k, F.coalesce("label", k)).drop("label")
    last = components(more.where("a <> b"))

    named = nodes.select("bag_a", "bag_b", "node", "own_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(last.toDF("label", "top"), "label", "left").withColumn("label", F.coalesce("top", "label")).select("bag_a", "bag_b", "own_id", "label")
    named = staged(named, "named")
    ids = named.groupBy("label").agg(F.coalesce(F.min("own_id"), _made_up(F.min("bag_a"))).alias("class_id"))
    classes = attach(named, ids, ["label"], ["bag_a"]).select("bag_a", "bag_b", "class_id")
    out = attach(rows.select("doc_id", "own_id", "text_hash", "n_shingles", "bag_a", "bag_b").withColumn("uid", F.monotonically_increasing_id()), staged(classes, "classes"), ["bag_a", "bag_b"], ["uid"], how="left")
    alone = F.when(F.col("n_shingles") == 0, F.coalesce("own_id", _made_up(F.xxhash64("doc_id")))).otherwise(F.col("class_id"))
    return out.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), alone).alias("class_id"), "n_shingles")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_shingles for every row of ``docs``."""
    return labelled(docs, similarity).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of the smallest doc_id; rows without an id stay."""
    firsts = labelled(docs, similarity).where("doc_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    firsts = staged(firsts.select(F.col("x.doc_id").alias("key_id"), F.col("x.text_hash").alias("key_hash")), "firsts")
    rows = packed(docs)
    kept = rows.where("key_id is not null").join(firsts, ["key_id", "key_hash"], "left_semi").groupBy("key_id", "key_hash").agg(F.first("doc").alias("doc"))
    return kept.select("doc").union(rows.where("key_id is null").select("doc")).select("doc.*")
