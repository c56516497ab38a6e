"""SimHash near-duplicates, found with BK-trees.

Equal fingerprints are one node.  Two nodes are linked if they differ in at most ``radius`` = 3 bits.  The 64 bits are cut
into five blocks; at most three of them can hold a differing bit, so linked nodes agree on two blocks at least, and each
of the ten choices of two blocks is a table that routes a node to a shard by their values.  A shard that holds one node has
no link.  The nodes of every other shard form a BK-tree: a child hangs from its parent by their Hamming distance, and a search
that met a node at distance d follows only the edges from d - 3 to d + 3.

Trees of many small shards are built and searched together, level by level, in NumPy.  A shard of more than ``tree_nodes`` nodes is
routed once more: of four parts of the bits that its blocks leave open at least one agrees.  What is still larger is split: each part of
about ``tree_nodes`` nodes is one tree, and it meets the shard's nodes a chunk of them at a time, so that no group grows with the shard.
From each tree only a spanning forest of the links leaves, never all pairs.

Components come from alternating large-star and small-star steps over these links, each step written to the shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of, staged

#: Widths of the five blocks.
BLOCKS = (13, 13, 13, 13, 12)
#: Nodes of a tree; nodes of one group of shards that a task handles at a time.
TREE_NODES, GROUP_NODES = 2_048, 8_192

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included.

    ASCII capitals are lowered.  Words are runs of anything but ASCII white space; shingles are ``width`` words joined by
    spaces, the whole sequence if there are fewer.  No words (null, empty): zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -width] + 1).tolist()]
    shingles = map(line.__getitem__, map(slice, starts, ends[width - 1 :].tolist()))
    n = len(starts)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(seed, n)), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """Of each bit, whether it is set in over half of the hashes; zero for none."""
    # how often each value of each byte comes, then how often each bit
    seen = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel() * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp), fp as a signed long.  Repeated rows give repeated rows; only doc_id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t, width, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """BK-trees over the values of each shard.  The nodes of a tree are its values; all levels of all trees are built side by side."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value
        self.root: dict[int, int] = {}
        parents, edges, nodes = [], [], []
        rest, above, edge = np.arange(n), shard.astype(np.int64), np.zeros(n, np.int64)
        top = True
        while len(rest):
            order = np.lexsort((rest, edge, above))
            rest, above, edge = rest[order], above[order], edge[order]
            new = np.ones(len(rest), bool)
            new[1:] = (above[1:] != above[:-1]) | (edge[1:] != edge[:-1])
            heads = rest[new]
            if top:
                self.root = dict(zip(above[new].tolist(), heads.tolist(), strict=True))
            else:
                parents.append(above[new])
                edges.append(edge[new])
                nodes.append(heads)
            top = False
            above = heads[np.cumsum(new) - 1][~new]
            rest = rest[~new]
            edge = np.bitwise_count(value[rest] ^ value[above]).astype(np.int64)
        empty = np.zeros(0, np.int64)
        keys = np.concatenate(parents or [empty]) * 128 + np.concatenate(edges or [empty])
        order = np.argsort(keys, kind="stable")
        self.key, self.child = keys[order], np.concatenate(nodes or [empty])[order]

    def search(self, value: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs within the radius, for queries that start at ``root``."""
        query, node = np.arange(len(value)), root
        found_q, found_n = [], []
        while len(query):
            d = np.bitwise_count(value[query] ^ self.value[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(query[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.key, node * 128 + d + radius, "right")
            count = high - low
            query = np.repeat(query, count)
            node = self.child[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(query))]
        return np.concatenate(found_q or [query]), np.concatenate(found_n or [query])


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its set) after joining the sets of a and b."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (short := label[label])).any():
            label = short
    return label


def _spanning(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links that span what is connected within each shard of a group: (a, b), b the representative."""
    tree = pdf["in_tree"].to_numpy(bool)
    shard, value = pdf["shard"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
    # trees come first, so that nodes of trees are indexes into the whole
    order = np.argsort(~tree, kind="stable")
    shard, value = shard[order], value[order]
    n = int(tree.sum())
    forest = Forest(shard[:n], value[:n])
    label = np.arange(len(value))
    start = np.array([forest.root.get(s, -1) for s in shard.tolist()], np.int64)
    asks = np.flatnonzero(start >= 0)
    for a in range(0, len(asks), 1024):
        q = asks[a : a + 1024]
        i, node = forest.search(value[q], start[q], radius)
        i = q[i]
        other = i != node
        label = _join(label, i[other], node[other])
    linked = np.flatnonzero(label != np.arange(len(label)))
    out = pd.DataFrame({"a": value[linked].view(np.int64), "b": value[label[linked]].view(np.int64)})
    return out[out["a"] != out["b"]].drop_duplicates()


def _bits_of(parts: list[tuple[int, int]]) -> Column:
    """Bits (from, how many) of ``fp``, one after the other, as a number."""
    out, at = F.lit(0).cast("long"), 0
    for low, width in parts:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long")), at))
        at += width
    return out


def _tables() -> list[tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]]:
    """Of each choice of two blocks: their bits, and the bits of the other three in four parts."""
    places = [(sum(BLOCKS[:i]), w) for i, w in enumerate(BLOCKS)]
    out = []
    for two in itertools.combinations(range(len(BLOCKS)), 2):
        rest = [low + k for i, (low, w) in enumerate(places) if i not in two for k in range(w)]
        cuts = [rest[len(rest) * k // 4 : len(rest) * (k + 1) // 4] for k in range(4)]
        out.append(([places[i] for i in two], [_stretches(part) for part in cuts]))
    return out


def _stretches(bits: list[int]) -> list[tuple[int, int]]:
    """Ascending bits as (from, how many)."""
    out: list[tuple[int, int]] = []
    for b in bits:
        if out and sum(out[-1]) == b:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((b, 1))
    return out


def _sized(keyed: DataFrame, label: str) -> DataFrame:
    """(fp, key, table, m): rows of ``keyed`` whose key comes more than once, and how often."""
    sizes = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), f"{label}-sizes")
    return staged(keyed.join(sizes, "key").select("fp", "key", "table", "m"), label)


def links(nodes: DataFrame, radius: int = 3, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b): links among distinct ``fp`` values that connect exactly what links within the radius connect."""
    if radius > 3:
        raise ValueError("five blocks with two in common are exact up to 3 differing bits")
    tables = _tables()
    routes = F.array(*[F.struct(F.lit(t).alias("table"), _bits_of(two).alias("values")) for t, (two, _) in enumerate(tables)])
    keyed = nodes.select("fp", F.explode(routes).alias("k")).select("fp", "k.table", F.shiftleft("k.values", 4).bitwiseOR(F.col("k.table").cast("long")).alias("key"))
    shared = _sized(keyed, "simhash-shared")
    # three bits at most lie in the open part of a shard, so one of its four parts is free of them
    large = shared.filter(F.col("m") > tree_nodes)
    cut = F.array(*[F.array(*[F.xxhash64(F.lit(k), _bits_of(part)) for k, part in enumerate(parts)]) for _, parts in tables])
    again = large.select("fp", "table", "key", F.explode(F.element_at(cut, F.col("table") + 1)).alias("part")).select("fp", "table", F.xxhash64("key", "part").alias("key"))
    finer = _sized(again, "simhash-finer")
    grouped = shared.filter(F.col("m") <= tree_nodes).unionByName(finer)
    # a node goes into one tree of its shard, and to each of its trees in one chunk
    parts = F.ceil(F.col("m") / F.lit(tree_nodes)).cast("int")
    split = grouped.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(F.lit(9), "fp"), F.col("parts"))).withColumn("chunk", F.pmod(F.xxhash64(F.lit(10), "fp"), F.col("parts")))
    asks = split.filter("parts > 1").select("fp", "key", F.lit(False).alias("in_tree"), "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("tree"))
    held = split.filter("parts > 1").select("fp", "key", F.lit(True).alias("in_tree"), F.col("own").alias("tree"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("chunk"))
    one = split.filter("parts = 1").select("fp", "key", F.lit(True).alias("in_tree"), "chunk", F.col("own").alias("tree"))
    sent = one.unionByName(asks).unionByName(held).select("fp", "in_tree", F.xxhash64("key", "tree", "chunk").alias("shard"))
    total = split.agg(F.sum(F.when(F.col("parts") > 1, 2 * F.col("parts")).otherwise(1).cast("long"))).first()[0] or 0
    grouped = sent.withColumn("group", F.pmod(F.col("shard"), F.lit(total // GROUP_NODES + 1)))
    return grouped.groupBy("group").applyInPandas(lambda pdf: _spanning(pdf, radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches; nodes that are their own root are left out.

    Large-star and small-star steps in turn until nothing changes; hubs are handled by partial aggregation and by joins whose
    skewed partitions Spark splits.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components")
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "components")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        then = staged(small, "components")
        mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark(then) == mark(now):
            return then.toDF("node", "root")
        now = then


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the SimHash of every document and the smallest doc_id that links reach from it.

    Texts without words share fingerprint zero and are linked like any others.  A repeated doc_id gives a row each time; a null
    doc_id is kept and never a component's id, unless the component has no other.
    """
    marked = staged(fingerprints(docs, width, seed), "simhash")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes, radius))
    labelled = staged(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-labels")
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = labelled.join(lowest, "root").select("fp", "component_id")
    return marked.join(of_node, "fp").select("doc_id", "fp", "component_id")
