"""Near copies: SimHash fingerprints in BK-trees propose pairs, exact Jaccard similarity of word shingles confirms them.

At a similarity of 0.8 fingerprints of five-word shingles differ in about 10 bits of 64, far too many for shards made of a few
blocks of bits.  So a text's shards come from the shingles themselves: 20 keys, each of 5 minima of seeded hashes.  Two texts of similarity s share one with probability
1 - (1 - s**5)**20: 99.96% at 0.8, 99.9999% at 0.9.  A shard is a BK-tree, searched within RADIUS bits, which a pair of 0.8 exceeds once in
some hundred thousand times.  Different texts are nodes.

Of a small shard all pairs within the radius are confirmed or not.  Large ones (a text copied thousands of times with small changes) overlap, since
such texts share most of their keys: large shards that have a node in common are one family, and a family is searched once.  Its shingle sets go to the
task with its tree, and only links that span what is connected come out, never all pairs.  A family that is too large for a task is cut into parts by
nodes and bytes, and each two parts meet in a task of their own, so no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of, staged
from tidemark.llm.simhash import GROUP_NODES, Forest, components, majority
from tidemark.llm.substrings import Words, _mixed

KEYS, ROWS = 20, 5
#: Bits in which fingerprints of a proposed pair may differ.
RADIUS = 24
#: Nodes of a shard whose pairs are all looked at; nodes and bytes of shingles of a part of a family.
SMALL, PART, PART_BYTES = 16, 4_096, 16 << 20

_SEEDED = np.random.default_rng(31)
_SALT, _ODD = (_SEEDED.integers(0, 1 << 63, KEYS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and how many each has: the whole sequence if it is shorter, none without words.  ASCII capitals are lowered."""
    words = Words(pa.array([(t or b"").lower() for t in texts.cast(pa.binary()).to_pylist()], pa.binary()))
    n_words = np.diff(words.first)
    n = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    at = np.repeat(words.first[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return words.hashes(at, np.repeat(np.minimum(n_words, width), n)), n


def _routed(texts: DataFrame, width: int) -> DataFrame:
    """(node, fp, keys) of each row of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1 << 20):
            h, n = shingle_hashes(batch.column(1), width)
            some = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[some]
            out = np.zeros((batch.num_rows, KEYS), np.uint64)  # texts without words are a group
            for key in range(KEYS if len(some) else 0):
                of = np.full(len(some), key + 1, np.uint64)
                for k in range(key * ROWS, (key + 1) * ROWS):
                    of = _mixed(of ^ np.minimum.reduceat((h ^ _SALT[k]) * _ODD[k], begin))
                out[some, key] = of
            fp = np.fromiter((majority(x) for x in np.split(h, np.cumsum(n)[:-1])), np.uint64, batch.num_rows)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel().view(np.int64)), KEYS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), lists], ["node", "fp", "keys"])

    return texts.select("node", "text").mapInArrow(run, "node long, fp long, keys array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the different shingles of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1 << 20):
            h, n = shingle_hashes(batch.column(1), width)
            sets = [np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _of_trees(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """(a, b): all pairs within the radius of each shard of a group."""
    node, shard, fp = (pdf[c].to_numpy(np.int64) for c in ("node", "key", "fp"))
    forest = Forest(shard, fp.view(np.uint64))
    start = np.array([forest.root[s] for s in shard.tolist()], np.int64)
    a, b = [], []
    for at in range(0, len(node), 1024):
        i, other = forest.search(fp[at : at + 1024].view(np.uint64), start[at : at + 1024], radius)
        a.append(node[at + i])
        b.append(node[other])
    a, b = np.concatenate(a), np.concatenate(b)
    out = pd.DataFrame({"a": a[a < b], "b": b[a < b]})
    return out.drop_duplicates()


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) with a similarity of ``least`` or more; two texts without words are equal."""
    first = pairs.join(sets.toDF("a", "of_a"), "a")
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return staged(first.join(sets.toDF("b", "of_b"), "b").filter((either == 0) | (both >= F.lit(least) * either)).select("a", "b"), "near-links")


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set a row of bits, one bit a shingle (or several); there are 16 bits to each shingle of a set of middle size."""
    sizes = [len(x) for x in sets]
    words = 1 << max(3, int(np.median(sizes) * 16 / 64).bit_length())
    out = np.zeros((len(sets), words), np.uint64)
    if sum(sizes):
        at = _mixed(np.concatenate(sets).view(np.uint64)) % np.uint64(64 * words)
        row = np.repeat(np.arange(len(sets)), sizes)
        np.bitwise_or.at(out, (row, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out


def spanning(node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], in_tree: np.ndarray, least: float, radius: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect what all links of ``least`` or more between the tree's nodes and all connect; ``sets`` are sorted and without repeats.

    A pair is looked at only while it is not connected.  Bits of one sketch that the other lacks are shingles that the other lacks, which bounds the similarity
    from above; what the bound lets through is compared exactly.
    """
    order = np.argsort(~in_tree, kind="stable")
    node, fp, sets = node[order], fp[order], [sets[i] for i in order]
    n = int(in_tree.sum())
    forest = Forest(np.zeros(n, np.int64), fp[:n])
    size, sketch, found = np.array([len(x) for x in sets], np.int64), _sketches(sets), []
    root = list(range(len(node)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, len(node), 64):
        asks = np.arange(a, min(a + 64, len(node)))
        i, j = forest.search(fp[asks], np.full(len(asks), forest.root[0], np.int64), radius)
        i = asks[i]
        label = np.array([top(x) for x in range(len(node))])
        keep = (label[i] != label[j]) & ((j < i) | ~(i < n))
        i, j = i[keep], j[keep]
        # |a and b| >= least * |a or b| holds if and only if |a and b| * (1 + least) >= least * (|a| + |b|)
        both = np.minimum(size[i], size[j]) * (1 + least) >= least * (size[i] + size[j]) - 1e-9
        i, j = i[both], j[both]
        for b in range(0, len(i), 4096):
            x, y = i[b : b + 4096], j[b : b + 4096]
            lacks = np.bitwise_count(sketch[x] & ~sketch[y]).sum(1, dtype=np.int64), np.bitwise_count(sketch[y] & ~sketch[x]).sum(1, dtype=np.int64)
            most = np.minimum(size[x] - lacks[0], size[y] - lacks[1])
            may = most * (1 + least) >= least * (size[x] + size[y]) - 1e-9
            x, y, most = x[may], y[may], most[may]
            for k in np.argsort(-most, kind="stable").tolist():
                one, other = int(x[k]), int(y[k])
                if (r := top(one)) == (s := top(other)):
                    continue
                common = len(np.intersect1d(sets[one], sets[other], assume_unique=True))
                either = len(sets[one]) + len(sets[other]) - common
                if not either or common >= least * either:
                    root[max(r, s)] = min(r, s)
                    found.append((int(node[one]), int(node[other])))
    return found


def _families(large: DataFrame, sets: DataFrame, least: float, radius: int) -> DataFrame:
    """Links that span what is connected in large shards, from their (node, fp, lowest), ``lowest`` being a shard's lowest node."""
    roots = components(large.select(F.col("node").alias("a"), F.col("lowest").alias("b")))
    members = large.select("node", "fp").distinct().join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    held = staged(members.select("node", "fp", F.coalesce("root", "node").alias("family")).join(sets, "node"), "near-families")
    sizes = held.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum(8 * F.size("shingles")) / PART_BYTES)).cast("int").alias("parts"))
    own = held.join(staged(sizes, "near-parts"), "family").withColumn("part", F.pmod(F.xxhash64(F.lit(13), "node"), F.col("parts")).cast("int"))
    # a part meets itself and every other: the lower of two is the tree
    met = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = met.select("family", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), (F.col("part") <= F.col("with")).alias("in_tree"), "node", "fp", "shingles")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column = lambda c: rows[c].chunk(0).to_numpy(zero_copy_only=False)
        lists = rows["shingles"].chunk(0)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        # ordered as unsigned numbers, but any one order will do
        sets_ = [np.sort(x) for x in np.split(lists.flatten().to_numpy(zero_copy_only=False), ends)]
        links_ = spanning(column("node"), column("fp").view(np.uint64), sets_, column("in_tree").astype(bool), least, radius)
        return pa.table({"a": pa.array([x for x, _ in links_], pa.int64()), "b": pa.array([x for _, x in links_], pa.int64())})

    return staged(sent.groupBy("family", "low", "high").applyInArrow(run, "a long, b long"), "near-spanning")


def links(texts: DataFrame, width: int = 5, least: float = 0.8, small: int = SMALL, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of nodes with a Jaccard similarity of ``least`` or more, from (node, text) with each node once.

    All such pairs of small shards; of large ones as many as it takes to connect what all of them connect.
    """
    routed = staged(_routed(texts, width), "near-routed")
    keyed = routed.select("node", "fp", F.posexplode("keys").alias("key", "value")).select("node", "fp", F.xxhash64("key", "value").alias("key"))
    sizes = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lowest")).filter("m > 1"), "near-sizes")
    shared = staged(keyed.join(sizes, "key"), "near-shared")
    sets = staged(_sets(texts.join(shared.select("node").distinct(), "node", "left_semi"), width), "near-sets")
    few, large = shared.filter(F.col("m") <= small), shared.filter(F.col("m") > small)
    groups = few.count() // GROUP_NODES + 1
    trees = few.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInPandas(lambda pdf: _of_trees(pdf, radius), "a long, b long")
    return _confirmed(staged(trees.distinct(), "near-pairs"), sets, least).unionByName(_families(large, sets, least, radius))


def grouped(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(node, component): for each different text, named by its xxhash64, the smallest node that links reach.

    A null text is a text of its own, and like all texts without words it is a near copy of the empty one.  Repeated rows are one
    node; only the text is read; an empty table gives none.
    """
    text = F.col("text").cast("string")
    named = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    # equal texts are combined before they are shuffled
    texts = staged(named.groupBy("node").agg(F.first("text").alias("text")), "near-texts")
    roots = components(links(texts, width, least)).withColumnRenamed("node", "of")
    return texts.join(roots, F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("component"))
