"""Substring dedup by relative Lempel-Ziv parsing.

A window is ``window`` consecutive words.  A window is a duplicate if its words also start anywhere else; words covered by a
duplicate window are removed.  All windows are judged on the input.

Every document is parsed into factors, the longest stretches that also stand in a reference block.  The reference is the corpus itself, each different
window where it stands first (by doc_id); the stretches of a document that are first form its blocks, so a window stands once in the
reference and a factor goes on as long as the reference does.  What stands first is held against the place where it stands last, so no factor is its own reference.

The index of the reference is cut so that a document meets only what it can share a window with: each window belongs to its minimizer, the word run of
length ``anchor`` within it that hashes lowest (the first of equals).  A document falls into pieces, the runs of windows with one
minimizer, of at most ``window - anchor + 1`` windows, and a piece is factored against the pieces with the same minimizer:

1. Pieces whose minimizer comes once in the corpus share nothing; they are dropped after one count by minimizer.
2. Each different piece is parsed once, however often it comes.  If all pieces of a minimizer are the same, it is one factor.
3. Else factors end within pieces, where documents begin to differ.  Windows at such boundaries are looked up one by one in an index
   of the windows of all different pieces of the minimizer.

Every occurrence of a piece takes over its parse, and neighbouring parts with the same reference at the same distance are joined into the
longest factors.  Equal pieces and windows are combined before they are shuffled, so a passage in a third of all documents costs
as many rows as there are tasks, and the texts around it, all different, spread over all partitions.

Equality is that of two 64-bit hashes together, of minimizer and piece, or of minimizer and window, both over the XXH64 of each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import pieces_of, staged

WINDOW, ANCHOR = 35, 8
#: Stands for a doc_id that is null.
NOBODY = -(1 << 63)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD93 + 2
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size, out = max(n, 1 << 20), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: byte places, first word of each text, and hashes of any run of words."""

    def __init__(self, texts: pa.Array):
        col = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = col.buffers()[2]
        self.data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        space = _SPACE[self.data]
        opens, closes = np.empty(len(space), bool), np.empty(len(space), bool)
        opens[1:], closes[:-1] = space[:-1], space[1:]
        if len(space):
            opens[0] = closes[-1] = True
            opens[offsets[:-1][offsets[:-1] < len(space)]] = True
            closes[offsets[1:][offsets[1:] > 0] - 1] = True
        self.start, self.end = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
        self.first = np.searchsorted(self.start, offsets)
        each = [w for t in col.to_pylist() for w in t.split()]
        word = np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(each))
        up, self._down = _power(len(word) + 1)
        self._run = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * up[: len(word)], out=self._run[1:], dtype=np.uint64)

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Of the n words from each place on."""
        return _mixed((self._run[at + n] - self._run[at]) * self._down[at] + np.asarray(n).astype(np.uint64))

    def pieces(self, window: int, anchor: int) -> tuple[np.ndarray, ...]:
        """Text, first window within the text, windows, minimizer and hash of each piece."""
        total = len(self.start)
        if total < window:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        low = self.hashes(np.arange(total - anchor + 1), anchor)
        at = np.arange(len(low))
        width, reach = window - anchor + 1, 1
        while reach < width:  # the lowest of `reach` anchors from each place on; equals go to the first
            step = min(reach, width - reach)
            better = low[step:] < low[:-step]
            low, at = np.where(better, low[step:], low[:-step]), np.where(better, at[step:], at[:-step])
            reach += step
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[: len(low)]
        inside = np.flatnonzero(np.arange(len(low)) + window <= self.first[1:][text])
        if not len(inside):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        new = np.ones(len(inside), bool)
        new[1:] = (at[inside][1:] != at[inside][:-1]) | (text[inside][1:] != text[inside][:-1])
        begin = inside[new]
        n = np.diff(np.append(np.flatnonzero(new), len(inside)))
        return text[begin], begin - self.first[text[begin]], n, low[begin], self.hashes(begin, n + window - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with sub_doc and sub_text, which tell rows apart; rows equal in both are parsed alike, each for itself.  Neither is ever null."""
    text = F.col("text").cast("string")
    return docs.withColumn("sub_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY))).withColumn("sub_text", F.xxhash64(F.lit(1), text))


def _pieces(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1 << 20):
            text, start, n, mini, whole = Words(batch.column(2)).pieces(window, anchor)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mini.view(np.int64)), pa.array(whole.view(np.int64))],
                ["sub_doc", "sub_text", "start", "n", "mini", "piece"],
            )

    return keyed.select("sub_doc", "sub_text", "text").mapInArrow(run, "sub_doc long, sub_text long, start int, n int, mini long, piece long")


def _boundary_windows(listed: DataFrame, window: int) -> DataFrame:
    """The windows of the pieces listed beside each text: (mini, piece, at, hash, copies, first, last), ``at`` being the window's number in its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1 << 20):
            words, listed_ = Words(batch.column(2)), batch.column(3)
            row = pc.list_parent_indices(listed_).to_numpy(zero_copy_only=False)
            start, n, mini, piece, copies, last_doc, last_text, last_start = (pc.struct_field(listed_.flatten(), k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8))
            which = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            rows = pa.array(row[which])
            h = words.hashes(words.first[row[which]] + start[which] + at, window)
            place = lambda doc, text, begin: pa.StructArray.from_arrays([doc, text, pa.array((begin[which] + at).astype(np.int32))], ["doc", "text", "start"])
            first = place(batch.column(0).take(rows), batch.column(1).take(rows), start)
            last = place(pa.array(last_doc[which]), pa.array(last_text[which]), last_start)
            yield pa.RecordBatch.from_arrays([pa.array(mini[which]), pa.array(piece[which]), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(copies[which]), first, last], ["mini", "piece", "at", "hash", "copies", "first", "last"])

    place = "struct<doc:long,text:long,start:int>"
    return listed.mapInArrow(run, f"mini long, piece long, at int, hash long, copies long, first {place}, last {place}")


def _parsed(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """(sub_doc, sub_text, found): the duplicate windows of a text as stretches (start, n, ref_doc, ref_start), in no order."""
    pieces = _pieces(keyed, window, anchor)
    # what is joined back is written first: a join of two plain scans has partitions that Spark can split where a key is hot
    often = staged(pieces.groupBy("mini").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("mini"), "substrings-often")
    shared = staged(pieces.join(often, "mini"), "substrings-shared")
    # each different piece once: how often it comes, and where it comes first and last
    place = F.struct(F.col("sub_doc").alias("doc"), F.col("sub_text").alias("text"), "start")
    different = staged(shared.groupBy("mini", "piece").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")), "substrings-different")
    mixed = staged(different.groupBy("mini").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("mini"), "substrings-mixed")
    alone = different.join(mixed, "mini", "left_anti").filter("copies > 1")
    whole = alone.select("mini", "piece", F.array(F.struct(F.lit(0).alias("at"), "n", "first", F.struct("last.doc", "last.start").alias("last"))).alias("parts"))
    entry = F.struct(F.col("first.start").alias("start"), "n", "mini", "piece", "copies", F.col("last.doc").alias("last_doc"), F.col("last.text").alias("last_text"), F.col("last.start").alias("last_start"))
    listed = different.join(mixed, "mini").groupBy(F.col("first.doc").alias("sub_doc"), F.col("first.text").alias("sub_text")).agg(F.collect_list(entry).alias("listed"))
    # rows equal in id and text are one
    texts = keyed.join(listed, ["sub_doc", "sub_text"]).groupBy("sub_doc", "sub_text").agg(F.first(F.struct("text", "listed")).alias("own")).select("sub_doc", "sub_text", "own.text", "own.listed")
    windows = staged(_boundary_windows(texts, window), "substrings-windows")
    index = windows.groupBy("mini", "hash").agg(F.sum("copies").alias("c"), F.min("first").alias("first"), F.max("last").alias("last")).filter("c > 1").drop("c")
    index = staged(index, "substrings-index")
    looked = windows.select("mini", "piece", "at", "hash").join(index, ["mini", "hash"])
    # a piece has at most window - anchor + 1 windows; those whose places go on side by side are one part
    along = Window.partitionBy("mini", "piece").orderBy("at")
    goes_on = F.lit(True)
    for c, step in (("at", 1), ("first.doc", 0), ("first.text", 0), ("first.start", 1), ("last.doc", 0), ("last.text", 0), ("last.start", 1)):
        goes_on = goes_on & (F.lag(c).over(along) + step == F.col(c))
    runs = looked.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    runs = runs.groupBy("mini", "piece", "run").agg(F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("n"), F.min("first").alias("first"), F.min("last").alias("last"))
    cut = runs.groupBy("mini", "piece").agg(F.collect_list(F.struct("at", "n", "first", F.struct("last.doc", "last.start").alias("last"))).alias("parts"))
    parts = staged(whole.unionByName(cut), "substrings-parts")
    # what stands first is held against the last place
    own = lambda p: (p["first"]["doc"] == F.col("sub_doc")) & (p["first"]["text"] == F.col("sub_text")) & (p["first"]["start"] == F.col("start") + p["at"])
    ref = lambda p, c: F.when(own(p), p["last"][c]).otherwise(p["first"][c])
    stretch = lambda p: F.struct((F.col("start") + p["at"]).alias("start"), p["n"].alias("n"), ref(p, "doc").alias("ref_doc"), ref(p, "start").alias("ref_start"))
    taken = shared.join(parts, ["mini", "piece"]).select("sub_doc", "sub_text", F.transform("parts", stretch).alias("stretches"))
    return taken.groupBy("sub_doc", "sub_text").agg(F.flatten(F.collect_set("stretches")).alias("found"))


def _factors(start: np.ndarray, n: np.ndarray, doc: np.ndarray, ref: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The greedy parse: from left to right, as far as one reference goes on, (start, words, ref_doc, ref_start) from stretches of duplicate windows."""
    order = np.argsort(start, kind="stable")
    start, n, doc, ref = start[order], n[order], doc[order], ref[order]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ref[1:] - start[1:] != ref[:-1] - start[:-1]) | (start[1:] != start[:-1] + n[:-1])
    i = np.flatnonzero(new)
    ends = np.append(i[1:], len(start)) - 1
    return start[i], start[ends] + n[ends] - start[i] + window - 1, doc[i], ref[i]


def without_duplicates(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with ``text`` cut to the words that stay, and n_words, n_removed and ``factors``.

    The words that stay are joined by one space.  ``factors`` lists the duplicate spans as (start, length, ref_doc, ref_start)
    in words, by start; they may overlap by less than a window.  The reference is another place at which the same words stand (of rows that are equal in id and text, the
    other row); ref_doc is null where that row has no id.  Null texts become empty; texts shorter than the window lose nothing; repeated rows are copies of each other; all
    other columns stay as they are; an empty table gives an empty table.  Columns named n_words, n_removed, factors, sub_doc, sub_text or found are replaced.
    """
    keyed = _keyed(docs.drop("n_words", "n_removed", "factors", "sub_doc", "sub_text", "found").withColumn("text", F.col("text").cast("string")))
    joined = keyed.join(_parsed(keyed.select("sub_doc", "sub_text", "text"), window, anchor), ["sub_doc", "sub_text"], "left").drop("sub_doc", "sub_text")
    names = [c for c in joined.columns if c != "found"]
    columns = {c: joined.columns.index(c) for c in joined.columns}
    factor = T.StructType.fromDDL("start int, length int, ref_doc long, ref_start int")
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            texts, counts, removed, factors = [], [], [], []
            lists = batch.column(columns["found"])
            fields = [pc.struct_field(lists.flatten(), k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(length)
            for text, a, b in zip(batch.column(columns["text"]).cast(pa.binary()).to_pylist(), (ends - length).tolist(), ends.tolist(), strict=True):
                words = (text or b"").split()
                counts.append(len(words))
                if a < b:
                    start, n, doc, ref = _factors(*(f[a:b] for f in fields), window)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay.tolist()]
                    factors.append([{"start": s, "length": m, "ref_doc": None if d == NOBODY else d, "ref_start": r} for s, m, d, r in zip(start.tolist(), n.tolist(), doc.tolist(), ref.tolist(), strict=True)])
                else:
                    removed.append(0)
                    factors.append([])
                texts.append(b" ".join(words))
            out = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(columns[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(factors, kinds)], [*names, "n_words", "n_removed", "factors"])

    schema = T.StructType([*(joined.schema[c] for c in names), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("factors", T.ArrayType(factor))])
    return joined.mapInArrow(run, schema)
