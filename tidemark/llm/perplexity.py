"""Quality rules with n-gram perplexity.

For each language Spark counts the 4-grams of all characters of all its documents and makes a modified Kneser-Ney model of them, by
aggregations and joins, so that the model may grow with the corpus: nothing of it is folded, cut or kept in one place.  Characters
are UTF-16 code units, of which four fill 64 bits; a character beyond the first plane is two of them, so no two texts look alike.

Every n-gram that is scored was counted, and many were counted in the scored document only.  An n-gram seen once, of any order, is
therefore scored as if it had not been seen, by backing off; else noise, all of it seen once, would look predictable.

For scoring, log-probabilities are sent as arrays sorted by hash, in loads of at most LOAD n-grams.  Languages share a load or, if they are
larger, fill several; documents are read once for each load that holds some of their language, and parts of a sum are added up.

A document's mean log-probability a character is held against the band of its language: the median of the language's documents, less and plus
a multiple of their spread, wider for short texts, whose means scatter more.  Documents below (too surprising: noise) or above (too
predictable: boilerplate) are rejected.  Rules on counts come first.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of, staged
from tidemark.llm.substrings import _mixed
from tidemark.llm.textstats import TextStats

#: Code units, and the bits of one.
CLASSES, BITS, ORDER = 1 << 16, 16, 4
#: Line ends also stand for the edges of a text.
EDGE = 10
#: N-grams that are sent to the workers at a time, at 12 bytes; n-grams that a task that counts holds at most.
LOAD, HELD = 4_000_000, 3_000_000
#: Half the band in spreads of the language, and the length at which a text scatters sqrt(2) times as much as a long one.
BAND, SHORT = 8.0, 400.0
#: Documents of a language below which its spread is not trusted and that of all documents stands for it.
LEAST_DOCS = 20


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts one after the other, one for each code unit, and where each text's begin.  Texts are preceded by edges."""
    parts, size = [], []
    edge = np.full(ORDER - 1, EDGE, np.uint16)
    for t in texts.to_pylist():
        units = np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2")
        parts += [edge, units]
        size.append(len(units))
    c = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(ORDER - 1, np.uint64)
    packed = c[3:].copy()
    for k in range(1, ORDER):
        packed |= c[ORDER - 1 - k : len(c) - k] << np.uint64(BITS * k)
    size = np.array(size, np.int64)
    # grams that end in a text's own units; those that end in the edges are cut out
    at = np.repeat(np.cumsum(size + 3) - size - 3, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return packed.view(np.int64)[at], np.concatenate([[0], np.cumsum(size)])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams and their counts from several such pairs."""
    gram, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram)
    gram, c = gram[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[at], np.add.reduceat(c, at) if len(at) else c


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) over all documents; language null is a language of its own.  Tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram, c = _summed(parts)
                for a in range(0, len(gram), 200_000):
                    g = gram[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c[a : a + 200_000])], ["lang", "gram", "c"])
            held.clear()

        for batch in pieces_of(batches, 1 << 20):
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                grams, _ = _grams(batch.column(1).filter(pa.array([x == lang for x in langs])))
                found = np.unique(grams, return_counts=True)
                held.setdefault(lang, []).append(found)
                size += len(found[0])
            if size > HELD:
                for lang, parts in held.items():
                    held[lang] = [_summed(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from out()
                    size = 0
        yield from out()

    parts = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, gram long, c long")
    return parts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounted(c: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts: one each for 1, 2, and 3 or more; they never exceed the count."""
    n1, n2, n3, n4 = (float((c == k).sum()) for k in (1, 2, 3, 4))
    if min(n1, n2, n3) == 0:
        d = (0.5, 0.75, 0.9)
    else:
        y = n1 / (n1 + 2 * n2)
        d = tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))


class KneserNey:
    """The model on one machine: sorted arrays of the seen n-grams of orders 1 to 4 with their interpolated probabilities, and weights of their contexts."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        key = gram.astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        key, c = key[order], count[order].astype(np.float64)
        tables = [(key, c)]
        for n in range(ORDER - 1, 0, -1):  # lower orders count how many different n-grams end in them
            key, c = np.unique(self._end(tables[0][0], n), return_counts=True)
            tables.insert(0, (key, c.astype(np.float64)))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n, (key, c) in enumerate(tables, 1):
            context, where = np.unique(key >> np.uint64(BITS), return_inverse=True)
            total, less = np.bincount(where, c), _discounted(c)
            weight = np.bincount(where, less) / total
            self.levels.append((key, (c - less) / total[where] + weight[where] * self._look(n - 1, self._end(key, n - 1)), context, weight))

    @staticmethod
    def _end(key: np.ndarray, n: int) -> np.ndarray:
        return key & np.uint64((1 << BITS * n) - 1)

    def _look(self, n: int, key: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams, backing off where they were not seen."""
        if n == 0:
            return np.full(len(key), 1.0 / CLASSES)
        keys, p, context, weight = self.levels[n - 1]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        seen = keys[at] == key
        out = np.empty(len(key))
        out[seen] = p[at[seen]]
        rest = key[~seen]
        before = rest >> np.uint64(BITS)
        at = np.minimum(np.searchsorted(context, before), len(context) - 1)
        out[~seen] = np.where(context[at] == before, weight[at], 1.0) * self._look(n - 1, self._end(rest, n - 1))
        return out

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        return np.log(self._look(ORDER, grams.astype(np.int64).view(np.uint64)))


def _end(n: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1).cast("long"))


def log_probabilities(counts: DataFrame, held_out: bool = True) -> DataFrame:
    """(lang, gram, log_p) for each row of ``counts`` (lang, gram, c), every language by a model of its own.

    Without ``held_out`` the same as KneserNey; with it, n-grams seen once are scored by backing off.
    """
    of = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), "lang"))
    levels = [staged(counts.select(of.alias("of"), "gram", "c"), "grams")]
    for n in range(ORDER - 1, 0, -1):
        levels.insert(0, staged(levels[0].groupBy("of", _end(n).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams"))
    lower = None
    for n, rows in enumerate(levels, 1):
        seen = rows.groupBy("of").agg(*(F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
        enough = F.least("n1", "n2", "n3") > 0
        bounded = lambda k: F.least(F.greatest(k - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.05)), F.lit(k - 0.05))  # noqa: B023, E731
        less = staged(seen.select("of", *(F.when(enough, bounded(k)).otherwise(F.lit(v)).alias(f"d{k}") for k, v in ((1, 0.5), (2, 0.75), (3, 0.9)))), "grams-less")
        # a row a language
        less = rows.join(F.broadcast(less), "of").select("of", "gram", "c", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("less"))
        less = less.withColumn("context", F.shiftrightunsigned("gram", BITS))
        contexts = staged(less.groupBy("of", "context").agg(F.sum("c").alias("total"), F.sum("less").alias("all_less")), "grams-contexts")
        both = less.join(F.broadcast(contexts) if n == 1 else contexts, ["of", "context"])
        if n == 1:
            both = both.withColumn("lower", F.lit(1.0 / CLASSES))
        else:
            both = both.withColumn("end", _end(n - 1)).join(lower, ["of", "end"])
        backed = F.col("all_less") / F.col("total") * F.col("lower")
        p = (F.col("c") - F.col("less")) / F.col("total") + backed
        if held_out:
            p = F.when(F.col("c") > 1, p).when(F.col("total") > 1, backed).otherwise(F.col("lower"))
        lower = staged(both.select("of", F.col("gram").alias("end"), p.alias("lower")), "grams-p")
    lang = F.when(F.col("of") != "", F.substring("of", 2, 1 << 30))
    return lower.select(lang.alias("lang"), F.col("end").alias("gram"), F.log("lower").cast("float").alias("log_p"))


class Sorted:
    """Values of 64-bit keys: arrays sorted by the keys' hash, and where each range of hashes begins."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        h = _mixed(key.view(np.uint64))  # one to one
        order = np.argsort(h)
        self.h, self.value = np.append(h[order], np.uint64(2**64 - 1)), np.append(value[order], np.float32(0))
        bits = max(1, len(h).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(h[order], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def look(self, key: np.ndarray) -> np.ndarray:
        """The value of each key, 0 for those that are not held."""
        h = _mixed(key.view(np.uint64))
        at = self.begin[h >> self.shift]
        while len(behind := np.flatnonzero(self.h[at] < h)):
            rest, goal = at[behind], h[behind]
            while (late := self.h[rest] < goal).any():
                rest[late] += 1
            at[behind] = rest
        return np.where(self.h[at] == h, self.value[at], np.float32(0))


def loads(sizes: list[tuple[str | None, int]], most: int) -> list[list[tuple[str | None, int, int]]]:
    """Which (language, part, parts) are sent together: at most about ``most`` n-grams each time.  A language of more has loads of its own."""
    out, room = [], 0
    for lang, n in sorted(sizes, key=lambda x: (-x[1], x[0] or "")):
        parts = -(-n // most)
        if parts > 1:
            out += [[(lang, i, parts)] for i in range(parts)]
            room = 0
        elif out and n <= room:
            out[-1].append((lang, 0, 1))
            room -= n
        else:
            out.append([(lang, 0, 1)])
            room = most - n
    return out


def _is_one_of(langs: list[str | None]) -> Column:
    own = F.coalesce(F.col("lang").isin([x for x in langs if x is not None]), F.lit(False))
    return own | F.col("lang").isNull() if None in langs else own


_worker: dict[str, dict[str | None, Sorted]] = {}


def _held(sent) -> dict[str | None, Sorted]:
    mark, arrays = sent.value
    if mark not in _worker:
        _worker.clear()
        _worker[mark] = {lang: Sorted(*pair) for lang, pair in arrays.items()}
    return _worker[mark]


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(docs: DataFrame, sent) -> DataFrame:
    """Statistics and the sum of the log-probabilities in a load, for each document; ``h1`` and ``h2`` stand for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1 << 20):
            stats = TextStats(batch.column(2))
            langs = batch.column(1).to_pylist()
            total = np.zeros(batch.num_rows)
            for lang in dict.fromkeys(langs):
                own = np.flatnonzero([x == lang for x in langs])
                grams, at = _grams(batch.column(2).take(pa.array(own)))
                if len(grams):
                    sums = np.concatenate([[0.0], np.cumsum(_held(sent)[lang].look(grams), dtype=np.float64)])
                    total[own] = sums[at[1:]] - sums[at[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.asarray(getattr(stats, k), np.int64)) for k in [*_STATS, "n_chars"]), batch.column(3), batch.column(4), pa.array(total)],
                ["doc_id", "lang", *_STATS, "n_chars", "h1", "h2", "total"],
            )

    schema = "doc_id long, lang string, " + ", ".join(f"{k} long" for k in [*_STATS, "n_chars"]) + ", h1 long, h2 int, total double"
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("text"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")).mapInArrow(run, schema)


def scored(docs: DataFrame, probabilities: DataFrame, load: int = LOAD) -> DataFrame:
    """Statistics and the mean log-probability a character (null without characters) of each document, by ``probabilities`` (lang, gram, log_p)."""
    spark = docs.sparkSession
    sizes = {r["lang"]: r["n"] for r in probabilities.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole, split = [], {}
    for one in loads(list(sizes.items()), load):
        langs = [x[0] for x in one]
        _, part, parts = one[0]
        own = probabilities.filter(_is_one_of(langs))
        if parts > 1:
            own = own.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part)
        got = own.toArrow()
        lang, gram, value = got["lang"].combine_chunks().dictionary_encode(), got["gram"].to_numpy(), got["log_p"].to_numpy()
        names = [*lang.dictionary.to_pylist(), None]
        which = lang.indices.fill_null(len(names) - 1).to_numpy()
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(len(names) + 1))
        arrays = {name: (gram[order[a:b]], value[order[a:b]]) for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True) if b > a}
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, arrays))
        sums = staged(_sums(docs.filter(_is_one_of(langs) & (F.length("text") > 0)), sent), "perplexity-sums")
        sent.destroy()
        if parts > 1:
            split.setdefault(parts, []).append(sums)
        else:
            whole.append(sums)
    # texts without characters need no model
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, {}))
    whole.append(_sums(docs.filter(F.coalesce(F.length("text"), F.lit(0)) == 0), sent))
    # the parts of a sum meet; rows that are equal in all have equal sums and stay as many as they were
    for parts, some in split.items():
        names = [c for c in some[0].columns if c != "total"]
        met = functools.reduce(DataFrame.unionByName, some).groupBy(*names).agg(F.sum("total").alias("total"), (F.count(F.lit(1)) / parts).cast("long").alias("copies"))
        whole.append(met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*names, (F.col("total") / F.col("copies")).alias("total")))
    mean = F.when(F.col("n_chars") > 0, F.col("total") / F.col("n_chars"))
    return functools.reduce(DataFrame.unionByName, whole).select("doc_id", "lang", *_STATS, "n_chars", mean.alias("log_probability"))


def bands(scores: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, middle, spread) from the documents with 20 words or more; one row a language.

    The spread is the median distance from the language's middle.  In a language with fewer than ``least_docs`` such documents it is
    the median over the documents of all languages, each by its distance from its own language's middle.
    """
    own = scores.filter("n_words >= 20 and log_probability is not null")
    # a row a language, written so that its size is known: the join that follows needs no shuffle of documents by language
    middle = staged(own.groupBy("lang").agg(F.percentile_approx("log_probability", 0.5, 10_000).alias("middle"), F.count(F.lit(1)).alias("docs")), "perplexity-middle")
    off = own.join(middle.select(F.col("lang").alias("m_lang"), "middle"), F.col("lang").eqNullSafe(F.col("m_lang")))
    scaled = F.abs(F.col("log_probability") - F.col("middle")) / F.sqrt(1 + F.lit(SHORT) / F.col("n_chars"))
    spread = off.groupBy("lang").agg(F.percentile_approx(scaled, 0.5, 10_000).alias("spread"))
    of_all = off.agg(F.percentile_approx(scaled, 0.5, 10_000).alias("of_all"))
    joined = middle.withColumnRenamed("lang", "m_lang").join(spread, F.col("lang").eqNullSafe(F.col("m_lang"))).crossJoin(F.broadcast(of_all))
    trusted = F.when(F.col("docs") >= least_docs, F.col("spread")).otherwise(F.col("of_all"))
    return joined.select("lang", "middle", F.greatest(trusted, F.lit(0.005)).alias("spread"))


def judged(docs: DataFrame, band: float = BAND, least_docs: int = LEAST_DOCS, load: int = LOAD) -> DataFrame:
    """(doc_id, lang, statistics, n_chars, perplexity, base_failed, kept) for each document.

    Base rules: fewer than 20 words, or more than 30% of the words in 8-word windows that come twice.  What passes them is kept if its mean
    log-probability lies within the band of its language; every language has a model and a band of its own.  Null texts count as
    empty (and fail); null is a language; repeated rows are judged each, and count each in the model.
    """
    scores = staged(scored(docs, log_probabilities(gram_counts(docs)), load), "perplexity")
    limits = staged(bands(scores, least_docs), "perplexity-bands").withColumnRenamed("lang", "b_lang")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    off = F.abs(F.col("log_probability") - F.col("middle")) / F.sqrt(1 + F.lit(SHORT) / F.col("n_chars"))
    inside = F.coalesce(off <= band * F.col("spread"), F.lit(True))
    both = scores.join(limits, F.col("lang").eqNullSafe(F.col("b_lang")), "left")
    return both.select(*[c for c in scores.columns if c != "log_probability"], F.exp(-F.col("log_probability")).alias("perplexity"), failed.alias("base_failed"), (~failed & inside).alias("kept"))
