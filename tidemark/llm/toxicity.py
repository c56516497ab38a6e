"""Toxicity by multiple-instance learning: labels say which documents are toxic, the model learns which sentences are.

A sentence has the probability sigmoid(bias + sum of its words' weights), and a document is toxic unless none of its
sentences is: noisy-or.  Both are fitted together from document labels; afterwards sentence probabilities locate the offending
sentences.  A word's weight is the sum of those of its features, the whole word and its first 4, 5 and 6 bytes, so that inflected
forms are known by their beginnings.  Only features that come significantly more often in toxic documents get a weight.  Weights are drawn to the
log-odds of their features, so that a word that is always toxic counts in full even if all its documents hold others besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import pieces_of, staged
from tidemark.llm.quality import one_of_each, sample_of

#: Labelled documents that are learned from at most.
SAMPLE = 12_000
#: Words a worker remembers.
REMEMBERED = 100_000

_CLEAN = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _CLEAN[_b] = 10 if _c in ".!?\n" else ord(_c.lower()) if _c.isalpha() else 32
_CLEAN = bytes(_CLEAN)


def sentences(text: bytes | None) -> list[bytes]:
    """ASCII letters lowered, other ASCII characters as spaces; cut at full stops, exclamation and question marks and line feeds."""
    return (text or b"").translate(_CLEAN).split(b"\n")


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The word, marked by a closing space, and its beginnings."""
    return (word + b" ", *(word[:n] for n in (4, 5, 6) if len(word) > n))


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of (text, label) a feature comes.  Each task adds up what it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            t, c = (pa.array([v[k] for v in seen.values()], pa.int64()) for k in (1, 0))
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), t, c], ["feature", "toxic", "clean"])

        for batch in pieces_of(batches):
            for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in {w for s in sentences(text) for w in s.split()} for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[label] += 1
            if len(seen) > REMEMBERED:
                yield out()
                seen.clear()
        yield out()

    parts = sample.select("text", F.col("label").cast("int")).mapInArrow(run, "feature binary, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class NoisyOr:
    """``weights`` of features and the ``bias`` of a sentence."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "_known": {}}

    def sentence_logits(self, text: bytes | None) -> list[float]:
        known, of, out = self._known, self.weights.get, []
        if len(known) > REMEMBERED:
            known.clear()
        for s in sentences(text):
            words = s.split()
            if words:
                total = self.bias
                for w in words:
                    x = known.get(w)
                    if x is None:
                        x = known[w] = sum(of(f, 0.0) for f in features_of(w))
                    total += x
                out.append(total)
        return out

    def score(self, logits: list[float]) -> float:
        """1 less the chance that no sentence is toxic."""
        return float(-np.expm1(-np.logaddexp(0, np.array(logits)).sum()))


def fit(sample: DataFrame, steps: int = 400) -> NoisyOr:
    """Fitted on the driver from (doc_id, text, label), an id once: what is collected is the list of features that come significantly more often
    in toxic documents, and their places in the sample's sentences."""
    counts = staged(feature_counts(sample), "toxicity-features")
    n1, n0 = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n1 or not n0:
        return NoisyOr({}, -20.0 if not n1 else 20.0)
    share_1, share_0 = (F.col("toxic") + 0.5) / (n1 + 1.0), (F.col("clean") + 0.5) / (n0 + 1.0)
    both = (F.col("toxic") + F.col("clean") + 1.0) / (n1 + n0 + 2.0)
    chi = F.pow(share_1 - share_0, F.lit(2.0)) / (both * (1 - both) * (1.0 / n1 + 1.0 / n0))
    chosen = counts.filter((F.col("toxic") >= 2) & (share_1 > 3 * share_0)).withColumn("chi", chi).filter("chi > 12").orderBy(F.desc("chi"), "feature")
    # what is hardly significant is hardly believed
    rows = chosen.select("feature", (F.log(share_1 / share_0) * (1 - 12 / F.col("chi"))).alias("odds")).collect()
    names, odds = [bytes(r["feature"]) for r in rows], np.array([r["odds"] for r in rows], np.float64)
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document: sentences, and (sentence, feature, times) for the chosen features."""
        for batch in pieces_of(batches):
            count, at = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = [words for s in sentences(text) if (words := s.split())]
                count.append(len(own))
                at.append([x for i, words in enumerate(own) for w in words for f in features_of(w) if f in index for x in (i, index[f])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count, pa.int64()), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "label", "n", "at"])

    rows = sample.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(run, "doc_id long, label int, n long, at array<int>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    label, n = rows["label"].to_numpy()[order].astype(np.float64), rows["n"].to_numpy()[order]
    lists = rows["at"].to_pylist()
    doc, sentence, feature, place = [], [], [], 0
    for d, i in enumerate(order.tolist()):
        pairs = np.array(lists[i], np.int64).reshape(-1, 2)
        names_here, which = np.unique(pairs[:, 0], return_inverse=True)
        doc += [d] * len(names_here)
        sentence.append(which + place)
        feature.append(pairs[:, 1])
        place += len(names_here)
    doc = np.array(doc, np.int64)
    sentence, feature = np.concatenate(sentence or [doc]).astype(np.int64), np.concatenate(feature or [doc]).astype(np.int64)
    plain = n - np.bincount(doc, minlength=len(n))  # sentences with no chosen feature all look the same
    w, bias = odds.copy(), -8.0
    m, v, ridge = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0.5
    for step in range(1, steps + 1):
        z = bias + np.bincount(sentence, w[feature], place)
        u = np.bincount(doc, np.logaddexp(0, z), len(n)) + plain * np.logaddexp(0, bias)
        # of a toxic document, -log(1 - exp(-u)); of a clean one, u
        slope = np.where(label == 1, -1 / np.expm1(np.minimum(np.maximum(u, 1e-6), 50)), 1.0)
        dz = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, dz[sentence], len(names)) + ridge * (w - odds), (slope * plain).sum() / (1 + np.exp(-bias)) + dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - change[:-1], min(bias - float(change[-1]), -3.0)
    return NoisyOr(dict(zip(names, w.tolist(), strict=True)), bias)


def scored(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``docs`` with ``score`` and ``worst`` (the number of its most toxic sentence, from 0, counting sentences with a word; null without words)."""
    kept = docs.drop("score", "worst")
    names, where = kept.columns, kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("worst", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            logits = [model.sentence_logits(t) for t in batch.column(where).cast(pa.binary()).to_pylist()]
            score = pa.array([model.score(x) for x in logits], pa.float64())
            worst = pa.array([int(np.argmax(x)) if x else None for x in logits], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, score, worst], [*names, "score", "worst"])

    return kept.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", sample: int = SAMPLE) -> NoisyOr:
    """The model from at most ``sample`` labelled documents, those whose ids hash lowest; ``learn`` is a condition over ``labels``."""
    rows = sample_of(labels, label, F.lit(True) if learn is None else learn, sample)
    return fit(staged(one_of_each(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows, "text"), "toxicity-sample"))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, worst) of each document.

    Null and empty texts have no sentence and score 0.  Without labelled rows, or with one class only, the score of documents with words is 0
    (all clean) or 1 (all toxic).  Repeated rows are scored each, and one document of each id is learned from.  Only doc_id and text are read, so
    other columns may be called anything; no documents give no rows.
    """
    model = train(docs, labels, learn, label, sample)
    return scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model).select("doc_id", "score", "worst")
