"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Boosted
from tidemark.llm.common import pieces_of, staged
from tidemark.llm.textstats import TextStats

#: Labelled documents the trees are fitted on at most: those whose ids hash lowest.
SAMPLE = 20_000


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of each whole text as an array of floats; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1 << 20):
            x = np.nan_to_num(TextStats(batch.column(1)).features())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<float>")


def sample_of(labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """At most ``most`` labelled ids (doc_id, label), those that hash lowest; null ids and labels are left out, and of several labels of an id the highest counts."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    each = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return each.orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(most)


def one_of_each(docs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, column, label) of the sampled ids ``rows``, one document for each, however often its id comes: the one whose hash is lowest.

    The sample is broadcast, so no other document is shuffled, and documents of one id are combined before they are.
    """
    met = docs.select(F.col("doc_id").cast("long"), column).join(F.broadcast(rows), "doc_id")
    return met.groupBy("doc_id").agg(F.min_by(column, F.xxhash64(column)).alias(column), F.first("label").alias("label"))


def fit(features: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> Boosted:
    """Trees fitted on the driver over a bounded sample of labelled documents, ``sample`` at most."""
    rows = one_of_each(features, sample_of(labels, label, learn, sample), "x").toArrow()
    # one order whatever the tasks' order, so that reruns agree
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    x = np.array(rows["x"].to_pylist(), np.float32).reshape(len(order), -1 if len(order) else 1)[order]
    return Boosted().fit(x, rows["label"].to_numpy().astype(np.float64)[order])


def scored(features: DataFrame, model: Boosted) -> DataFrame:
    """(doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            score = model.predict(flat.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score): the probability of label 1 for each document, empty and null texts included.

    ``learn`` is a condition over ``labels`` that says which rows may be learned from.  With no such rows, or only one class, every
    score is the share of label 1.  Repeated documents are scored each, and one of each id is learned from; only doc_id and text are read, so
    other columns may be called anything; no documents give no rows.
    """
    features = staged(document_features(docs), "quality")
    return scored(features, fit(features, labels, label, F.lit(True) if learn is None else learn, sample))
