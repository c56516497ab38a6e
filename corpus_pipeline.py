"""Corpus pipeline: from the documents table to packed training sequences.

Five stages, each of which calls one operator on all that the stage before it kept.  A stage's result is written as Parquet
and read again as the next one's documents.  All but the last return the columns of documents, others that the table has besides among them,
whatever their names.  Null texts count as empty, null ids and sources are ids and sources like any others, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, nearcopies, packing, substrings, toxicity
from tidemark.llm.common import staged, table

#: Documents with this toxicity or more go.
TOXIC = 0.3


def _narrow(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` as the columns ``own`` that an operator reads, and all others in one struct, so that none has a name that an operator uses."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*rest) if rest else F.lit(True)).alias("pipeline_rest"))


def _wide(narrow: DataFrame, like: DataFrame, own: dict[str, Column]) -> DataFrame:
    """The columns of ``like`` from ``_narrow``, those in ``own`` by their expressions."""
    return narrow.select(*(own[c].alias(c) if c in own else F.col("pipeline_rest").getField(c).alias(c) for c in like.columns))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels table, scores below TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    kept = toxicity.scored(_narrow(docs, "text"), model).filter(F.col("score") < TOXIC)
    return _wide(kept, docs, {"text": F.col("text")})


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, by a Jaccard similarity of five-word shingles of 0.8 or more: the one with the smallest id, nulls last, and of rows equal in id and text any one.

    Components are of texts, named by 64-bit hashes, so rows without id and rows that come again are in them like all others.
    """
    keys = ["near_none", "near_id", "near_text"]
    marks = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0)), F.xxhash64(F.col("text").cast("string"))]
    marked = docs.select(*(m.alias(k) for m, k in zip(marks, keys, strict=True)), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    of_text = staged(nearcopies.grouped(docs).select(F.col("node").alias("near_text"), "component"), "near-components")
    rows = staged(marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("near_rows")), "near-rows")
    first = rows.join(of_text, "near_text").groupBy("component").agg(F.min(F.struct(*keys, "near_rows")).alias("first"))
    first = staged(first.select("first.*"), "near-first")
    single = marked.join(first.filter("near_rows = 1"), keys, "left_semi").select("row")
    # rows that come again are combined before they are shuffled
    again = marked.join(first.filter("near_rows > 1"), keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row"))
    return single.unionByName(again.select("row")).select("row.*")


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that come again; n_chars follows the text."""
    cut = substrings.without_duplicates(_narrow(docs, "doc_id", "text"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return _wide(cut, docs, own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.  No two documents have one text by now, so the text tells rows of one id apart."""
    own = ("doc_id", "text", "source")
    mixed = mixing.mix(_narrow(docs, *own), row=F.xxhash64(F.col("text")))
    return _wide(mixing.repeated(mixed), docs, {c: F.col(c) for c in own})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document with their ids, and where each lies in a sequence of 2048 tokens."""
    return packing.pack_documents(docs, 2048)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_shared_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models, XXH64 and tokenizers are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
