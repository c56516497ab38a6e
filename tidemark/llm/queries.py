"""The thin opN_<name> queries: the operator at production parameters over the whole table, then its digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import attribution, mixing, packing, perplexity, quality, sharding, simhash, substrings, topk, toxicity
from tidemark.llm.common import staged, table


def _id_remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), 2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = staged(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), mixing.place_of(docs).alias("place")), "words")
    mixed = mixing.mix(sizes, size=F.col("words"), row=F.col("place"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text)
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _id_remainder(3) != 1)
    return scores.select("doc_id", F.coalesce(_id_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _id_remainder(4) != 2)
    return scores.select("doc_id", F.coalesce(_id_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), "first")


def queries() -> dict:
    found = (op1_pack, op2_substrings, op3_mix, op4_topk, op5_shards, op6_perplexity, op7_quality, op8_toxicity, op9_simhash, op10_tokens)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express: tokenizers, XXH64, seeded permutations and fitted models it can't."""
    return {
        "op2_substrings": r"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
            twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
            gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS j FROM windows SEMI JOIN twice USING (k)),
            one AS (SELECT r, doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
            stay AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM one ANTI JOIN gone USING (r, j) GROUP BY r)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN stay USING (r)""",
        "op4_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
            k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    }
