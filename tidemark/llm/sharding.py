"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters whole rows uniformly into buckets that fit in memory, by a seeded hash; there are as many as the rows' bytes
ask for.  Pass two puts each bucket into a fixed order and Fisher-Yates shuffles it (the ``shuffle`` function draws its indices that
way).  Buckets one after the other are a uniform permutation of all rows; shards are equal cuts of it, so their counts differ by
one at most, and a bucket goes into one shard or two neighbouring ones as it is written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged

#: Bytes of a bucket, on average; a row is never cut.
BUCKET_BYTES = 16 << 20
#: Buckets whose counts are summed together, and partitions that buckets are dealt into at most.
RUN, PARTITIONS = 4_096, 200_000


def _bytes(schema: T.StructType) -> Column:
    """About what a row takes in memory: texts by their length, numbers 16 bytes each, other columns by their JSON."""
    total = F.lit(16).cast("long")
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            total = total + 16
    return total


def _scattered(rows: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """(at, row) of all rows, written, with how many rows and buckets there are."""
    held = staged(rows.select(F.monotonically_increasing_id().alias("at"), _bytes(rows.schema).alias("bytes"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")), "sharding")
    n, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, math.ceil(size / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(buckets))
    return held.select(bucket.alias("bucket"), "at", "row"), n, buckets


def _placed(rows: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    scattered, n, buckets = _scattered(rows, seed, bucket_bytes)
    # a fixed number of partitions and a fixed order in each, since the generator is seeded by the partition's number
    dealt = scattered.repartition(min(buckets, PARTITIONS), "bucket")
    held = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("held")).sortWithinPartitions("bucket")
    mixed = held.select("bucket", F.shuffle("held", F.lit(seed)).alias("held"))
    # running sums in two steps, so that no task sees more than RUN buckets or one row for each RUN of them
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).select("run", upto(Window.orderBy("run")).alias("before"))
    inside = counts.select("bucket", "run", upto(Window.partitionBy("run").orderBy("bucket")).alias("within"))
    # a row a bucket
    bases = staged(inside.join(runs, "run").select("bucket", (F.col("before") + F.col("within")).alias("base")), "sharding-bases")
    placed = mixed.join(bases, "bucket").select("base", F.posexplode("held").alias("slot", "one"))
    return placed.select("one.row.*", (F.col("base") + F.col("slot")).alias("place")), n


def shuffled(rows: DataFrame, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` with ``place``: its place (long, from 0, gapless) in a seeded permutation of all rows.

    Buckets come from a hash of the row's place in the input, so rows that are equal don't meet in one bucket.  The same input files and session settings give the
    same permutation.  Rows may hold nulls and texts of any length; a column named place is replaced; an empty table gives an empty table.
    """
    return _placed(rows.drop("place"), seed, bucket_bytes)[0]


def sharded(rows: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), which replace columns of these names.  The first n mod ``shards`` shards hold one row more."""
    placed, n = _placed(rows.drop("shard", "slot", "place"), seed, bucket_bytes)
    each, more = divmod(n, shards)
    place = F.col("place")
    head = more * (each + 1)
    shard = F.when(place < head, F.floor(place / (each + 1))).otherwise(more + F.floor((place - head) / max(each, 1))).cast("int")
    start = F.col("shard") * each + F.least(F.col("shard"), F.lit(more))
    return placed.withColumn("shard", shard).withColumn("slot", (place - start).cast("long")).drop("place")


def write_shards(rows: DataFrame, path: str, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes whole rows as Parquet folders ``shard=0`` ... under ``path``; within a file rows stand in the order of their slots.

    Each bucket is written by the task that shuffled it, so nothing is shuffled again.  Nulls and texts of any length stay as they are; an
    empty table writes no shard.
    """
    sharded(rows, shards, seed, bucket_bytes).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
