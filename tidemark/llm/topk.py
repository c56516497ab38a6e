"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

The candidates' Gram matrix (dimensions squared, whatever the number of rows) is summed in the cluster; its eigenvectors
are the right singular vectors of the candidates.  Rotated by them, inner products stay the same and the first
coordinates hold most of a vector's length.  Candidates are written once, in ranges of descending length.  Queries are sent in blocks of
bounded bytes and meet the candidates where these lie, so no candidate is shuffled again:

* a query's k-th best among the longest candidates of all, a set of fixed size, is a floor: candidates shorter than floor / |q| can't
  enter.  Queries are sent in the order of that length, and a block reads only candidates that reach the least one in it;
* within a task candidates go by descending length, a few hundred at a time: with |q||c| below the query's k-th best score so far, neither this
  candidate nor any later one can enter;
* else the sum over the first rotated coordinates plus the product of the residual lengths must reach it;
* survivors get the exact integer product of the unrotated vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Bytes of a block of queries; candidates and queries scored at once; the longest candidates, which give the floors.
BLOCK_BYTES, STRIDE, AT_ONCE, LONGEST = 32 << 20, 512, 1024, 512


def quantised(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a double; vectors that are null or hold null, NaN or infinity are left out."""
    parts = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    # NaN and infinities are tested before floor, which would turn them into numbers
    sound = F.forall(F.col(column), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.filter(F.col(column).isNotNull() & sound).select(F.col(key).cast("long").alias("vec_id"), parts.alias("v"))


def _gram(candidates: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                m = _matrix(pdf["v"], width)
                total += m.T @ m
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    parts = candidates.select("v").mapInPandas(run, "i int, row array<double>")
    by_row = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((width, width))
    for r in by_row.collect():  # width squared numbers
        out[r["i"], r["j"]] = r["x"]
    return out


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _floors(q: np.ndarray, q_id: np.ndarray, seed: np.ndarray, seed_id: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the seed set; -inf if that has too few."""
    if len(seed) <= k:
        return np.full(len(q), -np.inf)
    first = np.where(seed_id[None, :] == q_id[:, None], -np.inf, q @ seed.T)
    return np.partition(first, -k, axis=1)[:, -k]


class Search:
    """The k best candidates of a block of queries, as candidates come by descending length, a batch at a time."""

    def __init__(self, q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int):
        self.q, self.q_id, self.floor, self.rotation, self.k = q, q_id, floor, rotation, k
        width = q.shape[1]
        self.head = min(width, max(4, width // 4))
        rotated = q @ rotation
        self.q_head, self.q_rest = rotated[:, : self.head], np.sqrt((rotated[:, self.head :] ** 2).sum(1))
        self.q_len = np.sqrt((q * q).sum(1))
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), -1, np.int64)

    def see(self, c: np.ndarray, c_id: np.ndarray) -> None:
        length = np.sqrt((c * c).sum(1))
        order = np.lexsort((c_id, -length))
        c, c_id, length = c[order], c_id[order], length[order]
        rotated = c @ self.rotation
        c_head, c_rest = rotated[:, : self.head], np.sqrt((rotated[:, self.head :] ** 2).sum(1))
        for a in range(0, len(c), STRIDE):
            part = slice(a, a + STRIDE)
            # scores are whole numbers, so half of one is more than rounding in the rotated sums can amount to
            least = np.maximum(self.floor, self.score[:, -1]) - 0.5
            active = np.flatnonzero(self.q_len * length[a] >= least)
            if not len(active):
                break
            for b in range(0, len(active), AT_ONCE):
                self._score(active[b : b + AT_ONCE], least, c[part], c_id[part], c_head[part], c_rest[part])

    def _score(self, active: np.ndarray, least: np.ndarray, c: np.ndarray, name: np.ndarray, c_head: np.ndarray, c_rest: np.ndarray) -> None:
        bound = self.q_head[active] @ c_head.T + self.q_rest[active, None] * c_rest[None, :]
        may = bound >= least[active, None]
        some, cols = may.any(1), may.any(0)
        rows = active[some]
        if not len(rows):
            return
        k, names = self.k, name[cols]
        exact = np.where((names[None, :] != self.q_id[rows, None]) & may[np.ix_(some, cols)], self.q[rows] @ c[cols].T, -np.inf)
        # what does not reach the floor is left out: the seeds, which do, are candidates like any others
        exact[exact < self.floor[rows, None] - 0.5] = -np.inf
        pool = np.concatenate([self.score[rows], exact], 1)
        pool_id = np.concatenate([self.ids[rows], np.broadcast_to(names, (len(rows), len(names)))], 1)
        if pool.shape[1] > 4 * k:  # only what reaches the k-th best is sorted; ties stay
            kth = np.partition(pool, -k, axis=1)[:, -k]
            reach = pool >= kth[:, None]
            most = int(reach.sum(1).max())
            if most < pool.shape[1]:
                pick = np.argsort(~reach, axis=1, kind="stable")[:, :most]
                pool, pool_id = np.take_along_axis(pool, pick, 1), np.take_along_axis(pool_id, pick, 1)
        top = np.lexsort((pool_id, -pool), axis=1)[:, :k]
        self.score[rows], self.ids[rows] = np.take_along_axis(pool, top, 1), np.take_along_axis(pool_id, top, 1)


def _reaches(queries: DataFrame, width: int, seed: np.ndarray, seed_id: np.ndarray, k: int) -> DataFrame:
    """``queries`` (vec_id, v) with ``floor`` and ``reach``, the least length a candidate of theirs must have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = _matrix(pdf["v"], width)
            floor = _floors(q, pdf["vec_id"].to_numpy(), seed, seed_id, k)
            length = np.sqrt((q * q).sum(1))
            # a hair less than the quotient, so that rounding loses nobody; where floor is not positive any length will do
            reach = np.where(floor - 0.5 > 0, (floor - 0.5) / np.where(length > 0, length, 1.0) * (1 - 1e-9), 0.0)
            yield pdf.assign(floor=floor, reach=reach)

    return queries.mapInPandas(run, "vec_id long, v array<double>, floor double, reach double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k highest inner products with all other rows, ties to the smaller id.

    ``vectors`` has vec_id and v, an array of whole numbers held as doubles without null.  A row with the query's id is no
    candidate; where an id comes more than once, each of its rows is a candidate of the others, and the smallest vector
    (by components) asks.  Rows without id are left out.  Vectors of unequal length are compared over their common dimensions.  Fewer than k
    candidates give fewer rows; no vectors, or no queries, give none.
    """
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    own = vectors.filter("vec_id is not null").select("vec_id", "v", length.alias("length"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    held = staged(own.repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id"), "topk")
    n, width, asked = held.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if("asks")).first()
    if not n or not width or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    _, rotation = np.linalg.eigh(_gram(held, width))
    rotation = np.ascontiguousarray(rotation[:, ::-1])
    longest = held.orderBy(F.desc("length"), "vec_id").limit(LONGEST).select("vec_id", "v").toPandas()
    seed, seed_id = _matrix(longest["v"], width), longest["vec_id"].to_numpy()
    queries = _reaches(held.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v")), width, seed, seed_id, k)
    queries = staged(queries.repartitionByRange(F.desc("reach"), "vec_id"), "topk-queries")
    per_block = max(1, block_bytes // (8 * width))
    blocks = -(-asked // per_block)
    # the cuts between blocks: quantiles of the reach; ties may make some block larger, so a hash splits those that are
    cuts = sorted(set(queries.approxQuantile("reach", [i / blocks for i in range(1, blocks)], 0.25 / blocks))) if blocks > 1 else []
    near = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = queries.filter((F.lit(True) if low is None else F.col("reach") > low) & (F.lit(True) if high is None else F.col("reach") <= high))
        parts = max(1, -(-inside.count() // per_block)) if blocks > 1 else 1
        for part in range(parts):
            block = inside.filter(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(parts)) == part).select("vec_id", "v", "floor", "reach").toPandas()
            if not len(block):
                continue
            found = staged(_found(held, block, width, rotation, k), "topk-found")
            near = found if near is None else near.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(held: DataFrame, block: pd.DataFrame, width: int, rotation: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query of a block within each task's candidates, those below its floor left out."""
    q, q_id, floor = _matrix(block["v"], width), block["vec_id"].to_numpy(), block["floor"].to_numpy()
    sent = held.sparkSession.sparkContext.broadcast((q, q_id, floor, rotation))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(*sent.value, k)
        for pdf in batches:
            if len(pdf):
                search.see(_matrix(pdf["v"], width), pdf["vec_id"].to_numpy())
        i, j = np.nonzero(np.isfinite(search.score))
        yield pd.DataFrame({"query_id": search.q_id[i], "vec_id": search.ids[i, j], "score": search.score[i, j].astype(np.int64)})

    # files are in ranges of length, so what is too short is not even read
    return held.filter(F.col("length") >= float(block["reach"].min())).select("vec_id", "v").mapInPandas(run, "query_id long, vec_id long, score long")
