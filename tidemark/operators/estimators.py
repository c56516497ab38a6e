"""Least squares and Yule-Walker.

Closed forms (one lag, Gram matrices, autocovariances) are hash aggregates and window columns.  General least squares over
many training windows runs once for each series: the Gram matrix of a window follows from that of the window before by adding
and removing a few rows, so a rolling validation costs about as much as one fit, and no row is replicated for the folds that hold it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.features import by_time, whole

#: Windows after which a rolling Gram matrix is summed anew, so that rounding does not add up.
REFRESH = 128


def ar1(series: DataFrame) -> DataFrame:
    """(series_id, const, phi, n): y on its lag by least squares, the first step left out."""
    rows = series.withColumn("x", F.lag("y", 1).over(by_time())).filter("x is not null")
    return rows.groupBy("series_id").agg(F.regr_intercept("y", "x").alias("const"), F.regr_slope("y", "x").alias("phi"), F.count(F.lit(1)).alias("n"))


def gram(rows: DataFrame, x: list[str], y: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, n, s_<i>, s_<i>_<j>): sums of x and y and of their products; the last index stands for y.

    One partial and one final aggregation, whatever the length of a series: the way to fit a series too long for one task.
    """
    cols = [F.col(c).cast("double") for c in [*x, y]]
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)]
    products = [F.sum(cols[i] * cols[j]).alias(f"s_{i}_{j}") for i, j in itertools.combinations_with_replacement(range(len(cols)), 2)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def solve_gram(sums: DataFrame, k: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, coef): intercept and k slopes from ``gram``, by least squares on the centred and scaled products; one row a key, so little goes to Python.

    Null where the design is not of full rank.
    """
    pairs = list(itertools.combinations_with_replacement(range(k + 1), 2))
    schema = T.StructType([*(sums.schema[c] for c in keys), T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.schema.names if c not in keys}
            coef = [centred_solution(columns["n"][r], np.array([columns[f"s_{i}"][r] for i in range(k + 1)]), {(i, j): columns[f"s_{i}_{j}"][r] for i, j in pairs}) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(coef, pa.list_(pa.float64()))], [*keys, "coef"])

    return sums.mapInArrow(run, schema)


def centred_solution(n: float, total: np.ndarray, products: dict[tuple[int, int], float]) -> list[float] | None:
    """[intercept, slopes] from a number of rows, sums and sums of products, the last index being the target's; None if not of full rank."""
    k = len(total) - 1
    mean, a = total / n, np.zeros((k + 1, k + 1))
    for (i, j), x in products.items():
        a[i, j] = a[j, i] = x - total[i] * total[j] / n
    size = np.sqrt(np.abs(np.diag(a)[:k]))
    if not np.isfinite(a).all() or n <= k or (size == 0).any():
        return None
    scaled = a[:k, :k] / np.outer(size, size)
    if np.linalg.cond(scaled) > 1e12:
        return None
    slope = np.linalg.solve(scaled, a[:k, k] / size) / size
    return [float(mean[k] - slope @ mean[:k]), *slope.tolist()]


def rolling_gram(rows: DataFrame, x: list[str], y: str, rc: int, growing: bool = False) -> DataFrame:
    """(series_id, fold, n, s_<i>, s_<i>_<j>): ``gram`` of every training window of a rolling validation, from (series_id, t, n, x, y).

    Rows are summed by blocks of steps that no window's edge cuts, and windows are differences of running sums over blocks: a long series is
    shared by many tasks until only its blocks are left.
    """
    size = F.floor(4 * F.col("n") / 5)
    block = F.struct(F.floor(F.col("t") / rc).alias("low"), F.floor((F.col("t") - size) / rc).alias("high"))
    marked = rows.withColumns({"block": block, "size": size, "steps": F.col("n")})
    sums = gram(marked, x, y, ("series_id", "block", "size", "steps"))
    names = [c for c in sums.columns if c not in ("series_id", "block", "size", "steps")]
    upto = Window.partitionBy("series_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.select("series_id", "block", "size", "steps", *(F.sum(c).over(upto).alias(c) for c in names))
    # the last block before a window's end, and for windows that slide the last before its beginning
    high, low = F.col("block.high") + 1, F.col("block.low") + 1
    folds = F.ceil((F.col("steps") - F.col("size")) / rc)
    held = F.struct("block", *names)
    ends = running.filter((high >= 0) & (high < folds)).groupBy("series_id", high.alias("fold")).agg(F.max(held).alias("upto"))
    if growing:
        return ends.select("series_id", F.col("fold").cast("long").alias("fold"), *(F.col(f"upto.{c}").alias(c) for c in names))
    begins = running.filter(low < folds).groupBy("series_id", low.alias("fold")).agg(F.max(held).alias("before"))
    both = ends.join(begins, ["series_id", "fold"], "left")
    return both.select("series_id", F.col("fold").cast("long").alias("fold"), *((F.col(f"upto.{c}") - F.coalesce(F.col(f"before.{c}"), F.lit(0))).alias(c) for c in names))


def yule_walker(series: DataFrame, p: int, adjusted: bool = False) -> DataFrame:
    """(series_id, const, phi_1 .. phi_p): autocovariances of the centred series in one aggregation, then Levinson-Durbin in columns.

    Lag k is divided by n, or by n - k if ``adjusted``.  A constant series gives null coefficients.
    """
    centre = series.withColumn("c", F.col("y") - F.avg("y").over(whole()))
    lags = centre.withColumns({f"c_{k}": F.lag("c", k).over(by_time()) for k in range(1, p + 1)})
    n = F.count(F.lit(1))
    cov = [(F.sum(F.col("c") * (F.col(f"c_{k}") if k else F.col("c"))) / (n - (k if adjusted else 0))).alias(f"r_{k}") for k in range(p + 1)]
    df = lags.groupBy("series_id").agg(F.avg("y").alias("mean"), *cov)
    df = df.withColumn("v", F.when(F.col("r_0") != 0, F.col("r_0")))
    phi: list[str] = []
    for m in range(1, p + 1):
        top = F.col(f"r_{m}")
        for i, name in enumerate(phi, 1):
            top = top - F.col(name) * F.col(f"r_{m - i}")
        df = df.withColumn(f"p_{m}_{m}", top / F.col("v"))
        last = F.col(f"p_{m}_{m}")
        df = df.withColumns({f"p_{m}_{i}": F.col(phi[i - 1]) - last * F.col(phi[m - 1 - i]) for i in range(1, m)} | {"v": F.col("v") * (1 - last * last)})
        phi = [f"p_{m}_{i}" for i in range(1, m + 1)]
    const = F.col("mean") * (1 - sum((F.col(x) for x in phi), F.lit(0.0)))
    return df.select("series_id", const.alias("const"), *[F.col(x).alias(f"phi_{i}") for i, x in enumerate(phi, 1)])


# kernels for one series


def least_squares(x: np.ndarray, y: np.ndarray, method: str = "sm_ols") -> np.ndarray:
    """Intercept and slopes, one column for each target; of several solutions the one of least norm, intercept included ("sm_ols") or not ("sk_lr").  NaN in, NaN out."""
    if not np.isfinite(x).all() or not np.isfinite(y).all() or not len(x):
        return np.full((x.shape[1] + 1, y.shape[1]), np.nan)
    if method == "sk_lr":
        mx, my = x.mean(0), y.mean(0)
        slope = np.linalg.lstsq(x - mx, y - my, rcond=None)[0]
        return np.vstack([my - mx @ slope, slope])
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def rolling_least_squares(x: np.ndarray, y: np.ndarray, windows: list[tuple[int, int]], method: str = "sm_ols") -> list[np.ndarray]:
    """``least_squares`` over rows [lo, hi) of each window.

    Columns are standardised once, which leaves full-rank solutions as they are and keeps Gram matrices well conditioned.  Windows that are
    ill conditioned or not finite, and short ones, are solved from their rows.
    """
    k = x.shape[1]
    if len(windows) == 1 or not np.isfinite(x).all() or not np.isfinite(y).all():
        return [least_squares(x[a:b], y[a:b], method) for a, b in windows]
    mx, my = x.mean(0), y.mean(0)
    sx = x.std(0)
    sx[sx == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mx) / sx, y - my])
    out, total, at, age = [], None, (0, 0), 0
    for lo, hi in windows:
        if total is None or age >= REFRESH or lo < at[0] or hi < at[1] or lo >= at[1]:
            total, age = z[lo:hi].T @ z[lo:hi], 0
        else:
            new, old = z[at[1] : hi], z[at[0] : lo]
            total = total + new.T @ new - old.T @ old
            age += 1
        at = (lo, hi)
        left, right = total[: k + 1, : k + 1], total[: k + 1, k + 1 :]
        if hi - lo <= k + 1 or np.linalg.cond(left) > 1e8:
            out.append(least_squares(x[lo:hi], y[lo:hi], method))
            continue
        beta = np.linalg.solve(left, right)
        slope = beta[1:] / sx[:, None]
        out.append(np.vstack([beta[0] + my - mx @ slope, slope]))
    return out


def yule_walker_kernel(y: np.ndarray, p: int, adjusted: bool) -> np.ndarray:
    """[const, phi_p .. phi_1] of a stretch of a series, in the order of a design matrix."""
    n = len(y)
    c = y - y.mean()
    r = np.array([c[: n - k] @ c[k:] / (n - (k if adjusted else 0)) for k in range(p + 1)])
    try:
        phi = np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))], r[1:])
    except np.linalg.LinAlgError:
        phi = np.full(p, np.nan)
    return np.concatenate([[y.mean() * (1 - phi.sum())], phi[::-1]])


def fold_list(n: int, tr_size: int, rc: int, growing: bool) -> list[tuple[int, int, int, int]]:
    """(train_lo, train_hi, test_lo, test_hi) of the folds of a rolling validation, half open."""
    return [(0 if growing else i, tr_size + i, tr_size + i, min(tr_size + i + rc, n)) for i in range(0, n - tr_size, rc)]


class Kernel(Protocol):
    """What fits one training window, for models of one's own: a function of rows of the design (without intercept) and of the targets, the oldest first.

    It returns the intercept and the slopes, one column for each target.
    """

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...


#: Kernels by name.  "sm_ols" and "sk_lr" are least squares; for autoregressions "ar_ols" (rows with all their lags in the window only), "mle" and "adjusted" (Yule-Walker).
KERNELS = ("sm_ols", "sk_lr", "ar_ols", "mle", "adjusted")


def _coefficients(design: np.ndarray, target: np.ndarray, parts: list[tuple[int, int, int, int]], kernel: str | Kernel, p: int, lost: int) -> list[np.ndarray]:
    """Of each training window: intercept and slopes, one column for each target."""
    if kernel in ("mle", "adjusted"):
        return [yule_walker_kernel(target[a:b, 0], p, kernel == "adjusted")[:, None] for a, b, _, _ in parts]
    head = p if kernel == "ar_ols" else 0
    windows = [(min(a + head, b), max(b - lost, min(a + head, b))) for a, b, _, _ in parts]
    if callable(kernel):
        found = [np.asarray(kernel(design[a:b], target[a:b]), np.float64) for a, b in windows]
        shape = (design.shape[1] + 1, target.shape[1])
        if any(f.shape != shape for f in found):
            raise ValueError(f"a kernel returns an array of {shape}")
        return found
    return rolling_least_squares(design, target, windows, "sm_ols" if kernel == "ar_ols" else kernel)


def _parts(n: int, folds: dict | None) -> list[tuple[int, int, int, int]]:
    return [(0, n, 0, n)] if folds is None else fold_list(n, 4 * n // 5, folds["rc"], folds["growing"])


def _matrix(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([rows[c].to_numpy() for c in names]).astype(np.float64, copy=False) if rows.num_rows else np.zeros((0, len(names)))


def fit_series(rows: DataFrame, x: list[str], y: list[str], folds: dict | None, kernel: str | Kernel, p: int, leak_free: bool = False) -> DataFrame:
    """(series_id, fold, train_lo, train_hi, test_lo, test_hi, coef): coefficients, one array for each target, of every training window.

    ``folds``: None for one window over the whole series, else {"rc", "growing"}.  ``kernel``: one of KERNELS, or a function of one's own.  A series is
    handled in one task, series by series side by side.
    """
    columns = rows.select("series_id", "t", *(F.col(f"`{c}`").cast("double").alias(f"x_{i}") for i, c in enumerate(x)), *(F.col(c).cast("double").alias(f"y_{i}") for i, c in enumerate(y)))
    lost = len(y) - 1 if leak_free else 0
    nx, ny = [f"x_{i}" for i in range(len(x))], [f"y_{i}" for i in range(len(y))]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t").combine_chunks()
        parts = _parts(rows.num_rows, folds)
        found = _coefficients(_matrix(rows, nx), _matrix(rows, ny), parts, kernel, p, lost)
        # Arrow keeps NaN apart from null, which pandas would not
        limits = [pa.array([f[i] for f in parts], pa.int64()) for i in range(4)]
        coef = pa.array([b.T.tolist() for b in found], pa.list_(pa.list_(pa.float64())))
        sid = pa.array([rows["series_id"][0].as_py()] * len(parts), pa.string())
        return pa.Table.from_arrays([sid, pa.array(range(len(parts)), pa.int64()), *limits, coef], ["series_id", "fold", "train_lo", "train_hi", "test_lo", "test_hi", "coef"])

    return columns.groupBy("series_id").applyInArrow(run, "series_id string, fold long, train_lo long, train_hi long, test_lo long, test_hi long, coef array<array<double>>")


def fitted_rows(rows: DataFrame, x: list[str], y: list[str], folds: dict | None, kernel: str | Kernel, p: int, carry: list[str], leak_free: bool = False) -> DataFrame:
    """(series_id, t, fold, coef, x, carry): the rows of every test part beside the coefficients of its training window.

    One pass: the design is computed once, for the fit and for what is forecast from it.
    """
    names = list(dict.fromkeys([*x, *carry]))
    given = rows.select("series_id", "t", *(F.col(f"`{c}`").cast("double").alias(f"x_{i}") for i, c in enumerate(names)), *(F.col(c).cast("double").alias(f"y_{i}") for i, c in enumerate(y)))
    lost = len(y) - 1 if leak_free else 0
    nx, ny = [f"x_{names.index(c)}" for c in x], [f"y_{i}" for i in range(len(y))]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t").combine_chunks()
        parts = _parts(rows.num_rows, folds)
        found = _coefficients(_matrix(rows, nx), _matrix(rows, ny), parts, kernel, p, lost)
        first = parts[0][2] if parts else rows.num_rows
        fold = np.repeat(np.arange(len(parts)), [hi - lo for _, _, lo, hi in parts])
        test = rows.slice(first).select(["series_id", "t", *(f"x_{i}" for i in range(len(names)))])
        coef = pa.array([b.T.tolist() for b in found], pa.list_(pa.list_(pa.float64()))).take(pa.array(fold))
        return test.append_column("fold", pa.array(fold, pa.int64())).append_column("coef", coef)

    schema = "series_id string, t long, " + "".join(f"x_{i} double, " for i in range(len(names))) + "fold long, coef array<array<double>>"
    out = given.groupBy("series_id").applyInArrow(run, schema)
    return out.select("series_id", "t", "fold", "coef", *(F.col(f"x_{i}").alias(c) for i, c in enumerate(names)))
