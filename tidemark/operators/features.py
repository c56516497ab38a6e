"""Features of series: everything that a row needs comes from one window over its series, so a design matrix costs one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators import scaling
from tidemark.operators.scaling import whole
from tidemark.plans.spec import ModelSpec, Scaler


def by_time() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("t")


def lagged(x: Column, k: int) -> Column:
    """x at t - k; before the series begins, its first value."""
    if k < 1:
        raise ValueError("a lag is at least 1")
    return F.when(F.col("t") < k, F.first(x).over(by_time().rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.lag(x, k).over(by_time()))


def lag_matrix(series: DataFrame, lag: int, column: str = "y") -> DataFrame:
    """Columns <column>_lag{lag} .. <column>_lag1, the oldest first."""
    if lag < 1:
        raise ValueError("a lag matrix needs a lag of at least 1")
    return series.withColumns({f"{column}_lag{k}": lagged(F.col(column), k) for k in range(lag, 0, -1)})


def lead_matrix(series: DataFrame, horizons: int, column: str = "y") -> DataFrame:
    """Columns <column>_h1 .. h{horizons}: the value i - 1 steps ahead, 0 past the end."""
    return series.withColumns({f"{column}_h{i + 1}": F.lead(column, i, 0.0).over(by_time()) for i in range(max(horizons, 1))})


def trend(spec: int, lwave: int = 20, t: str = "t") -> dict[str, Column]:
    """trend_1 .. trend_{spec-1}: linear, quadratic, sine, cosine."""
    if not 1 <= spec <= 5:
        raise ValueError("trend must lie between 1 and 5")
    m, at = F.count(F.lit(1)).over(whole()).cast("double"), F.col(t).cast("double")
    angle = 2 * F.pi() * at / float(lwave)
    terms = [at / m, (at - m / 2) * (at - m / 2) / ((m / 2) * (m / 2)), F.sin(angle), F.cos(angle)]
    return {f"trend_{i}": x for i, x in enumerate(terms[: spec - 1], 1)}


def trend_matrix(series: DataFrame, spec: int, lwave: int = 20) -> DataFrame:
    return series.withColumns(trend(spec, lwave))


def backcast(column: str) -> Column:
    """What may have come before a value: two thirds of it and one third of the next one; past the end of a series the next one is 0."""
    return F.lead(column, 1, 0.0).over(by_time()) / 3 + 2 * F.col(column) / 3


def backfilled(column: str) -> Column:
    """Leading zeros replaced by a geometric decay towards the past, a third for each step; a series of zeros stays as it is."""
    seen = F.when(F.col(column) != 0, F.col("t"))
    t0 = F.min(seen).over(whole())
    v0 = F.min_by(column, seen).over(whole())
    return F.when(F.col("t") < t0, v0 * F.pow(F.lit(3.0), (F.col("t") - t0).cast("double"))).otherwise(F.col(column))


def backfill(series: DataFrame, columns: list[str]) -> DataFrame:
    return series.withColumns({c: backfilled(c) for c in columns})


def bases(series: DataFrame, spec: ModelSpec) -> DataFrame:
    """The columns that lags are taken of, as base_<block>: scaled series, functions of it, exogenous series, theirs, and cross terms.

    The y column is kept as it is, base_y is the target.  <block>_shift and <block>_scale undo the scaling of endogenous blocks.
    Exogenous series are backfilled first; functions see unscaled values; cross terms are the scaled series times the backfilled one.
    """
    xs = [f"x{j}" for j in range(1, spec.n_exo + 1)]
    df = series.withColumns({f"b_{x}": backfilled(x) for x in xs}) if xs else series
    raw: dict[str, Column] = {"y": F.col("y")} | {f"f{k}_y": f(F.col("y")) for k, f in enumerate(spec.endo_fns or (), 1)}
    df = df.withColumns({f"raw_{b}": c for b, c in raw.items()})
    df = _scaled(df, spec.scaler, list(raw))
    if not xs:
        return df
    out = {x: F.col(f"b_{x}") for x in xs}
    if spec.endo_fns is not None:
        out |= {f"g{i}_{x}": g(F.col(f"b_{x}")) for i, g in enumerate(spec.exo_fns, 1) for x in xs}
        if spec.cross:
            out |= {f"c{j}": F.col("base_y") * F.col(f"b_{x}") for j, x in enumerate(xs, 1)}
    df = df.withColumns({f"raw_{b}": c for b, c in out.items()})
    return _scaled(df, spec.scaler, list(out)).drop(*[f"b_{x}" for x in xs])


def _scaled(df: DataFrame, scaler: Scaler | None, blocks: list[str]) -> DataFrame:
    if scaler is None:
        return df.withColumns({f"{b}_{k}": F.lit(v) for b in blocks for k, v in (("shift", 0.0), ("scale", 1.0))}).withColumnsRenamed({f"raw_{b}": f"base_{b}" for b in blocks})
    limits = {}
    for b in blocks:
        limits[f"{b}_shift"], limits[f"{b}_scale"] = scaling.beside(F.col(f"raw_{b}"), scaler)
    return df.withColumns(limits).withColumns({f"base_{b}": scaling.scaled(F.col(f"raw_{b}"), b, scaler) for b in blocks}).drop(*[f"raw_{b}" for b in blocks])


def design_matrix(series: DataFrame, spec: ModelSpec) -> DataFrame:
    """``bases`` with the design columns of the specification, in its order, and n, the length of the series.  Given columns stay as they are."""
    df = bases(series, spec)
    if spec.given is not None:
        return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in spec.given} | {"n": F.count(F.lit(1)).over(whole())})
    lags = {f"{b}_lag{k}": lagged(F.col(f"base_{b}"), k) for blocks, m in ((spec.endo_blocks, spec.p), (spec.exo_blocks, spec.q)) for b in blocks for k in range(m, 0, -1)}
    return df.withColumns(trend(spec.trend, spec.lwave) | lags | {"n": F.count(F.lit(1)).over(whole())})


def carried(block: str, q: int, h: int, fill: bool = True) -> list[Column]:
    """An exogenous block as horizon h knows it, oldest lag first: what lies in the future is the last known value.

    Beyond q, ``fill=False`` gives zeros instead.
    """
    if h > q and not fill:
        return [F.lit(0.0)] * q
    return [F.col(f"{block}_lag{max(1, k - (h - 1))}") for k in range(q, 0, -1)]
