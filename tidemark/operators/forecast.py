"""Multi-horizon forecasts from rows that hold a design matrix and ``coef``, an array of coefficients for each target.

Row t, horizon h (from 1) forecasts the value at t + h - 1 from what is known through t - 1.  Everything is Column arithmetic: one projection for
each horizon, so a recursive forecast stays in generated code and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.symbolic import clip_negative
from tidemark.operators import scaling
from tidemark.operators.features import by_time, carried
from tidemark.plans.spec import ModelSpec


def _beta(target: int, i: int) -> Column:
    return F.col("coef")[target][i]


def _known(spec: ModelSpec, h: int, target: int, carry: bool) -> Column:
    """Intercept, trend (as it is at the origin) and exogenous terms."""
    out, at = _beta(target, 0), 1
    for c in spec.trend_columns:
        out, at = out + _beta(target, at) * F.col(c), at + 1
    at += spec.p * len(spec.endo_blocks)
    for block in spec.exo_blocks:
        for x in carried(block, spec.q, h if carry else 1):
            out, at = out + _beta(target, at) * x, at + 1
    return out


def recursive(rows: DataFrame, spec: ModelSpec, clip: bool | None = None) -> DataFrame:
    """Columns s_1 .. s_H: each horizon is fed the forecasts of those before, clipped; exogenous values stay at the last one known."""
    clips = spec.clips if clip is None else clip
    df = rows
    for h in range(1, spec.horizons + 1):
        out, at = _known(spec, h, 0, True), 1 + len(spec.trend_columns)
        for block in spec.endo_blocks:
            for k in range(spec.p, 0, -1):
                value = F.col(f"{block}_lag{k - h + 1}") if k >= h else F.col(f"v_{block}_{h - k}")
                out, at = out + _beta(0, at) * value, at + 1
        df = df.withColumn(f"s_{h}", clip_negative(out) if clips else out)
        if h < spec.horizons:
            seen = {"v_y_" + str(h): F.col(f"s_{h}")}
            for k, f in enumerate(spec.endo_fns or (), 1):
                seen[f"v_f{k}_y_{h}"] = scaling.scaled(f(scaling.unscaled(F.col(f"s_{h}"), "y", spec.scaler)), f"f{k}_y", spec.scaler)
            df = df.withColumns(seen)
    return df.drop(*[f"v_{b}_{h}" for b in spec.endo_blocks for h in range(1, spec.horizons)])


def direct(rows: DataFrame, spec: ModelSpec) -> DataFrame:
    """Columns s_1 .. s_H: each horizon has its own coefficients over the same features."""
    out = {}
    for h in range(1, spec.horizons + 1):
        x, at = _known(spec, h, h - 1, False), 1 + len(spec.trend_columns)
        for block in spec.endo_blocks:
            for k in range(spec.p, 0, -1):
                x, at = x + _beta(h - 1, at) * F.col(f"{block}_lag{k}"), at + 1
        out[f"s_{h}"] = clip_negative(x) if spec.clips else x
    return rows.withColumns(out)


def of_given(rows: DataFrame, spec: ModelSpec) -> DataFrame:
    """Columns s_1 .. s_H from given feature columns: each horizon has its own coefficients."""
    out = {}
    for h in range(1, spec.horizons + 1):
        x = _beta(h - 1, 0)
        for at, c in enumerate(spec.given, 1):
            x = x + _beta(h - 1, at) * F.col(f"`{c}`")
        out[f"s_{h}"] = clip_negative(x) if spec.clips else x
    return rows.withColumns(out)


def unscaled(rows: DataFrame, spec: ModelSpec) -> DataFrame:
    """(series_id, fold, t, y, yf_1 .. yf_H) in the units of the series."""
    return rows.select("series_id", "fold", "t", "y", *[scaling.unscaled(F.col(f"s_{h}"), "y", spec.scaler).alias(f"yf_{h}") for h in range(1, spec.horizons + 1)])


def with_actuals(forecasts: DataFrame, horizons: int) -> DataFrame:
    """(series_id, origin_t, h, target_t, y, y_hat): the long form; forecasts beyond the end of the series have no actual and are left out."""
    truth = forecasts.withColumns({f"a_{h}": F.lead("y", h - 1).over(by_time()) for h in range(1, horizons + 1)})
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"a_{h}").alias("y"), F.col(f"yf_{h}").alias("y_hat")) for h in range(1, horizons + 1)])
    long = truth.select("series_id", F.col("t").alias("origin_t"), F.explode(pairs).alias("s")).select("series_id", "origin_t", "s.*").filter("y is not null")
    return long.select("series_id", "origin_t", "h", (F.col("origin_t") + F.col("h") - 1).alias("target_t"), "y", "y_hat")


def matrix(series: DataFrame, forecasts: DataFrame, horizons: int) -> DataFrame:
    """(series_id, t, y, yf_1 .. yf_H) for every step; 0 where nothing was forecast."""
    names = [f"yf_{h}" for h in range(1, horizons + 1)]
    both = series.select("series_id", "t", "y").join(forecasts.select("series_id", "t", *names), ["series_id", "t"], "left")
    return both.select("series_id", "t", "y", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
