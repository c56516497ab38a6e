"""Scalers: transforms, mostly affine ones, whose parameters are aggregates over a series.

``fit(x, of)`` builds them from aggregates passed through ``of``: over a window they become columns beside the series, with no
join and no second pass; with the identity they go into a groupBy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.symbolic import log1p
from tidemark.plans.spec import Aggregate, Scaler


def whole() -> WindowSpec:
    """All of a series."""
    return Window.partitionBy("series_id")


def _nonzero(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


#: Mean 0 and population standard deviation 1; a constant series is only shifted.  Scaled values lose their sign, so forecasts aren't clipped.
STANDARD = Scaler("standard", lambda x, of: (of(F.avg(x)), _nonzero(of(F.stddev_pop(x)))), keeps_sign=False)


def minmax(low: float = 0.0, high: float = 4.0) -> Scaler:
    """The range of a series onto [low, high]; a constant series gets ``low``."""

    def fit(x: Column, of: Aggregate) -> tuple[Column, Column]:
        scale = _nonzero(of(F.max(x)) - of(F.min(x))) / (high - low)
        return of(F.min(x)) - low * scale, scale

    return Scaler("minmax", fit)


def logarithmic() -> Scaler:
    """log(1 + x), then mean 0 and population standard deviation 1; forecasts come back as exp(z) - 1."""
    return Scaler("log", STANDARD.fit, keeps_sign=False, into=log1p, out_of=F.expm1)


def beside(x: Column, scaler: Scaler) -> tuple[Column, Column]:
    """Shift and scale of a column over its whole series, as window columns."""
    return scaler.fit(scaler.into(x), lambda a: a.over(whole()))


def fit_table(df: DataFrame, scaler: Scaler, columns: list[str]) -> DataFrame:
    """(series_id, name, shift, scale), one row for each series and column."""
    parts = {c: scaler.fit(scaler.into(F.col(c)), lambda a: a) for c in columns}
    aggs = [F.struct(F.lit(c).alias("name"), shift.alias("shift"), scale.alias("scale")).alias(c) for c, (shift, scale) in parts.items()]
    return df.groupBy("series_id").agg(*aggs).select("series_id", F.explode(F.array(*columns)).alias("s")).select("series_id", "s.*")


def scaled(x: Column, name: str, scaler: Scaler | None = None) -> Column:
    return ((x if scaler is None else scaler.into(x)) - F.col(f"{name}_shift")) / F.col(f"{name}_scale")


def unscaled(x: Column, name: str, scaler: Scaler | None = None) -> Column:
    back = x * F.col(f"{name}_scale") + F.col(f"{name}_shift")
    return back if scaler is None else scaler.out_of(back)
