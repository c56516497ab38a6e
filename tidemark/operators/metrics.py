"""Forecast metrics as partial and final hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("mse", "mae", "r2", "r2bar", "smape", "m")


def aggregates(y: Column, yhat: Column, k: int = 1) -> list[Column]:
    """mse, mae, r2 (0 for a constant series), r2bar (NaN with too few rows), smape in percent, and m, the rows that count.

    NaN anywhere gives NaN; rows with a null on either side don't count.
    """
    both = y.isNotNull() & yhat.isNotNull()
    y, yhat = F.when(both, y), F.when(both, yhat)
    off = y - yhat
    m = F.count(off)
    sst = F.var_pop(y) * m
    r2 = F.when(sst == 0, F.lit(0.0)).otherwise(1 - F.sum(off * off) / sst)
    r2bar = F.when(m <= k + 1, F.lit(float("nan"))).otherwise(1 - (1 - r2) * (m - 1) / (m - k - 1))
    smape = 100 * F.avg(2 * F.abs(off) / (F.abs(y) + F.abs(yhat) + F.lit(1e-10)))
    return [F.avg(off * off).alias("mse"), F.avg(F.abs(off)).alias("mae"), r2.alias("r2"), r2bar.alias("r2bar"), smape.alias("smape"), m.alias("m")]


def by_horizon(pairs: DataFrame, k: int = 1) -> DataFrame:
    """(series_id, h, metrics) from (series_id, h, y, y_hat)."""
    return pairs.groupBy("series_id", "h").agg(*aggregates(F.col("y"), F.col("y_hat"), k))


def fit_map(metrics: DataFrame, horizons: int) -> DataFrame:
    """The report's layout: a row for each series and metric, a column h1 .. h{horizons} for each horizon."""
    long = metrics.select("series_id", "h", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in METRICS])).alias("s"))
    out = long.select("series_id", "h", "s.*").groupBy("series_id", "metric").pivot("h", list(range(1, horizons + 1))).agg(F.first("value"))
    return out.toDF("series_id", "metric", *[f"h{h}" for h in range(1, horizons + 1)])


def report(metrics: DataFrame) -> DataFrame:
    """(series_id, h, line): the metrics of a horizon as a line of text, numbers with four digits, separated by tabs."""
    parts = [F.format_string(f"{c.upper()}: %.4f", F.col(c).cast("double")) for c in METRICS[:-1]]
    return metrics.select("series_id", "h", F.concat_ws("\t", F.format_string("h: %d", "h"), *parts, F.format_string("M: %d", "m")).alias("line"))
