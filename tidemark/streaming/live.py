"""Series from event streams: buckets by watermark, and one-step forecasts as buckets close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucketed_stream(events: DataFrame, ts: str, width: str, late: str, value: Column, key: str) -> DataFrame:
    """(series_id, ts, y): tumbling buckets of a stream, in append mode; a bucket leaves once the watermark has passed its end."""
    timed = events.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)
    out = timed.groupBy(F.window("event_time", width).alias("w"), F.col(key).cast("string").alias("series_id")).agg(value.alias("y"))
    return out.select("series_id", F.col("w.start").alias("ts"), "y")


def forecast_buckets(buckets: DataFrame, coef: dict[str, list[float]]) -> DataFrame:
    """(series_id, ts, y, y_next): the forecast for the bucket after each, by an autoregression over a stream of closed buckets.

    Write ``bucketed_stream`` to a table and read that as a stream: state after an aggregation is not allowed within one query.

    ``coef``: for each series [const, phi_p .. phi_1].  The state of a series is its last p values; until there are p of them, and for
    series without coefficients, y_next is null.
    """
    p = max((len(c) - 1 for c in coef.values()), default=1)

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        beta = coef.get(key[0])
        for pdf in parts:
            rows = []
            for r in pdf.sort_values("ts").itertuples():
                held = [*held, float(r.y)][-p:]
                known = beta is not None and len(held) >= len(beta) - 1
                rows.append((key[0], r.ts, float(r.y), sum(b * x for b, x in zip(beta[1:], held[-(len(beta) - 1) :], strict=True)) + beta[0] if known else None))
            yield pd.DataFrame(rows, columns=["series_id", "ts", "y", "y_next"]).astype({"y_next": "float64"})
        state.update((held,))

    return buckets.groupBy("series_id").applyInPandasWithState(run, "series_id string, ts timestamp, y double, y_next double", "held array<double>", "append", "NoTimeout")
