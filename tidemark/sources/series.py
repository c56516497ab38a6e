"""Sources of series.

A series table is long: series_id (string), t (bigint, 0 .. n-1 within a series), y (double) and exogenous columns x1, x2, ...
Every operator downstream partitions by series_id, so one shuffle on it serves a whole model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: series_id of a table that holds one series only.
SINGLE = "_"


def to_series(df: DataFrame, time: Column | str, value: Column | str, key: Column | str | None = None, exo: Sequence[Column | str] = ()) -> DataFrame:
    """A series table from rows that are already regular: one row a step.  t is the rank by ``time``; nulls become 0, as missing values are encoded."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    number = lambda c: F.coalesce(col(c).cast("double"), F.lit(0.0))
    sid = F.lit(SINGLE) if key is None else F.coalesce(col(key).cast("string"), F.lit(SINGLE))
    base = df.select(sid.alias("series_id"), col(time).alias("ts"), number(value).alias("y"), *[number(x).alias(f"x{i}") for i, x in enumerate(exo, 1)])
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("ts")).cast("long") - 1
    return base.select("series_id", rank.alias("t"), "y", *[f"x{i}" for i in range(1, len(exo) + 1)])


def bucketed(df: DataFrame, ts: str, grain: str, value: Column, key: str | None = None, exo: Sequence[Column] = (), fill: bool = False) -> DataFrame:
    """A series table from events: ``value`` and ``exo`` are aggregates by ``grain`` (hour, day, week, month).

    Buckets without events are left out, so t counts those observed; ``fill`` puts them in with zeros instead.  Aggregation is partial
    before it is shuffled; the ranking then shuffles one row a bucket.
    """
    sid = F.lit(SINGLE) if key is None else F.coalesce(F.col(key).cast("string"), F.lit(SINGLE))
    bucket = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz")
    aggs = [value.alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(exo, 1)]]
    out = df.filter(F.col(ts).isNotNull()).groupBy(sid.alias("series_id"), bucket.alias("ts")).agg(*aggs)
    if fill:
        step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[grain]
        span = out.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        spine = span.select("series_id", F.explode(F.expr(f"sequence(a, b, {step})")).alias("ts"))
        out = spine.join(out, ["series_id", "ts"], "left")
    return to_series(out, "ts", "y", "series_id", [f"x{i}" for i in range(1, len(exo) + 1)])


def prefix(series: DataFrame, n: int) -> DataFrame:
    """The first n steps of each series."""
    return series.filter(F.col("t") < n)


def read_csv(spark: SparkSession, path: str, time: str, value: str, exo: Sequence[str] = (), date_format: str = "M/d/yyyy", first: int | None = None) -> DataFrame:
    """A single series from a CSV file with a header; only the named columns are parsed.

    The schema is explicit: the header line gives the names, the time column is a date in ``date_format`` and all others are doubles.
    """
    header = spark.read.text(path).first()[0].split(",")
    schema = T.StructType([T.StructField(c.strip(), T.DateType() if c.strip() == time else T.DoubleType()) for c in header])
    df = spark.read.schema(schema).option("header", True).option("dateFormat", date_format).csv(path).select(time, value, *exo)
    out = to_series(df, time, value, None, list(exo))
    return out if first is None else prefix(out, first)


def train_test(series: DataFrame, share: float | None = None, split: bool = True) -> DataFrame:
    """``series`` with n, tr_size, is_train, is_test: a sequential split.

    The last fifth is for testing: tr_size is (4 n) div 5.  With ``share``, the test part is ceil(share * n).  Without ``split`` all steps are for
    training and all for testing.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    size = F.floor(4 * F.col("n") / 5) if share is None else F.col("n") - F.ceil(F.lit(float(share)) * F.col("n"))
    size = size if split else F.col("n")
    is_train = F.col("t") < F.col("tr_size")
    return series.withColumn("n", n).withColumn("tr_size", size.cast("long")).withColumns({"is_train": is_train, "is_test": ~is_train if split else F.lit(True)})


def batches(series: DataFrame, size: int) -> DataFrame:
    """``series`` with ``batch``: consecutive steps in groups of ``size``, unshuffled."""
    return series.withColumn("batch", F.floor(F.col("t") / size).cast("long"))


# series from the benchmark tables


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event type: the sum of values in an hour, and the number of events as exogenous series."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    return bucketed(events, "ts", "hour", F.round(F.sum("value"), 4), "event_type", [F.count(F.lit(1)).cast("double")])


def orders_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority: the number of orders in a week, and their mean price in thousands as exogenous series."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_orderpriority", "o_totalprice")
    return bucketed(orders, "o_orderdate", "week", F.count(F.lit(1)).cast("double"), "o_orderpriority", [F.round(F.avg("o_totalprice") / 1000, 3)])


def ship_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By return flag: the quantity shipped in a week, in hundreds, and its value in millions as exogenous series."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice")
    return bucketed(items, "l_shipdate", "week", F.round(F.sum("l_quantity") / 100, 2), "l_returnflag", [F.round(F.sum("l_extendedprice") / 1000000, 4)])
