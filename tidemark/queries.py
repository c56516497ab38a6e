"""Queries over the benchmark tables, one or more for each operator, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import oracle
from tidemark.functions import symbolic
from tidemark.operators import estimators, features, forecast, metrics, neural, scaling
from tidemark.oracle import BY_TIME, WHOLE, ModelSql, ctes, lag, rounded
from tidemark.plans import models
from tidemark.plans.spec import ModelSpec
from tidemark.sources import series as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _round(names: list[str], digits: int = 6) -> list[Column]:
    return [(F.round(n, digits) + F.lit(0.0)).alias(n) for n in names]


def _show(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select("series_id", "t", *_round(names, digits))


# sources, slices, splits
for _name in ("events_hourly", "orders_weekly", "ship_weekly"):
    _add(f"source_{_name}", getattr(sources, _name), f"{ctes(oracle.series(_name))} SELECT * FROM s")
_add("prefix_rows", lambda s, d: sources.prefix(sources.orders_weekly(s, d), 116), f"{ctes(oracle.series('orders_weekly'))} SELECT * FROM s WHERE t < 116")
_add(
    "train_test_split",
    lambda s, d: sources.train_test(sources.events_hourly(s, d)).select("series_id", "t", "tr_size", "is_train"),
    f"{ctes(oracle.series('events_hourly'))} SELECT series_id, t, CAST((4 * n) // 5 AS BIGINT) AS tr_size, t < (4 * n) // 5 AS is_train FROM (SELECT *, count(*) OVER {WHOLE} AS n FROM s)",
)
_add(
    "train_is_test",
    lambda s, d: sources.train_test(sources.events_hourly(s, d), split=False).select("series_id", "t", "tr_size", "is_train", "is_test"),
    f"{ctes(oracle.series('events_hourly'))} SELECT series_id, t, count(*) OVER {WHOLE} AS tr_size, true AS is_train, true AS is_test FROM s",
)
_add("memory_source", lambda s, d: sources.to_series(s.createDataFrame([(3, 2.5, None), (1, None, 4.0), (2, 7.0, 1.0)], "day int, value double, other double"), "day", "value", exo=["other"]), "SELECT * FROM (VALUES ('_', CAST(0 AS BIGINT), 0.0::DOUBLE, 4.0::DOUBLE), ('_', 1, 7.0, 1.0), ('_', 2, 2.5, 0.0)) AS v(series_id, t, y, x1)")
_add(
    "mini_batches",
    lambda s, d: sources.batches(sources.ship_weekly(s, d), 116).select("series_id", "t", "batch"),
    f"{ctes(oracle.series('ship_weekly'))} SELECT series_id, t, CAST(t // 116 AS BIGINT) AS batch FROM s",
)

# features
_HOLED = "holed AS (SELECT series_id, t, y, CASE WHEN t < 20 THEN 0.0 ELSE x1 END AS x1 FROM s)"


def _holed(s: SparkSession, d: str) -> DataFrame:
    """A series whose exogenous values begin late, as missing values are encoded."""
    return sources.ship_weekly(s, d).withColumn("x1", F.when(F.col("t") < 20, 0.0).otherwise(F.col("x1")))


_add(
    "lag_matrix",
    lambda s, d: _show(features.lag_matrix(sources.events_hourly(s, d), 6), [f"y_lag{k}" for k in range(6, 0, -1)]),
    f"{ctes(oracle.series('events_hourly'))} SELECT series_id, t, {', '.join(f'round({lag('y', k)}, 6) + 0.0 AS y_lag{k}' for k in range(6, 0, -1))} FROM s",
)
_add(
    "lead_matrix",
    lambda s, d: _show(features.lead_matrix(sources.events_hourly(s, d), 6), [f"y_h{h}" for h in range(1, 7)]),
    f"{ctes(oracle.series('events_hourly'))} SELECT series_id, t, {', '.join(f'round(lead(y, {h - 1}, 0.0) OVER {BY_TIME}, 6) + 0.0 AS y_h{h}' for h in range(1, 7))} FROM s",
)
_add(
    "trend_matrix",
    lambda s, d: _show(features.trend_matrix(sources.orders_weekly(s, d), 5), [f"trend_{i}" for i in range(1, 5)]),
    f"{ctes(oracle.series('orders_weekly'))} SELECT series_id, t, {', '.join(f'round({oracle.trend(i)}, 6) + 0.0 AS trend_{i}' for i in range(1, 5))} FROM s",
)
_add(
    "backcast",
    lambda s, d: sources.ship_weekly(s, d).select("series_id", "t", F.round(features.backcast("y"), 6).alias("value")),
    f"{ctes(oracle.series('ship_weekly'))} SELECT series_id, t, round(lead(y, 1, 0.0) OVER {BY_TIME} / 3 + 2 * y / 3, 6) AS value FROM s",
)
_add("backfill", lambda s, d: _show(features.backfill(_holed(s, d), ["x1"]), ["x1"]), f"{ctes(oracle.series('ship_weekly'), _HOLED)} SELECT series_id, t, round({oracle.backfilled('x1')}, 6) + 0.0 AS x1 FROM holed")

_LINEAR = ModelSpec(p=3, q=2, trend=3, horizons=3, skip=3, n_exo=1)
_EXAMPLE = ModelSpec(p=6, q=4, horizons=6, skip=2, n_exo=1, scaler=scaling.STANDARD)
_SYMB = ModelSpec(p=2, q=2, trend=2, horizons=3, skip=2, n_exo=1, cross=True, scaler=scaling.minmax(), endo_fns=(symbolic.power(1.5), symbolic.log1p), exo_fns=(symbolic.power(0.5),))
_SYMB_SQL = {"p": 2, "q": 2, "trend": 2, "horizons": 3, "skip": 2, "cross": True, "scaler": "minmax", "endo": ("pow({x}, 1.5)", "ln(1 + {x})"), "exo": ("pow({x}, 0.5)",)}
_linear_sql = ModelSql("events_hourly", p=3, q=2, trend=3, horizons=3, skip=3)
_add("cross_terms", lambda s, d: _show(features.bases(sources.ship_weekly(s, d), _SYMB), ["base_c1"]), ModelSql("ship_weekly", **_SYMB_SQL).features(["base_c1"]))
_add("symbolic_features", lambda s, d: _show(features.bases(sources.ship_weekly(s, d), _SYMB), ["base_f1_y", "base_f2_y", "base_g1_x1"]), ModelSql("ship_weekly", **_SYMB_SQL).features(["base_f1_y", "base_f2_y", "base_g1_x1"]))
_add("arx_design", lambda s, d: _show(features.design_matrix(sources.events_hourly(s, d), _LINEAR), _LINEAR.design), _linear_sql.features(_LINEAR.design))
_add("symb_design", lambda s, d: _show(features.design_matrix(sources.ship_weekly(s, d), _SYMB), _SYMB.design), ModelSql("ship_weekly", **_SYMB_SQL).features(_SYMB.design))


def _hide(s: SparkSession, d: str) -> DataFrame:
    df = features.design_matrix(sources.events_hourly(s, d), replace(_LINEAR, q=4))
    return df.select("series_id", "t", *[(F.round(x, 6) + F.lit(0.0)).alias(f"h{h}_{i}") for h in (1, 2, 3, 6) for i, x in enumerate(features.carried("x1", 4, h))])


_hidden = [f"round(x1_lag{max(1, k - h + 1)}, 6) + 0.0 AS h{h}_{4 - k}" for h in (1, 2, 3, 6) for k in range(4, 0, -1)]
_add("hide_exo", _hide, ModelSql("events_hourly", p=3, q=4, trend=3, horizons=1).over_design(f"series_id, t, {', '.join(_hidden)}"))

# scaling
for _kind, _scaler in (("standard", scaling.STANDARD), ("minmax", scaling.minmax())):

    def _scale(s: SparkSession, d: str, scaler=_scaler) -> DataFrame:
        df = sources.ship_weekly(s, d)
        out = df.withColumns(dict(zip(("y_shift", "y_scale"), scaling.beside(F.col("y"), scaler), strict=True)))
        return _show(out.withColumn("scaled", scaling.scaled(F.col("y"), "y")), ["scaled"])

    _a, _b = oracle.scale("y", _kind)
    _add(f"scale_{_kind}", _scale, f"{ctes(oracle.series('ship_weekly'))} SELECT series_id, t, round((y - {_a}) / {_b}, 6) + 0.0 AS scaled FROM s")


def _scale_log(s: SparkSession, d: str) -> DataFrame:
    df = features.bases(sources.ship_weekly(s, d), ModelSpec(p=1, scaler=scaling.logarithmic()))
    return _show(df.withColumn("back", scaling.unscaled(F.col("base_y"), "y", scaling.logarithmic())), ["base_y", "back"])


_a, _b = oracle.scale("ln(1 + y)", "log")
_add("scale_log", _scale_log, f"{ctes(oracle.series('ship_weekly'))} SELECT series_id, t, round((ln(1 + y) - {_a}) / {_b}, 6) + 0.0 AS base_y, round(y, 6) + 0.0 AS back FROM s")


def _scaler_table(s: SparkSession, d: str) -> DataFrame:
    return scaling.fit_table(sources.ship_weekly(s, d), scaling.STANDARD, ["y", "x1"]).select("series_id", "name", *_round(["shift", "scale"]))


_add("scaler_table", _scaler_table, f"{ctes(oracle.series('ship_weekly'))} " + " UNION ALL ".join(f"SELECT series_id, '{c}' AS name, round(avg({c}), 6) + 0.0 AS shift, round(stddev_pop({c}), 6) + 0.0 AS scale FROM s GROUP BY series_id" for c in ("y", "x1")))


def _inverse(s: SparkSession, d: str) -> DataFrame:
    df = features.bases(sources.ship_weekly(s, d), _SYMB)
    return _show(df.withColumn("y_back", scaling.unscaled(F.col("base_y"), "y")), ["y_back"])


_add("scale_inverse", _inverse, f"{ctes(oracle.series('ship_weekly'))} SELECT series_id, t, round(y, 6) + 0.0 AS y_back FROM s")

# metrics, on the forecast that the last value stays
_NAIVE = [f"SELECT series_id, {h} AS h, y, lag(y, {h}) OVER {BY_TIME} AS y_hat FROM s" for h in (1, 2, 3)]
_NAIVE_CTE = f"pairs AS (SELECT * FROM ({' UNION ALL '.join(_NAIVE)}) WHERE y_hat IS NOT NULL)"


def _naive(s: SparkSession, d: str) -> DataFrame:
    df = sources.events_hourly(s, d).withColumns({f"y_{h}": F.lag("y", h).over(features.by_time()) for h in (1, 2, 3)})
    long = df.select("series_id", "y", F.posexplode(F.array("y_1", "y_2", "y_3")).alias("i", "y_hat"))
    return metrics.by_horizon(long.select("series_id", (F.col("i") + 1).alias("h"), "y", "y_hat").filter("y_hat is not null"))


_VALUES = ["mse", "mae", "r2", "r2bar", "smape"]
_add("metrics_by_horizon", lambda s, d: _naive(s, d).select("series_id", "h", *_round(_VALUES, 4), "m"), f"{ctes(oracle.series('events_hourly'), _NAIVE_CTE)} {oracle.metrics_from('pairs', 4)}")
_line = "concat_ws(chr(9), printf('h: %d', h), " + ", ".join(f"printf('{m.upper()}: %.4f', {m})" for m in _VALUES) + ", printf('M: %d', m))"
_add("report_text", lambda s, d: metrics.report(_naive(s, d).select("series_id", "h", *_round(_VALUES, 4), "m")), f"{ctes(oracle.series('events_hourly'), _NAIVE_CTE, f'e AS ({oracle.metrics_from('pairs', 4)})')} SELECT series_id, h, {_line} AS line FROM e")
_long = " UNION ALL ".join(f"SELECT series_id, h, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM e" for m in [*_VALUES, "m"])
_add(
    "metrics_pivot",
    lambda s, d: metrics.fit_map(_naive(s, d), 3).select("series_id", "metric", *_round(["h1", "h2", "h3"], 4)),
    f"{ctes(oracle.series('events_hourly'), _NAIVE_CTE, f'e AS ({oracle.metrics_from('pairs', 12)})', f'l AS ({_long})')} SELECT series_id, metric, {', '.join(f'round(max(value) FILTER (WHERE h = {h}), 4) + 0.0 AS h{h}' for h in (1, 2, 3))} FROM l GROUP BY series_id, metric",
)

# estimators
_add(
    "ar1_ols",
    lambda s, d: estimators.ar1(sources.events_hourly(s, d)).select("series_id", *_round(["const", "phi"]), "n"),
    f"{ctes(oracle.series('events_hourly'))} SELECT series_id, round(regr_intercept(y, x), 6) + 0.0 AS const, round(regr_slope(y, x), 6) + 0.0 AS phi, count(*) AS n FROM (SELECT *, lag(y, 1) OVER {BY_TIME} AS x FROM s) WHERE x IS NOT NULL GROUP BY series_id",
)
for _kind, _less in (("mle", 0), ("adjusted", 1)):
    _c = f"c AS (SELECT *, y - avg(y) OVER {WHOLE} AS c FROM s)"
    _l = f"l AS (SELECT *, lag(c, 1) OVER {BY_TIME} AS c1, lag(c, 2) OVER {BY_TIME} AS c2 FROM c)"
    _r = f"r AS (SELECT series_id, avg(y) AS mu, sum(c * c) / count(*) AS r0, sum(c * c1) / (count(*) - {_less}) AS r1, sum(c * c2) / (count(*) - {2 * _less}) AS r2 FROM l GROUP BY series_id)"
    _p = "p AS (SELECT *, (r1 * r0 - r1 * r2) / (r0 * r0 - r1 * r1) AS a1, (r2 * r0 - r1 * r1) / (r0 * r0 - r1 * r1) AS a2 FROM r)"
    _add(
        f"yw_{_kind}",
        lambda s, d, adjusted=bool(_less): estimators.yule_walker(sources.events_hourly(s, d), 2, adjusted).select("series_id", *_round(["const", "phi_1", "phi_2"])),
        f"{ctes(oracle.series('events_hourly'), _c, _l, _r, _p)} SELECT series_id, round(mu * (1 - a1 - a2), 6) + 0.0 AS const, round(a1, 6) + 0.0 AS phi_1, round(a2, 6) + 0.0 AS phi_2 FROM p",
    )


def _gram(s: SparkSession, d: str) -> DataFrame:
    df = features.design_matrix(sources.ship_weekly(s, d), ModelSpec(p=1, q=1, n_exo=1))
    sums = estimators.gram(df, ["y_lag1", "x1_lag1"], "base_y")
    return sums.select("series_id", "n", *_round([c for c in sums.columns if c.startswith("s_")], 3))


_g = ["y_lag1", "x1_lag1", "base_y"]
_sums = [f"round(sum({x}), 3) + 0.0 AS s_{i}" for i, x in enumerate(_g)] + [f"round(sum({_g[i]} * {_g[j]}), 3) + 0.0 AS s_{i}_{j}" for i in range(3) for j in range(i, 3)]
_add("ols_gram", _gram, ModelSql("ship_weekly", p=1, q=1, horizons=1).over_design(f"series_id, count(*) AS n, {', '.join(_sums)}", "GROUP BY series_id"))


def _gram_rolling(s: SparkSession, d: str) -> DataFrame:
    spec = ModelSpec(p=1, q=1, n_exo=1)
    sums = estimators.rolling_gram(features.design_matrix(sources.ship_weekly(s, d), spec), spec.design, "base_y", 3)
    # sums have few digits, so many lie halfway between two roundings: a hair is added
    return sums.select("series_id", "fold", "n", *((F.round(F.col(c) + 3.3e-9, 3) + F.lit(0.0)).alias(c) for c in sums.columns if c.startswith("s_")))


_roll_gram = ModelSql("ship_weekly", p=1, q=1, horizons=1, rolling=True, rc=3)
_upto_train = next(i for i, x in enumerate(_roll_gram.parts) if x.startswith("train AS"))
_add("ols_gram_rolling", _gram_rolling, f"{ctes(*_roll_gram.parts[: _upto_train + 1])} SELECT series_id, CAST(fold AS BIGINT) AS fold, count(*) AS n, {', '.join(_sums).replace('), 3)', ') + 3.3e-9, 3)')} FROM train GROUP BY series_id, fold")


def _gram_solved(s: SparkSession, d: str) -> DataFrame:
    spec = ModelSpec(p=2, q=1, n_exo=1)
    df = features.design_matrix(sources.ship_weekly(s, d), spec)
    out = estimators.solve_gram(estimators.gram(df, spec.design, "base_y"), len(spec.design))
    terms = F.array(*[F.lit(t) for t in ["const", *spec.design]])
    long = out.select("series_id", F.posexplode("coef").alias("j", "coef"))
    return long.select("series_id", F.lit(0).cast("long").alias("fold"), F.lit(1).alias("h"), F.element_at(terms, F.col("j") + 1).alias("term"), *_round(["coef"], 4))


_add("ols_distributed", _gram_solved, ModelSql("ship_weekly", p=2, q=1, horizons=1).coefficients())


# models: (name, source, model, SQL)
def _model(name: str, source: str, model: models.Model, sql: ModelSql | None, rolling: bool = False, growing: bool = False, parts: tuple[str, ...] = ("forecasts", "metrics")) -> None:
    def made(s: SparkSession, d: str) -> DataFrame:
        df = getattr(sources, source)(s, d)
        return model.roll_validate(df, 2, growing) if rolling else model.in_sample(df)

    yf = [f"yf_{h}" for h in range(1, model.spec.horizons + 1)]
    if "forecasts" in parts:
        _add(name, lambda s, d: made(s, d).select("series_id", "fold", "t", "y", *_round(yf, 3)), sql and sql.forecasts())
    if "metrics" in parts:
        _add(f"{name}_metrics", lambda s, d: model.diagnose(made(s, d)).select("series_id", "h", *_round(_VALUES, 3), "m"), sql and sql.metrics())
    if "params" in parts:
        _add(f"{name}_params", lambda s, d: model.fit(model.design(getattr(sources, source)(s, d)), {"rc": 2, "growing": growing} if rolling else None).coefficients().select("series_id", "fold", "h", "term", *_round(["coef"], 4)), sql and sql.coefficients())


_ar_sql = {"p": 2, "horizons": 3, "skip": 2, "kernel": "ar", "clip": False}
_model("ar_recursive", "events_hourly", models.autoregression(2, 3), ModelSql("events_hourly", **_ar_sql), parts=("forecasts", "params"))
_model("ar_roll", "events_hourly", models.autoregression(2, 3), ModelSql("events_hourly", rolling=True, **_ar_sql), rolling=True)
for _kind in ("mle", "adjusted"):
    _yw_sql = {"p": 6, "horizons": 6, "skip": 6, "kernel": _kind, "clip": False}
    _model(f"yw_{_kind}_recursive", "events_hourly", models.autoregression(6, 6, _kind), ModelSql("events_hourly", **_yw_sql), parts=("forecasts", "params"))
    _model(f"yw_{_kind}_roll", "events_hourly", models.autoregression(6, 6, _kind), ModelSql("events_hourly", rolling=True, **_yw_sql), rolling=True)
_model("arx_recursive", "events_hourly", models.linear(_LINEAR), _linear_sql, parts=("forecasts", "metrics", "params"))
_model("arx_recursive_sk_lr", "events_hourly", models.linear(replace(_LINEAR, lstsq="sk_lr")), _linear_sql, parts=("forecasts",))
_direct_sql = {"p": 3, "q": 2, "trend": 3, "horizons": 3, "skip": 3, "direct": True}
_model("arx_direct", "events_hourly", models.linear(_LINEAR, "direct"), ModelSql("events_hourly", **_direct_sql), parts=("forecasts", "metrics", "params"))
_model("arx_direct_leak_free", "events_hourly", models.linear(_LINEAR, "direct", True), ModelSql("events_hourly", leak_free=True, **_direct_sql), parts=("forecasts",))
_model("symb_recursive", "ship_weekly", models.Model(_SYMB), ModelSql("ship_weekly", **_SYMB_SQL), parts=("forecasts", "metrics"))
_model("symb_direct", "ship_weekly", models.Model(_SYMB, "direct"), ModelSql("ship_weekly", direct=True, **_SYMB_SQL), parts=("forecasts", "metrics"))


def mean_kernel(x, y):
    """An estimator of one's own: the mean of each target, no slopes."""
    return np.vstack([y.mean(0), np.zeros((x.shape[1], y.shape[1]))])


_model("own_kernel", "events_hourly", models.Model(_LINEAR, "direct", mean_kernel), ModelSql("events_hourly", kernel="mean", **_direct_sql), parts=("forecasts",))
_model("own_kernel_roll", "events_hourly", models.Model(_LINEAR, "recursive", mean_kernel), ModelSql("events_hourly", kernel="mean", rolling=True, p=3, q=2, trend=3, horizons=3, skip=3), rolling=True, parts=("metrics",))
_model("gram_recursive", "events_hourly", models.Model(_LINEAR, "recursive", "gram"), _linear_sql, parts=("forecasts", "params"))
_model("gram_roll", "orders_weekly", models.Model(_EXAMPLE, "recursive", "gram"), ModelSql("orders_weekly", p=6, q=4, horizons=6, skip=2, scaler="standard", clip=False, rolling=True), rolling=True, parts=("forecasts",))
_model("log_recursive", "ship_weekly", models.linear(ModelSpec(p=3, horizons=3, skip=2, scaler=scaling.logarithmic())), ModelSql("ship_weekly", p=3, horizons=3, skip=2, scaler="log", clip=False), parts=("forecasts", "metrics"))
_add(
    "arx_slice",
    lambda s, d: models.linear(_LINEAR).in_sample(sources.events_hourly(s, d), 10, 40).select("series_id", "fold", "t", "y", *_round(["yf_1", "yf_2", "yf_3"], 3)),
    _linear_sql.forecasts() + " WHERE t >= 10 AND t < 40",
)


def _given(s: SparkSession, d: str, horizons: int) -> DataFrame:
    """Features of one's own beside the series: here a moving mean and the hour of the day, under any names."""
    df = sources.events_hourly(s, d)
    w = features.by_time().rowsBetween(-4, -1)
    df = df.withColumns({"moving mean": F.coalesce(F.avg("y").over(w), F.lit(0.0)), "phase": (F.col("t") % 24).cast("int")})
    model = models.linear(ModelSpec(p=1, horizons=horizons, skip=4, given=("moving mean", "phase"), lstsq="sm_ols"), "direct" if horizons > 1 else "recursive")
    return model.in_sample(df).select("series_id", "fold", "t", "y", *_round([f"yf_{h}" for h in range(1, horizons + 1)], 3))


for _h in (1, 3):
    _own = f"own AS (SELECT *, coalesce(avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0) AS f1, CAST(t % 24 AS DOUBLE) AS f2, {', '.join(f'lead(y, {h}, 0.0) OVER {BY_TIME} AS y_{h}' for h in range(_h))} FROM s)"
    _fits = ", ".join(
        f"regr_count(y_{h}, f1) AS n_{h}, covar_pop(y_{h}, f1) AS c1_{h}, covar_pop(y_{h}, f2) AS c2_{h}, avg(y_{h}) AS m_{h}" for h in range(_h)
    )
    _fit = f"fit AS (SELECT series_id, var_pop(f1) AS v1, var_pop(f2) AS v2, covar_pop(f1, f2) AS v12, avg(f1) AS m1, avg(f2) AS m2, {_fits} FROM own GROUP BY series_id)"
    _b1, _b2 = "((c1_{h} * v2 - c2_{h} * v12) / (v1 * v2 - v12 * v12))", "((c2_{h} * v1 - c1_{h} * v12) / (v1 * v2 - v12 * v12))"
    _out = ", ".join(f"round(greatest(m_{h} + {_b1.format(h=h)} * (f1 - m1) + {_b2.format(h=h)} * (f2 - m2), 0.0), 3) + 0.0 AS yf_{h + 1}" for h in range(_h))
    _add(f"given_columns_{_h}", lambda s, d, h=_h: _given(s, d, h), f"{ctes(oracle.series('events_hourly'), _own, _fit)} SELECT o.series_id, CAST(0 AS BIGINT) AS fold, t, y, {_out} FROM own o JOIN fit f ON o.series_id = f.series_id WHERE t >= 4")
_example_sql = {"p": 6, "q": 4, "horizons": 6, "skip": 2, "scaler": "standard", "clip": False}
_model("roll_sliding", "orders_weekly", models.linear(_EXAMPLE), ModelSql("orders_weekly", rolling=True, **_example_sql), rolling=True)
_model("roll_growing", "orders_weekly", models.linear(_EXAMPLE), ModelSql("orders_weekly", rolling=True, growing=True, **_example_sql), rolling=True, growing=True)
_model("roll_direct", "orders_weekly", models.linear(_EXAMPLE, "direct"), ModelSql("orders_weekly", rolling=True, direct=True, **_example_sql), rolling=True)
_SYMB_ONE = replace(_EXAMPLE, endo_fns=(symbolic.power(1.5),), exo_fns=(), scaler=scaling.minmax(), p=3, q=2, horizons=3)
_symb_one_sql = {"p": 3, "q": 2, "horizons": 3, "skip": 2, "scaler": "minmax", "endo": ("pow({x}, 1.5)",)}
_model("roll_symbolic", "ship_weekly", models.Model(_SYMB_ONE), ModelSql("ship_weekly", rolling=True, **_symb_one_sql), rolling=True, parts=("metrics",))
_model("roll_symbolic_direct", "ship_weekly", models.Model(_SYMB_ONE, "direct", "sk_lr"), ModelSql("ship_weekly", rolling=True, direct=True, **_symb_one_sql), rolling=True, parts=("metrics",))


# the scenario with a symbolic function: standard scaling, x**1.5 of the series, none of the exogenous one
_SCENARIO = replace(_EXAMPLE, endo_fns=(symbolic.power(1.5),), exo_fns=())
_scenario_sql = {**_example_sql, "endo": ("pow({x}, 1.5)",)}
_model("scenario_symbolic", "ship_weekly", models.Model(_SCENARIO), ModelSql("ship_weekly", **_scenario_sql))
_model("scenario_symbolic_roll", "ship_weekly", models.Model(_SCENARIO), ModelSql("ship_weekly", rolling=True, **_scenario_sql), rolling=True, parts=("metrics",))
_model("scenario_symbolic_direct", "ship_weekly", models.Model(_SCENARIO, "direct"), ModelSql("ship_weekly", direct=True, **_scenario_sql), parts=("metrics",))
_model("scenario_symbolic_direct_roll", "ship_weekly", models.Model(_SCENARIO, "direct"), ModelSql("ship_weekly", rolling=True, direct=True, **_scenario_sql), rolling=True, parts=("metrics",))


def _matrix(s: SparkSession, d: str) -> DataFrame:
    df = sources.events_hourly(s, d)
    out = forecast.matrix(df, models.linear(_LINEAR).roll_validate(df), 3)
    return out.select("series_id", "t", "y", *_round(["yf_1", "yf_2", "yf_3"], 3))


_roll_linear = ModelSql("events_hourly", p=3, q=2, trend=3, horizons=3, skip=3, rolling=True)
_add("yf_matrix", _matrix, f"{ctes(*_roll_linear.parts)} SELECT s.series_id, s.t, s.y, {', '.join(f'coalesce(round(yf_{h}, 3) + 0.0, 0.0) AS yf_{h}' for h in (1, 2, 3))} FROM s LEFT JOIN forecasts f ON s.series_id = f.series_id AND s.t = f.t")

# neural: seeded, but beyond SQL
_NEURAL = replace(_EXAMPLE, horizons=3)
_TOKENS = replace(_EXAMPLE, endo_fns=symbolic.DEFAULT, exo_fns=symbolic.DEFAULT)


def _mlp(s: SparkSession, d: str) -> DataFrame:
    model = models.linear(_NEURAL, "direct")
    df = model.design(sources.ship_weekly(s, d))
    out = neural.perceptron_forecasts(df, _NEURAL.design, [f"base_y_h{h}" for h in (1, 2, 3)])
    limits = df.select("series_id", "t", "y_shift", "y_scale")
    back = out.join(limits, ["series_id", "t"]).withColumns({c: scaling.unscaled(F.col(c), "y") for c in ("y", "y_hat")})
    return metrics.by_horizon(back)


def _attention(s: SparkSession, d: str) -> DataFrame:
    return neural.attention_scores(features.design_matrix(sources.ship_weekly(s, d), _TOKENS), _TOKENS.design, "base_y")


_add("mlp_regressor", _mlp)
_add("attention_scores", _attention)
_add("attention_topk", lambda s, d: neural.top_features(_attention(s, d), _TOKENS.design, 20))


# what follows from scores, over scores that SQL can make: the mean discount by line number and ship month
_SCORES = "sc AS (SELECT l_returnflag AS series_id, CAST(l_linenumber - 1 AS INTEGER) AS query_idx, CAST(month(l_shipdate) - 1 AS INTEGER) AS key_idx, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY 1, 2, 3)"


def _scores(s: SparkSession, d: str) -> DataFrame:
    items = s.read.parquet(f"{d}/lineitem.parquet")
    keys = [F.col("l_returnflag").alias("series_id"), (F.col("l_linenumber") - 1).alias("query_idx"), (F.month("l_shipdate") - 1).alias("key_idx")]
    return items.groupBy(*keys).agg(F.round(F.avg("l_discount"), 9).alias("score"))


_MONTHS = [f"month {m}" for m in range(1, 13)]
_add(
    "top_features",
    lambda s, d: neural.top_features(_scores(s, d), _MONTHS, 5),
    f"{ctes(_SCORES, 'k AS (SELECT series_id, key_idx, round(avg(score), 6) AS score FROM sc GROUP BY 1, 2)')} SELECT * FROM (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY score DESC, key_idx) AS INTEGER) AS rank, key_idx, concat('month ', key_idx + 1) AS feature, score FROM k) WHERE rank <= 5",
)
_add(
    "heat_map",
    lambda s, d: neural.heat_map(_scores(s, d)).select("series_id", "query_idx", "key_idx", *_round(["score"])),
    f"{ctes(_SCORES, 'z AS (SELECT series_id, max(greatest(query_idx, key_idx)) AS last, max(score) / 2 AS half FROM sc GROUP BY 1)', 'e AS (SELECT series_id, half, unnest(range(0, last + 2)) AS i FROM z)')} SELECT series_id, query_idx, key_idx, round(score, 6) + 0.0 AS score FROM (SELECT series_id, query_idx + 1 AS query_idx, key_idx + 1 AS key_idx, score FROM sc UNION ALL SELECT series_id, 0, CAST(i AS INTEGER), half FROM e UNION ALL SELECT series_id, CAST(i AS INTEGER), 0, half FROM e WHERE i > 0)",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling validation of an ARX model over hourly events: metrics for each series and horizon."""
    return QUERIES["ar_roll_metrics"](spark, sf_dir)
