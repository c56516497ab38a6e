"""Operators against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import symbolic
from tidemark.operators import estimators, features, forecast, metrics, neural, scaling
from tidemark.plans import models
from tidemark.plans.spec import ModelSpec, check_range
from tidemark.sources import series as sources


def make(spark, values, sid="a", **exo):
    rows = [(sid, t, float(v), *[float(x[t]) for x in exo.values()]) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, t long, y double" + "".join(f", {k} double" for k in exo))


def read(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("series_id", "t").collect()]


def test_lag_matrix(spark):
    assert read(features.lag_matrix(make(spark, [1, 2, 3, 4]), 2), "y_lag2", "y_lag1") == [(1, 1), (1, 1), (1, 2), (2, 3)]
    with pytest.raises(ValueError):
        features.lag_matrix(make(spark, [1]), 0)


def test_lead_matrix(spark):
    got = read(features.lead_matrix(make(spark, range(1, 8)), 3), "y_h1", "y_h2", "y_h3")
    assert got[-3:] == [(5, 6, 7), (6, 7, 0), (7, 0, 0)]


@pytest.mark.parametrize("given, wanted", [([0, 0, 0, 9, 0, 4], [1 / 3, 1, 3, 9, 0, 4]), ([0, 0, 0], [0, 0, 0]), ([5, 0, 1], [5, 0, 1])])
def test_backfill(spark, given, wanted):
    assert [x for (x,) in read(features.backfill(make(spark, given), ["y"]), "y")] == pytest.approx(wanted)


def test_trend(spark):
    got = np.array(read(features.trend_matrix(make(spark, [0] * 4), 5), *[f"trend_{i}" for i in range(1, 5)]))
    assert got[:, 0].tolist() == [0, 0.25, 0.5, 0.75] and got[:, 1].tolist() == [1, 0.25, 0, 0.25]
    assert got[:, 2] == pytest.approx([0, 0.309017, 0.587785, 0.809017], abs=1e-6)
    assert got[:, 3] == pytest.approx([1, 0.951057, 0.809017, 0.587785], abs=1e-6)
    with pytest.raises(ValueError):
        features.trend(6)


def test_hidden_exogenous(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0, 4.0)], "series_id string, t long, x1_lag4 double, x1_lag3 double, x1_lag2 double, x1_lag1 double")
    row = lambda h, **k: list(df.select(*features.carried("x1", 4, h, **k)).first())
    assert row(1) == [1, 2, 3, 4] and row(2) == [2, 3, 4, 4] and row(3) == [3, 4, 4, 4] and row(4) == row(9) == [4] * 4
    assert row(9, fill=False) == [0] * 4


@pytest.mark.parametrize("scaler, wanted", [(scaling.STANDARD, [-1.341641, -0.447214, 0.447214, 1.341641]), (scaling.minmax(), [0, 4 / 3, 8 / 3, 4])])
def test_scalers(spark, scaler, wanted):
    df = features.bases(make(spark, [1, 2, 3, 4]), ModelSpec(p=1, scaler=scaler))
    assert [x for (x,) in read(df, "base_y")] == pytest.approx(wanted, abs=1e-6)
    assert [x for (x,) in read(df.withColumn("z", scaling.unscaled(F.col("base_y"), "y")), "z")] == pytest.approx([1, 2, 3, 4])
    flat = features.bases(make(spark, [7, 7]), ModelSpec(p=1, scaler=scaler))
    assert [x for (x,) in read(flat, "base_y")] == [0, 0]


def test_yule_walker_and_ar(spark):
    df = make(spark, [1, 2, 3, 4])
    for adjusted, phi, const in ((False, 0.25, 1.875), (True, 1 / 3, 5 / 3)):
        r = estimators.yule_walker(df, 1, adjusted).first()
        assert (r["phi_1"], r["const"]) == pytest.approx((phi, const))
        assert estimators.yule_walker_kernel(np.array([1.0, 2, 3, 4]), 1, adjusted) == pytest.approx([const, phi])
    r = estimators.ar1(df).first()
    assert (r["const"], r["phi"]) == pytest.approx((1, 1))
    model = models.linear(ModelSpec(p=1))
    c = {r["term"]: r["coef"] for r in model.fit(model.design(df)).coefficients().collect()}
    assert (c["const"], c["y_lag1"]) == pytest.approx((0.272727, 1.272727), abs=1e-6)


def test_levinson_equals_toeplitz(spark):
    y = np.random.default_rng(1).normal(size=60).cumsum()
    r = estimators.yule_walker(make(spark, y), 4).first()
    assert [r["const"], *[r[f"phi_{i}"] for i in range(4, 0, -1)]] == pytest.approx(estimators.yule_walker_kernel(y, 4, False))


def test_metrics(spark):
    pairs = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 1, 2.0, 2.0), ("a", 1, 3.0, 4.0), ("b", 1, 5.0, 4.0), ("b", 1, 5.0, 5.0)], "series_id string, h int, y double, y_hat double")
    got = {r["series_id"]: r for r in metrics.by_horizon(pairs).collect()}
    a = got["a"]
    assert (a["mse"], a["mae"], a["r2"], a["r2bar"], a["smape"], a["m"]) == pytest.approx((1 / 3, 1 / 3, 0.5, 0, 9.523810, 3), abs=1e-6)
    assert got["b"]["r2"] == 0 and math.isnan(got["b"]["r2bar"])


def test_folds():
    folds = estimators.fold_list(116, 92, 2, False)
    assert len(folds) == 12 and folds[0] == (0, 92, 92, 94) and folds[-1] == (22, 114, 114, 116)
    assert estimators.fold_list(11, 8, 2, True) == [(0, 8, 8, 10), (0, 10, 10, 11)]


def test_symbolic_domains(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (3.0,)], "x double")
    got = [tuple(r) for r in df.select(symbolic.log1p(F.col("x")), symbolic.power(1.5)(F.col("x")), symbolic.clip_negative(F.lit(float("nan")))).collect()]
    assert math.isnan(got[0][0]) and got[1][0] == -math.inf and got[2][0] == 0 and got[3][0] == pytest.approx(math.log(4))
    assert math.isnan(got[0][1]) and got[3][1] == pytest.approx(3**1.5) and math.isnan(got[0][2])


def test_errors(spark):
    for bad in ({"p": 0}, {"trend": 6}, {"horizons": 0}, {"n_exo": 1}, {"lstsq": "other"}):
        with pytest.raises(ValueError):
            ModelSpec(**bad)
    with pytest.raises(ValueError):
        models.linear(ModelSpec(p=1, q=1, n_exo=1)).design(make(spark, [1, 2]))
    with pytest.raises(ValueError):
        models.Model(ModelSpec(), "sideways")
    assert check_range(-1, -1, 10, 3) == (3, 10)
    for a, b in ((5, 5), (0, 11), (-2, 4)):
        with pytest.raises(ValueError):
            check_range(a, b, 10, 3)
    assert repr(models.linear(ModelSpec(p=2, horizons=3))) == "recursive(p=2, q=0, n_exo=0), hh = 3, skip = 2, method=sm_ols"


def test_csv(spark, tmp_path):
    p = tmp_path / "weekly.csv"
    p.write_text("date,cases,icu\n2/29/2020,3,0\n3/14/2020,9,5\n3/7/2020,4,0\n")
    df = sources.read_csv(spark, str(p), "date", "cases", ["icu"], first=2)
    assert read(df, "t", "y", "x1") == [(0, 3, 0), (1, 4, 0)]


def test_gaps_are_filled_on_request(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 03:00:00", 2.0)], "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = lambda fill: [x for (x,) in read(sources.bucketed(df, "ts", "hour", F.sum("v"), fill=fill), "y")]
    assert got(False) == [1, 2] and got(True) == [1, 0, 0, 2]


def test_rolling_gram_equals_rows():
    rng = np.random.default_rng(3)
    x, y = rng.normal(5, 2, (400, 4)), rng.normal(size=(400, 2))
    windows = [(i, 200 + i) for i in range(0, 200)] + [(0, 300), (0, 310), (0, 3)]
    for a, (lo, hi) in zip(estimators.rolling_least_squares(x, y, windows), windows, strict=True):
        assert a == pytest.approx(estimators.least_squares(x[lo:hi], y[lo:hi]), abs=1e-8)


def reference_forecast(y, xe, p, q, hh, beta, clip):
    """The recursion in plain loops, no scaling and no trend."""
    n, out = len(y), []
    at = lambda z, t, k: z[t - k] if t >= k else z[0]
    for t in range(n):
        ahead = []
        for h in range(1, hh + 1):
            endo = [at(y, t, k - h + 1) if k >= h else ahead[h - k - 1] for k in range(p, 0, -1)]
            exo = [at(xe, t, max(1, k - h + 1)) for k in range(q, 0, -1)]
            v = beta[0] + float(np.dot(beta[1:], endo + exo))
            ahead.append(max(v, 0.0) if clip else v)
        out.append(ahead)
    return np.array(out)


def test_recursive_forecast_against_loops(spark):
    rng = np.random.default_rng(4)
    y, xe = rng.normal(0, 3, 50), rng.normal(2, 1, 50)
    spec = ModelSpec(p=3, q=2, horizons=5, skip=0, n_exo=1)
    model = models.linear(spec)
    df = make(spark, y, x1=xe)
    beta = [r["coef"] for r in sorted(model.fit(model.design(df)).coefficients().collect(), key=lambda r: ["const", *spec.design].index(r["term"]))]
    got = np.array(read(model.in_sample(df), *[f"yf_{h}" for h in range(1, 6)]))
    want = reference_forecast(y, xe, 3, 2, 5, np.array(beta), True)
    assert got == pytest.approx(want) and (got == 0).any()


def test_properties(spark):
    rng = np.random.default_rng(5)
    y, xe = rng.normal(20, 3, 60), rng.normal(2, 1, 60)
    df = make(spark, y, x1=xe)
    spec = ModelSpec(p=3, q=2, horizons=3, n_exo=1)
    rec = read(models.linear(spec).in_sample(df), "yf_1", "yf_2")
    # the first horizon is the same either way
    assert [a for a, _ in rec] == pytest.approx([a for (a,) in read(models.linear(spec, "direct").in_sample(df), "yf_1")])
    # affine scaling changes nothing in a recursive linear model that does not clip
    from dataclasses import replace

    assert read(models.linear(replace(spec, scaler=scaling.STANDARD)).in_sample(df), "yf_1", "yf_2") == [pytest.approx(r) for r in rec]
    # neither does another series, nor the order of rows
    more = df.union(make(spark, rng.normal(size=40), "b", x1=rng.normal(size=40))).orderBy(F.rand(1))
    assert read(models.linear(spec).in_sample(more).filter("series_id = 'a'"), "yf_1", "yf_2") == [pytest.approx(r) for r in rec]


def test_odd_test_part_and_short_series(spark):
    out = models.autoregression(2, 2).roll_validate(make(spark, range(1, 12)))
    assert [t for (t,) in read(out, "t")] == [8, 9, 10]
    assert models.linear(ModelSpec(p=6, horizons=2)).in_sample(make(spark, [1, 2, 3])).count() == 0


def test_nan_stays_nan(spark):
    spec = ModelSpec(p=1, horizons=2, skip=1, endo_fns=(symbolic.power(1.5),))
    m = models.Model(spec)
    r = m.diagnose(m.in_sample(make(spark, [-1, 2, 3, -4, 5, 6, 7]))).filter("h = 1").first()
    assert math.isnan(r["mse"])


def test_slices(spark):
    df = make(spark, range(1, 21)).union(make(spark, range(1, 16), "b"))
    model = models.linear(ModelSpec(p=2, horizons=2))
    assert [t for (t,) in read(model.in_sample(df, 4, 9), "t")] == [4, 5, 6, 7, 8] * 2
    assert [t for (t,) in read(model.in_sample(df, end=4), "t")] == [2, 3] * 2 and len(read(model.in_sample(df, 12), "t")) == 8 + 3
    for start, end in ((-3, 5), (5, 5), (4, 16), (4, -2), (15, -1)):  # the shortest series has 15 steps
        with pytest.raises(ValueError):
            model.in_sample(df, start, end)


def test_given_columns(spark):
    rng = np.random.default_rng(7)
    y, f = rng.normal(10, 2, 40), rng.normal(size=40)
    df = make(spark, y, feature=f)
    got = [x for (x,) in read(models.linear(ModelSpec(p=1, skip=0, given=("feature",))).in_sample(df), "yf_1")]
    slope = np.polyfit(f, y, 1)
    assert got == pytest.approx(np.polyval(slope, f))
    for bad, error in (({"given": ()}, ValueError), ({"given": "feature"}, TypeError), ({"given": ("feature",), "scaler": scaling.STANDARD}, ValueError)):
        with pytest.raises(error):
            ModelSpec(**bad)
    with pytest.raises(ValueError):
        models.linear(ModelSpec(given=("feature",), horizons=2))
    with pytest.raises(ValueError):
        models.linear(ModelSpec(given=("other",))).design(df)


def test_kernels_of_ones_own(spark):
    df = make(spark, np.random.default_rng(8).normal(5, 1, 40))

    def ridge(x, y):
        a = np.column_stack([np.ones(len(x)), x])
        return np.linalg.solve(a.T @ a + 1e-9 * np.eye(a.shape[1]), a.T @ y)

    spec = ModelSpec(p=2, horizons=2)
    own, known = (read(models.Model(spec, "recursive", k).roll_validate(df), "yf_1", "yf_2") for k in (ridge, "sm_ols"))
    assert own == [pytest.approx(r, abs=1e-6) for r in known] and "method=ridge" in repr(models.Model(spec, "recursive", ridge))
    for bad in ("other", None, 3):
        with pytest.raises(ValueError):
            models.Model(spec, "recursive", bad)
    with pytest.raises(Exception, match="a kernel returns an array"):
        models.Model(spec, "recursive", lambda x, y: np.zeros(3)).in_sample(df).collect()


def test_parameters_from_elsewhere(spark):
    df = make(spark, [1, 2, 4, 8, 16])
    model = models.linear(ModelSpec(p=1, skip=1))
    given = spark.createDataFrame([("a", 0, [[0.0, 2.0]])], "series_id string, fold long, coef array<array<double>>")
    assert [x for (x,) in read(model.with_params(given).forecasts(df), "yf_1")] == [2, 4, 8, 16]
    with pytest.raises(TypeError):
        model.with_params([0.0, 2.0])
    for bad in (given.drop("coef"), given.limit(0)):
        with pytest.raises(ValueError):
            model.with_params(bad)
    with pytest.raises(TypeError):
        model.design([1.0, 2.0])


def test_default_solvers():
    spec = ModelSpec(p=2)
    assert models.linear(spec, "direct").kernel == "sk_lr" and models.linear(spec).kernel == models.symbolic(spec, "direct").kernel == "sm_ols"
    assert models.linear(ModelSpec(p=2, lstsq="sm_ols"), "direct").kernel == "sm_ols"


def test_gram_matrices_of_short_and_flat_series(spark):
    model = models.Model(ModelSpec(p=2, horizons=1), "recursive", "gram")
    flat = model.fit(model.design(make(spark, [3] * 30).union(make(spark, [1, 2], "b")))).params.collect()
    assert [r["coef"] for r in flat] == [[None], [None]]
    y = np.random.default_rng(9).normal(size=300).cumsum()
    rolled = {r["fold"]: r["coef"][0] for r in model.fit(model.design(make(spark, y)), {"rc": 7, "growing": False}).params.collect()}
    plain = models.linear(ModelSpec(p=2))
    want = {r["fold"]: r["coef"][0] for r in plain.fit(plain.design(make(spark, y)), {"rc": 7, "growing": False}).params.collect()}
    assert rolled.keys() == want.keys() and all(rolled[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_split_or_not(spark):
    rows = read(sources.train_test(make(spark, range(5)), split=False), "is_train", "is_test")
    assert rows == [(True, True)] * 5
    assert read(sources.train_test(make(spark, range(5))), "is_train", "is_test") == [(True, False)] * 4 + [(False, True)]


def test_losses():
    off = np.array([[-3.0], [0.5], [0.0], [2.0]])
    for name, value in (("mse", 13.25 / 4), ("mae", 5.5 / 4), ("huber", (2.5 + 0.125 + 0 + 1.5) / 4)):
        loss = neural.loss_of(name)
        assert loss(off)[0] == pytest.approx(value)
        step = np.zeros_like(off)
        step[0] = 1e-6
        assert loss(off)[1][0, 0] == pytest.approx((loss(off + step)[0] - loss(off - step)[0]) / 2e-6, abs=1e-6)
    with pytest.raises(ValueError):
        neural.loss_of("other")
    x = np.random.default_rng(0).normal(size=(100, 2))
    for loss in ("mae", "huber", neural.squared):
        losses = neural.Perceptron(2, 1, loss=loss).fit(x, x[:, :1])
        assert losses[-1] < 0.5 * losses[0]
    net = neural.AttentionRegressor(8, 2, 6, epochs=20, batch=16, loss="mae")
    assert net.fit(x[:32], x[:32, :1])[-1] > 0


def test_heat_map_is_written(spark, tmp_path):
    scores = spark.createDataFrame([("a", q, k, float(q + k)) for q in range(2) for k in range(2)], "series_id string, query_idx int, key_idx int, score double")
    neural.write_heat_map(scores, str(tmp_path / "map"))
    got = {(r["query_idx"], r["key_idx"]): r["score"] for r in spark.read.parquet(str(tmp_path / "map")).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (1, 0): 1, (2, 0): 1, (1, 1): 0, (1, 2): 1, (2, 1): 1, (2, 2): 2}


def test_report(spark):
    m = spark.createDataFrame([("a", 1, 0.25, 0.5, 1.0, float("nan"), 12.34567, 3)], "series_id string, h int, mse double, mae double, r2 double, r2bar double, smape double, m long")
    assert metrics.report(m).first()["line"] == "h: 1\tMSE: 0.2500\tMAE: 0.5000\tR2: 1.0000\tR2BAR: NaN\tSMAPE: 12.3457\tM: 3"


def test_perceptron_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = np.tanh(x[:, :1]) + x[:, 1:2]
    losses = neural.Perceptron(3, 1).fit(x, y)
    assert losses[-1] < 0.2 * losses[0]


def test_attention_gradients_and_scores():
    rng = np.random.default_rng(0)
    net = neural.AttentionRegressor(8, 2, 6, dropout=0.0, epochs=30, batch=16)
    x, y = rng.normal(size=(12, 5)), rng.normal(size=(12, 1))
    loss = lambda: float(((net._forward(x, False)["y"] - y) ** 2).mean())
    s = net._forward(x, False)
    grads = net._backward(s, 2 * (s["y"] - y) / y.size)
    for name in ("we", "wq", "bk", "wv", "wo", "wh", "by"):
        w = net.params[name]
        i = np.unravel_index(w.size // 2, w.shape)
        keep = w[i]
        w[i] = keep + 1e-5
        up = loss()
        w[i] = keep - 1e-5
        down = loss()
        w[i] = keep
        assert grads[name][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    losses = net.fit(x, y)
    assert losses[-1] < losses[0]
    assert net.attention(x).sum(1) == pytest.approx(np.ones(5))


def test_matrix_view(spark):
    df = make(spark, range(1, 21))
    out = read(forecast.matrix(df, models.autoregression(1, 2).roll_validate(df), 2), "t", "y", "yf_1", "yf_2")
    assert out[0] == (0, 1, 0, 0) and out[-1][2] == pytest.approx(20) and len(out) == 20
