"""DuckDB SQL for the queries: the same models written a second time, from scratch, so that results can be held against each other.

Least squares is Gaussian elimination on covariances, one common table expression for each pivot; recursive forecasts are one for each horizon.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SERIES = {
    "events_hourly": """
        raw_series AS (SELECT coalesce(event_type, '_') AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS y, CAST(count(*) AS DOUBLE) AS x1
                       FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)""",
    "orders_weekly": """
        raw_series AS (SELECT coalesce(o_orderpriority, '_') AS series_id, date_trunc('week', o_orderdate) AS ts, CAST(count(*) AS DOUBLE) AS y, round(avg(o_totalprice) / 1000, 3) AS x1
                       FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2)""",
    "ship_weekly": """
        raw_series AS (SELECT coalesce(l_returnflag, '_') AS series_id, date_trunc('week', l_shipdate) AS ts, round(sum(l_quantity) / 100, 2) AS y, round(sum(l_extendedprice) / 1000000, 4) AS x1
                       FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2)""",
}
BY_TIME = "(PARTITION BY series_id ORDER BY t)"
WHOLE = "(PARTITION BY series_id)"


def series(source: str) -> str:
    return SERIES[source] + ",\ns AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS t, coalesce(y, 0.0) AS y, coalesce(x1, 0.0) AS x1 FROM raw_series)"


def lag(x: str, k: int) -> str:
    return f"CASE WHEN t < {k} THEN first_value({x}) OVER {BY_TIME} ELSE lag({x}, {k}) OVER {BY_TIME} END"


def backfilled(x: str) -> str:
    t0, v0 = f"min(t) FILTER (WHERE {x} <> 0) OVER {WHOLE}", f"arg_min({x}, t) FILTER (WHERE {x} <> 0) OVER {WHOLE}"
    return f"CASE WHEN t < {t0} THEN {v0} * pow(3.0, CAST(t - ({t0}) AS DOUBLE)) ELSE {x} END"


def trend(i: int, lwave: int = 20) -> str:
    m = f"CAST(count(*) OVER {WHOLE} AS DOUBLE)"
    return (f"t / {m}", f"(t - {m} / 2) * (t - {m} / 2) / (({m} / 2) * ({m} / 2))", f"sin(2 * pi() * t / {lwave})", f"cos(2 * pi() * t / {lwave})")[i - 1]


def scale(x: str, scaler: str | None) -> tuple[str, str]:
    """Shift and scale of x over its series."""
    if scaler is None:
        return "0.0::DOUBLE", "1.0::DOUBLE"
    if scaler in ("standard", "log"):
        return f"avg({x}) OVER {WHOLE}", f"(CASE WHEN stddev_pop({x}) OVER {WHOLE} = 0 THEN 1.0 ELSE stddev_pop({x}) OVER {WHOLE} END)"
    span = f"(max({x}) OVER {WHOLE} - min({x}) OVER {WHOLE})"
    return f"min({x}) OVER {WHOLE}", f"((CASE WHEN {span} = 0 THEN 1.0 ELSE {span} END) / 4.0)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def rounded(names: list[str], digits: int) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


@dataclass
class ModelSql:
    """``endo`` and ``exo``: symbolic functions as templates over {x}, None for a linear model.  ``kernel``: ols, ar (window rows with all lags only), mle or adjusted (Yule-Walker), or mean (no slopes)."""

    source: str
    p: int
    horizons: int
    q: int = 0
    trend: int = 1
    scaler: str | None = None
    endo: tuple[str, ...] | None = None
    exo: tuple[str, ...] = ()
    cross: bool = False
    direct: bool = False
    rolling: bool = False
    growing: bool = False
    rc: int = 2
    kernel: str = "ols"
    leak_free: bool = False
    skip: int = 0
    clip: bool = True
    parts: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.endo_blocks = ["y", *[f"f{k}_y" for k in range(1, len(self.endo or ()) + 1)]]
        self.exo_blocks = ["x1", *([f"g{i}_x1" for i in range(1, len(self.exo) + 1)] if self.endo is not None else []), *(["c1"] if self.cross else [])] if self.q else []
        self.design = [f"trend_{i}" for i in range(1, self.trend)] + [f"{b}_lag{k}" for blocks, n in ((self.endo_blocks, self.p), (self.exo_blocks, self.q)) for b in blocks for k in range(n, 0, -1)]
        self.targets = [f"base_y_h{h}" for h in range(1, self.horizons + 1)] if self.direct else ["base_y"]
        self.parts += [series(self.source)]
        self._features()
        self._fit()
        self._forecast()

    def _blocks(self, name: str, before: str, raw: dict[str, str]) -> None:
        if self.scaler == "log":
            raw = {b: f"ln(1 + ({x}))" for b, x in raw.items()}
        self.parts.append(f"{name}_raw AS (SELECT *, {', '.join(f'{x} AS raw_{b}' for b, x in raw.items())} FROM {before})")
        limits = {b: scale(f"raw_{b}", self.scaler) for b in raw}
        self.parts.append(f"{name}_lim AS (SELECT *, {', '.join(f'{a} AS {b}_shift, {c} AS {b}_scale' for b, (a, c) in limits.items())} FROM {name}_raw)")
        self.parts.append(f"{name} AS (SELECT *, {', '.join(f'(raw_{b} - {b}_shift) / {b}_scale AS base_{b}' for b in raw)} FROM {name}_lim)")

    def _features(self) -> None:
        self.parts.append(f"filled AS (SELECT *, {backfilled('x1')} AS b_x1, count(*) OVER {WHOLE} AS n FROM s)")
        self._blocks("endo", "filled", {"y": "y"} | {f"f{k}_y": f.format(x="y") for k, f in enumerate(self.endo or (), 1)})
        last = "endo"
        if self.exo_blocks:
            raw = {"x1": "b_x1"} | ({f"g{i}_x1": g.format(x="b_x1") for i, g in enumerate(self.exo, 1)} if self.endo is not None else {}) | ({"c1": "base_y * b_x1"} if self.cross else {})
            self._blocks("exo", "endo", raw)
            last = "exo"
        columns = [f"{trend(i)} AS trend_{i}" for i in range(1, self.trend)]
        columns += [f"{lag('base_' + b, k)} AS {b}_lag{k}" for blocks, n in ((self.endo_blocks, self.p), (self.exo_blocks, self.q)) for b in blocks for k in range(n, 0, -1)]
        columns += [f"lead(base_y, {h - 1}, 0.0) OVER {BY_TIME} AS base_y_h{h}" for h in range(1, self.horizons + 1)] if self.direct else []
        self.parts.append(f"design AS (SELECT *, {', '.join(columns)} FROM {last})")

    def _fit(self) -> None:
        k, names = len(self.design), [*self.design, *self.targets]
        lost = self.horizons - 1 if self.direct and self.leak_free else 0
        if self.rolling:
            size = "(4 * n) // 5"
            self.parts.append(f"folds AS (SELECT series_id, i // {self.rc} AS fold, {'0' if self.growing else 'i'} AS lo, tr + i AS hi FROM (SELECT series_id, {size} AS tr, unnest(range(0, n - {size}, {self.rc})) AS i FROM (SELECT DISTINCT series_id, n FROM design)))")
            head = f" + {self.p}" if self.kernel == "ar" else ""
            self.parts.append(f"train AS (SELECT d.*, f.fold FROM design d JOIN folds f ON d.series_id = f.series_id AND d.t >= f.lo{head} AND d.t < f.hi - {lost})")
        else:
            self.parts.append(f"train AS (SELECT *, 0 AS fold FROM design WHERE t >= {self.p if self.kernel == 'ar' else 0} AND t < n - {lost})")
        if self.kernel in ("mle", "adjusted"):
            self._levinson()
            return
        if self.kernel == "mean":
            self.parts.append(f"params AS (SELECT series_id, fold, {', '.join([f'avg({x}) AS beta_{h}_0' for h, x in enumerate(self.targets)] + [f'0.0::DOUBLE AS beta_{h}_{j}' for h in range(len(self.targets)) for j in range(1, k + 1)])} FROM train GROUP BY series_id, fold)")
            return
        sums = [f"avg({x}) AS m_{i}" for i, x in enumerate(names)] + [f"covar_pop({names[i]}, {names[j]}) AS a_{i}_{j}" for i in range(k) for j in range(i, len(names))]
        self.parts.append(f"e0 AS (SELECT series_id, fold, {', '.join(sums)} FROM train GROUP BY series_id, fold)")
        for p in range(k):
            new = ", ".join(f"a_{i}_{j} - a_{p}_{i} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}" for i in range(p + 1, k) for j in range(i, len(names)))
            self.parts.append(f"e{p + 1} AS (SELECT * {f'REPLACE ({new})' if new else ''} FROM e{p})")
        last = f"e{k}"
        for p in reversed(range(k)):
            terms = [f"(a_{p}_{k + h}{''.join(f' - a_{p}_{j} * beta_{h}_{j + 1}' for j in range(p + 1, k))}) / a_{p}_{p} AS beta_{h}_{p + 1}" for h in range(len(self.targets))]
            self.parts.append(f"u{p} AS (SELECT *, {', '.join(terms)} FROM {last})")
            last = f"u{p}"
        const = [f"m_{k + h}{''.join(f' - beta_{h}_{j + 1} * m_{j}' for j in range(k))} AS beta_{h}_0" for h in range(len(self.targets))]
        self.parts.append(f"params AS (SELECT series_id, fold, {', '.join([*const, *[f'beta_{h}_{j}' for h in range(len(self.targets)) for j in range(1, k + 1)]])} FROM {last})")

    def _back(self, x: str) -> str:
        return f"exp({x} * y_scale + y_shift) - 1" if self.scaler == "log" else f"{x} * y_scale + y_shift"

    def _levinson(self) -> None:
        """Yule-Walker: autocovariances of each training window, then one common table expression for each order."""
        p, less = self.p, int(self.kernel == "adjusted")
        self.parts.append("centred AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id, fold) AS c FROM train)")
        lags = ", ".join(f"lag(c, {k}) OVER (PARTITION BY series_id, fold ORDER BY t) AS c_{k}" for k in range(1, p + 1))
        self.parts.append(f"lagged AS (SELECT *, {lags} FROM centred)")
        cov = ", ".join(f"sum(c * {f'c_{k}' if k else 'c'}) / (count(*) - {k * less}) AS r_{k}" for k in range(p + 1))
        self.parts.append(f"lev_0 AS (SELECT series_id, fold, avg(y) AS mu, {cov} FROM lagged GROUP BY series_id, fold)")
        for m in range(1, p + 1):
            top = f"r_{m}" + "".join(f" - a_{m - 1}_{i} * r_{m - i}" for i in range(1, m))
            error = "r_0" + "".join(f" - a_{m - 1}_{i} * r_{i}" for i in range(1, m))
            self.parts.append(f"ref_{m} AS (SELECT *, ({top}) / ({error}) AS a_{m}_{m} FROM lev_{m - 1})")
            rest = "".join(f", a_{m - 1}_{i} - a_{m}_{m} * a_{m - 1}_{m - i} AS a_{m}_{i}" for i in range(1, m))
            self.parts.append(f"lev_{m} AS (SELECT *{rest} FROM ref_{m})")
        total = " - ".join(["1", *(f"a_{p}_{k}" for k in range(1, p + 1))])
        self.parts.append(f"params AS (SELECT series_id, fold, mu * ({total}) AS beta_0_0, {', '.join(f'a_{p}_{p - j + 1} AS beta_0_{j}' for j in range(1, p + 1))} FROM lev_{p})")

    def _forecast(self) -> None:
        if self.rolling:
            self.parts.append(f"rows_0 AS (SELECT d.*, p.* EXCLUDE (series_id) FROM design d JOIN params p ON d.series_id = p.series_id AND p.fold = (d.t - (4 * d.n) // 5) // {self.rc} WHERE d.t >= (4 * d.n) // 5)")
        else:
            self.parts.append(f"rows_0 AS (SELECT d.*, p.* EXCLUDE (series_id) FROM design d JOIN params p ON d.series_id = p.series_id WHERE d.t >= {self.skip})")
        for h in range(1, self.horizons + 1):
            target, ahead, at, terms = (h - 1, 1, 0, []) if self.direct else (0, h, 0, [])
            for i in range(1, self.trend):
                at += 1
                terms.append(f"beta_{target}_{at} * trend_{i}")
            for b in self.endo_blocks:
                for k in range(self.p, 0, -1):
                    at += 1
                    terms.append(f"beta_{target}_{at} * " + (f"{b}_lag{k - ahead + 1}" if k >= ahead else f"v_{b}_{ahead - k}"))
            for b in self.exo_blocks:
                for k in range(self.q, 0, -1):
                    at += 1
                    terms.append(f"beta_{target}_{at} * {b}_lag{max(1, k - (ahead - 1))}")
            value = f"beta_{target}_0 + " + " + ".join(terms)
            clipped = f"CASE WHEN isnan({value}) THEN 'NaN'::DOUBLE ELSE greatest({value}, 0.0) END" if self.clip else value
            self.parts.append(f"step_{h} AS (SELECT *, {clipped} AS s_{h} FROM rows_{h - 1})")
            seen = [f"s_{h} AS v_y_{h}"] + [f"({f.format(x=f'({self._back(f"s_{h}")})')} - f{i}_y_shift) / f{i}_y_scale AS v_f{i}_y_{h}" for i, f in enumerate(self.endo or (), 1)]
            self.parts.append(f"rows_{h} AS (SELECT *, {', '.join(seen)} FROM step_{h})")
        self.parts.append(f"forecasts AS (SELECT series_id, fold, t, y, {', '.join(f'{self._back(f"s_{h}")} AS yf_{h}' for h in range(1, self.horizons + 1))} FROM rows_{self.horizons})")
        pairs = " UNION ALL ".join(f"SELECT series_id, {h} AS h, lead(y, {h - 1}) OVER {BY_TIME} AS y, yf_{h} AS y_hat FROM forecasts" for h in range(1, self.horizons + 1))
        self.parts.append(f"pairs AS (SELECT * FROM ({pairs}) WHERE y IS NOT NULL)")

    def forecasts(self, digits: int = 3) -> str:
        names = [f"yf_{h}" for h in range(1, self.horizons + 1)]
        return f"{ctes(*self.parts)} SELECT series_id, CAST(fold AS BIGINT) AS fold, t, y, {rounded(names, digits)} FROM forecasts"

    def metrics(self, digits: int = 3) -> str:
        return f"{ctes(*self.parts)} {metrics_from('pairs', digits)}"

    def coefficients(self, digits: int = 4) -> str:
        terms = ["const", *self.design]
        rows = " UNION ALL ".join(f"SELECT series_id, CAST(fold AS BIGINT) AS fold, {h + 1} AS h, '{t}' AS term, round(beta_{h}_{j}, {digits}) + 0.0 AS coef FROM params" for h in range(len(self.targets)) for j, t in enumerate(terms))
        return f"{ctes(*self.parts)} {rows}"

    def over_design(self, columns: str, tail: str = "") -> str:
        """Any selection from the design matrix."""
        upto = next(i for i, x in enumerate(self.parts) if x.startswith("design AS"))
        return f"{ctes(*self.parts[: upto + 1])} SELECT {columns} FROM design {tail}"

    def features(self, names: list[str], digits: int = 6) -> str:
        return self.over_design(f"series_id, t, {rounded(names, digits)}")


def metrics_from(pairs: str, digits: int = 3) -> str:
    r2 = "(CASE WHEN var_pop(y) = 0 THEN 0.0 ELSE 1 - sum((y - y_hat) * (y - y_hat)) / (var_pop(y) * count(*)) END)"
    values = {
        "mse": "avg((y - y_hat) * (y - y_hat))",
        "mae": "avg(abs(y - y_hat))",
        "r2": r2,
        "r2bar": f"CASE WHEN count(*) <= 2 THEN 'NaN'::DOUBLE ELSE 1 - (1 - {r2}) * (count(*) - 1) / (count(*) - 2) END",
        "smape": "100 * avg(2 * abs(y - y_hat) / (abs(y) + abs(y_hat) + 1e-10))",
    }
    return f"SELECT series_id, h, {', '.join(f'round({x}, {digits}) + 0.0 AS {k}' for k, x in values.items())}, count(*) AS m FROM {pairs} GROUP BY series_id, h"
