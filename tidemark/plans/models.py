"""Models: a specification, a strategy and a way to estimate, composed from the operators into one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.symbolic import DEFAULT, Symbolic
from tidemark.operators import estimators, features, forecast, metrics
from tidemark.plans.spec import ModelSpec, check_range

STRATEGIES = ("recursive", "direct")


class Forecasts(Protocol):
    """What evaluation asks of any model, so that one may write one's own: a fit, and forecasts (series_id, fold, t, y, yf_1 ..) by it."""

    def fit(self, design: DataFrame, folds: dict | None = None) -> Fitted: ...

    def in_sample(self, series: DataFrame, start: int = -1, end: int = -1) -> DataFrame: ...

    def roll_validate(self, series: DataFrame, rc: int = 2, growing: bool = False) -> DataFrame: ...


@dataclass(frozen=True)
class Fitted:
    """Coefficients of every training window, and the model they are of."""

    model: Model
    params: DataFrame

    def coefficients(self) -> DataFrame:
        """(series_id, fold, h, term, coef): the long form; h is 1 for recursive models."""
        terms = F.array(*[F.lit(t) for t in ["const", *self.model.spec.design]])
        each = self.params.select("series_id", "fold", F.posexplode("coef").alias("i", "c"))
        long = each.select("series_id", "fold", (F.col("i") + 1).alias("h"), F.posexplode("c").alias("j", "coef"))
        return long.select("series_id", "fold", "h", F.element_at(terms, F.col("j") + 1).alias("term"), "coef")

    def forecasts(self, series: DataFrame) -> DataFrame:
        """(series_id, fold, t, y, yf_1 ..) for all steps from ``skip`` on, by these coefficients of whole series."""
        rows = self.model.design(series).filter(F.col("t") >= self.model.spec.first)
        return self.model._forecast(rows.join(self.params.select("series_id", "fold", "coef"), "series_id"))


@dataclass(frozen=True)
class Model:
    """``strategy``: "recursive" feeds forecasts back, "direct" has a regression for each horizon.

    ``kernel``: "sm_ols" or "sk_lr"; "ar_ols", "mle" or "adjusted" for autoregressions, whose forecasts aren't clipped; "gram" for series too long for a
    task, by aggregation; or a function of one's own (``estimators.Kernel``).
    ``leak_free``: direct models normally train on targets that reach past the end of their window, with zeros past the end of the
    series; this leaves those rows out.
    """

    spec: ModelSpec
    strategy: str = "recursive"
    kernel: str | estimators.Kernel = "sm_ols"
    leak_free: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {STRATEGIES}")
        if not callable(self.kernel) and self.kernel not in (*estimators.KERNELS, "gram"):
            raise ValueError(f"kernel is a function or one of {(*estimators.KERNELS, 'gram')}")
        if self.kernel == "gram" and (self.strategy == "direct" or self.leak_free):
            raise ValueError("Gram matrices are for recursive models")
        if self.spec.given is not None and self.strategy == "recursive" and self.spec.horizons > 1:
            raise ValueError("given columns are known one step ahead: take a direct model for more")

    def __repr__(self) -> str:
        s = self.spec
        kernel = getattr(self.kernel, "__name__", type(self.kernel).__name__) if callable(self.kernel) else self.kernel
        return f"{self.strategy}(p={s.p}, q={s.q}, n_exo={s.n_exo}), hh = {s.horizons}, skip = {s.first}, method={kernel}"

    def design(self, series: DataFrame) -> DataFrame:
        """Features and targets of every step."""
        if not isinstance(series, DataFrame):
            raise TypeError("a series table is a DataFrame")
        missing = {"series_id", "t", "y", *[f"x{j}" for j in range(1, self.spec.n_exo + 1)], *(self.spec.given or ())} - set(series.columns)
        if missing:
            raise ValueError(f"the series table lacks {sorted(missing)}")
        df = features.design_matrix(series, self.spec)
        return features.lead_matrix(df, self.spec.horizons, "base_y") if self.strategy == "direct" else df

    def _targets(self) -> list[str]:
        return [f"base_y_h{h}" for h in range(1, self.spec.horizons + 1)] if self.strategy == "direct" else ["base_y"]

    def fit(self, design: DataFrame, folds: dict | None = None) -> Fitted:
        """Coefficients over the whole series, or over each window of ``folds`` = {"rc", "growing"}."""
        if self.kernel == "gram":
            return Fitted(self, self._by_gram(design, folds))
        return Fitted(self, estimators.fit_series(design, self.spec.design, self._targets(), folds, self.kernel, self.spec.p, self.leak_free))

    def with_params(self, params: DataFrame) -> Fitted:
        """The model with coefficients from elsewhere: (series_id, fold, coef), an array for each target in ``coef``."""
        if not isinstance(params, DataFrame):
            raise TypeError("parameters are a DataFrame")
        if missing := {"series_id", "fold", "coef"} - set(params.columns):
            raise ValueError(f"the parameters lack {sorted(missing)}")
        if params.isEmpty():
            raise ValueError("there are no parameters")
        return Fitted(self, params)

    def _by_gram(self, design: DataFrame, folds: dict | None) -> DataFrame:
        """(series_id, fold, coef) by aggregation, however long a series is."""
        x, y = self.spec.design, self._targets()[0]
        if folds is None:
            sums = estimators.gram(design, x, y).withColumn("fold", F.lit(0).cast("long"))
        else:
            sums = estimators.rolling_gram(design, x, y, folds["rc"], folds["growing"])
        solved = estimators.solve_gram(sums, len(x), ("series_id", "fold"))
        return solved.select("series_id", "fold", F.array("coef").alias("coef"))

    def _forecast(self, rows: DataFrame) -> DataFrame:
        if self.spec.given is not None:
            made = forecast.of_given(rows, self.spec)
        elif self.strategy == "direct":
            made = forecast.direct(rows, self.spec)
        else:
            made = forecast.recursive(rows, self.spec, False if self.kernel in ("ar_ols", "mle", "adjusted") else None)
        return forecast.unscaled(made, self.spec)

    def _tested(self, design: DataFrame, folds: dict | None) -> DataFrame:
        """The rows to forecast beside their coefficients; one pass over the design, but for Gram matrices, which come from an aggregation."""
        blocks = self.spec.endo_blocks if self.spec.given is None else ["y"]
        carry = ["y", *(f"{b}_{k}" for b in blocks for k in ("shift", "scale"))]
        if self.kernel != "gram":
            return estimators.fitted_rows(design, self.spec.design, self._targets(), folds, self.kernel, self.spec.p, carry, self.leak_free)
        params = self._by_gram(design, folds)
        if folds is None:
            return design.join(params, "series_id")
        start = F.floor(4 * F.col("n") / 5)
        rows = design.filter(F.col("t") >= start).withColumn("fold", F.floor((F.col("t") - start) / folds["rc"]).cast("long"))
        return rows.join(params, ["series_id", "fold"])

    def in_sample(self, series: DataFrame, start: int = -1, end: int = -1) -> DataFrame:
        """(series_id, fold, t, y, yf_1 ..) for steps [start, end), fitted on everything; -1: from ``skip``, to the end.

        Steps that do not lie in the shortest series are an error; to know that, the lengths are counted if a limit is given.
        """
        rows = self._tested(self.design(series), None)
        if start == end == -1:
            return self._forecast(rows.filter(F.col("t") >= self.spec.first))
        shortest = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
        begin, stop = check_range(start, end, shortest, self.spec.first)
        inside = rows.filter(F.col("t") >= begin)
        return self._forecast(inside if end == -1 else inside.filter(F.col("t") < stop))

    def roll_validate(self, series: DataFrame, rc: int = 2, growing: bool = False) -> DataFrame:
        """The same for the last fifth of each series, fitted anew every ``rc`` steps on the window before: of fixed length, or growing.

        All windows of all series are fitted side by side.
        """
        return self._forecast(self._tested(self.design(series), {"rc": rc, "growing": growing}))

    def diagnose(self, forecasts: DataFrame) -> DataFrame:
        """(series_id, h, metrics): each horizon's forecasts against the values they were for."""
        return metrics.by_horizon(forecast.with_actuals(forecasts, self.spec.horizons))


def autoregression(p: int, horizons: int, method: str = "sm_ols", skip: int | None = None) -> Model:
    """An AR(p) by least squares ("sm_ols") or Yule-Walker ("mle", "adjusted"); forecasting starts at step p at the earliest."""
    spec = ModelSpec(p=p, horizons=horizons, skip=max(p, p if skip is None else skip))
    return Model(spec, "recursive", {"sm_ols": "ar_ols", "mle": "mle"}.get(method, "adjusted"))


def linear(spec: ModelSpec, strategy: str = "recursive", leak_free: bool = False) -> Model:
    """Lags of the series and of exogenous series, or given columns.  Unless the specification says how to solve, direct models take "sk_lr" and recursive ones "sm_ols"."""
    if spec.endo_fns is not None:
        raise ValueError("a linear model has no symbolic functions")
    return Model(spec, strategy, spec.lstsq or ("sk_lr" if strategy == "direct" else "sm_ols"), leak_free)


def symbolic(spec: ModelSpec, strategy: str = "recursive", endo_fns: tuple[Symbolic, ...] | None = None, exo_fns: tuple[Symbolic, ...] | None = None, leak_free: bool = False) -> Model:
    """Lags of functions of the series besides; by default x**1.5, x**0.5 and log1p."""
    functions = {"endo_fns": DEFAULT if endo_fns is None else endo_fns, "exo_fns": DEFAULT if exo_fns is None else exo_fns}
    return Model(replace(spec, **functions), strategy, spec.lstsq or "sm_ols", leak_free)
