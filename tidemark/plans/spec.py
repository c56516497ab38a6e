"""Model specifications: plan-time constants, checked once, and the names of the columns they give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from tidemark.functions.symbolic import Symbolic


Aggregate = Callable[[Column], Column]


def _same(x: Column) -> Column:
    return x


@dataclass(frozen=True)
class Scaler:
    """A transform (into(x) - shift) / scale, and out of it again.  ``fit`` gives shift and scale from aggregates over into(x) of all of a series.

    ``into`` and ``out_of`` are any function and its inverse, by default none, which makes the transform affine.
    """

    name: str
    fit: Callable[[Column, Aggregate], tuple[Column, Column]]
    #: Whether scaled values keep the sign, so that negative forecasts may be clipped.
    keeps_sign: bool = True
    into: Callable[[Column], Column] = _same
    out_of: Callable[[Column], Column] = _same


@dataclass(frozen=True)
class ModelSpec:
    """``p`` and ``q``: lags of the series and of exogenous series.  ``trend`` 1 (none) to 5.  ``horizons``: steps ahead.

    ``skip``: steps before the first forecast, ``p`` if not given.  ``endo_fns``: None for a linear model, else the functions of a
    symbolic one (an empty tuple is allowed).  ``cross``: products of the series with exogenous ones, in symbolic models only.
    ``lstsq``: "sm_ols" solves [1, X] by least norm, "sk_lr" the centred system; at full rank they agree.  If it is not given, a model decides.
    ``given``: names of feature columns that the series table brings along, in place of lags; then no scaler, and one step ahead or a direct model.
    """

    p: int = 6
    q: int = 0
    trend: int = 1
    horizons: int = 1
    cross: bool = False
    skip: int | None = None
    n_exo: int = 0
    scaler: Scaler | None = None
    endo_fns: tuple[Symbolic, ...] | None = None
    exo_fns: tuple[Symbolic, ...] = ()
    lstsq: str | None = None
    lwave: int = 20
    given: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.p < 1:
            raise ValueError("p must be at least 1: a model needs a lag")
        if not 1 <= self.trend <= 5:
            raise ValueError("trend must lie between 1 and 5")
        if self.horizons < 1:
            raise ValueError("horizons must be at least 1")
        if self.n_exo and self.q < 1:
            raise ValueError("exogenous series need q of at least 1")
        if self.lstsq not in (None, "sm_ols", "sk_lr"):
            raise ValueError("lstsq is sm_ols or sk_lr")
        if self.given is not None:
            if isinstance(self.given, str) or not all(isinstance(c, str) for c in self.given):
                raise TypeError("given is a tuple of column names")
            if not self.given:
                raise ValueError("given names no column")
            if self.scaler is not None or self.endo_fns is not None:
                raise ValueError("given columns are taken as they are: no scaler, no symbolic functions")

    @property
    def first(self) -> int:
        return self.p if self.skip is None else self.skip

    @property
    def clips(self) -> bool:
        return self.scaler is None or self.scaler.keeps_sign

    @property
    def endo_blocks(self) -> list[str]:
        return ["y", *[f"f{k}_y" for k in range(1, len(self.endo_fns or ()) + 1)]]

    @property
    def exo_blocks(self) -> list[str]:
        if not self.n_exo:
            return []
        js = range(1, self.n_exo + 1)
        plain = [f"x{j}" for j in js]
        if self.endo_fns is None:
            return plain
        return plain + [f"g{i}_x{j}" for i in range(1, len(self.exo_fns) + 1) for j in js] + ([f"c{j}" for j in js] if self.cross else [])

    @property
    def trend_columns(self) -> list[str]:
        return [f"trend_{i}" for i in range(1, self.trend)]

    @property
    def design(self) -> list[str]:
        """Columns of the design matrix, the intercept left out.  Within a block the oldest lag comes first."""
        if self.given is not None:
            return list(self.given)
        lags = lambda blocks, n: [f"{b}_lag{k}" for b in blocks for k in range(n, 0, -1)]
        return self.trend_columns + lags(self.endo_blocks, self.p) + lags(self.exo_blocks, self.q)


def check_range(start: int, end: int, n: int, skip: int) -> tuple[int, int]:
    """The steps [start, end) to forecast of a series of n steps; -1 stands for ``skip`` and for n.  Anything else out of the series is an error."""
    a, b = skip if start == -1 else start, n if end == -1 else end
    if not 0 <= a < b <= n:
        raise ValueError(f"steps [{a}, {b}) do not lie in a series of {n}")
    return a, b
