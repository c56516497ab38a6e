"""Small neural regressors, trained series by series in grouped tasks with NumPy and Adam.

A three-layer perceptron, and an attention regressor that treats each scalar feature as a token and gives the attention between
features.  Seeds are fixed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A loss: from the errors of a batch, its value and its slope in each error.
Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def squared(off: np.ndarray) -> tuple[float, np.ndarray]:
    return float((off * off).mean()), 2 * off / off.size


def absolute(off: np.ndarray) -> tuple[float, np.ndarray]:
    return float(np.abs(off).mean()), np.sign(off) / off.size


def huber(off: np.ndarray) -> tuple[float, np.ndarray]:
    """Squared up to 1, linear beyond."""
    size = np.abs(off)
    return float(np.where(size <= 1, 0.5 * off * off, size - 0.5).mean()), np.clip(off, -1, 1) / off.size


LOSSES: dict[str, Loss] = {"mse": squared, "mae": absolute, "huber": huber}


def loss_of(loss: str | Loss) -> Loss:
    """A loss by its name, or one's own."""
    if callable(loss):
        return loss
    if loss not in LOSSES:
        raise ValueError(f"the loss is a function or one of {sorted(LOSSES)}")
    return LOSSES[loss]


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.999**self.step)
            self.params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def _layer(rng: np.random.Generator, n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    bound = 1 / np.sqrt(n_in)
    return rng.uniform(-bound, bound, (n_in, n_out)), rng.uniform(-bound, bound, n_out)


class Perceptron:
    """One hidden layer of tanh units, full batches."""

    def __init__(self, n_in: int, n_out: int = 1, hidden: int = 32, rate: float = 0.01, epochs: int = 100, seed: int = 0, loss: str | Loss = "mse"):
        self.loss = loss_of(loss)
        rng = np.random.default_rng(seed)
        (w1, b1), (w2, b2) = _layer(rng, n_in, hidden), _layer(rng, hidden, n_out)
        self.params, self.rate, self.epochs = {"w1": w1, "b1": b1, "w2": w2, "b2": b2}, rate, epochs

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        return np.tanh(x @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]

    def fit(self, x: np.ndarray, y: np.ndarray) -> list[float]:
        """The loss of each epoch."""
        adam, losses = Adam(self.params, self.rate), []
        for _ in range(self.epochs):
            p = self.params
            hidden = np.tanh(x @ p["w1"] + p["b1"])
            value, d = self.loss(hidden @ p["w2"] + p["b2"] - y)
            losses.append(value)
            back = (d @ p["w2"].T) * (1 - hidden * hidden)
            adam.update({"w2": hidden.T @ d, "b2": d.sum(0), "w1": x.T @ back, "b1": back.sum(0)})
        return losses


class AttentionRegressor:
    """Feature -> token of ``width`` -> multi-head self-attention -> mean over tokens -> tanh layer with dropout -> one number."""

    def __init__(self, width: int = 72, heads: int = 4, hidden: int = 64, dropout: float = 0.1, rate: float = 0.001, epochs: int = 100, batch: int = 116, seed: int = 0, loss: str | Loss = "mse"):
        self.loss = loss_of(loss)
        if width % heads:
            raise ValueError("the width is a multiple of the heads")
        self.rng = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {}
        for name, n_in, n_out in (("e", 1, width), ("q", width, width), ("k", width, width), ("v", width, width), ("o", width, width), ("h", width, hidden), ("y", hidden, 1)):
            p[f"w{name}"], p[f"b{name}"] = _layer(self.rng, n_in, n_out)
        self.params, self.heads, self.dropout, self.rate, self.epochs, self.batch = p, heads, dropout, rate, epochs, batch

    def _split(self, x: np.ndarray) -> np.ndarray:
        b, n, w = x.shape
        return x.reshape(b, n, self.heads, w // self.heads).transpose(0, 2, 1, 3)

    def _forward(self, x: np.ndarray, train: bool) -> dict[str, np.ndarray]:
        p, s = self.params, {"x": x}
        s["e"] = x[:, :, None] * p["we"][0] + p["be"]
        for n in "qkv":
            s[n] = self._split(s["e"] @ p[f"w{n}"] + p[f"b{n}"])
        logits = s["q"] @ s["k"].transpose(0, 1, 3, 2) / np.sqrt(s["q"].shape[-1])
        a = np.exp(logits - logits.max(-1, keepdims=True))
        s["a"] = a / a.sum(-1, keepdims=True)
        mixed = s["a"] @ s["v"]
        s["c"] = mixed.transpose(0, 2, 1, 3).reshape(s["e"].shape)
        s["m"] = (s["c"] @ p["wo"] + p["bo"]).mean(1)
        s["t"] = np.tanh(s["m"] @ p["wh"] + p["bh"])
        s["drop"] = (self.rng.random(s["t"].shape) >= self.dropout) / (1 - self.dropout) if train else np.ones_like(s["t"])
        s["y"] = (s["t"] * s["drop"]) @ p["wy"] + p["by"]
        return s

    def _backward(self, s: dict[str, np.ndarray], d: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.params, {}
        g["wy"], g["by"] = (s["t"] * s["drop"]).T @ d, d.sum(0)
        dt = (d @ p["wy"].T) * s["drop"] * (1 - s["t"] ** 2)
        g["wh"], g["bh"] = s["m"].T @ dt, dt.sum(0)
        n = s["x"].shape[1]
        dm = np.repeat((dt @ p["wh"].T)[:, None, :] / n, n, axis=1)
        flat = lambda x: x.reshape(-1, x.shape[-1])
        g["wo"], g["bo"] = flat(s["c"]).T @ flat(dm), flat(dm).sum(0)
        dc = self._split(dm @ p["wo"].T)
        da, dv = dc @ s["v"].transpose(0, 1, 3, 2), s["a"].transpose(0, 1, 3, 2) @ dc
        dl = s["a"] * (da - (da * s["a"]).sum(-1, keepdims=True)) / np.sqrt(s["q"].shape[-1])
        parts = {"q": dl @ s["k"], "k": dl.transpose(0, 1, 3, 2) @ s["q"], "v": dv}
        de = np.zeros_like(s["e"])
        for name, dx in parts.items():
            dx = dx.transpose(0, 2, 1, 3).reshape(s["e"].shape)
            g[f"w{name}"], g[f"b{name}"] = flat(s["e"]).T @ flat(dx), flat(dx).sum(0)
            de += dx @ p[f"w{name}"].T
        g["we"], g["be"] = (de * s["x"][:, :, None]).sum((0, 1))[None, :], de.sum((0, 1))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray) -> list[float]:
        adam, losses = Adam(self.params, self.rate), []
        for _ in range(self.epochs):
            total = 0.0
            for a in range(0, len(x), self.batch):
                s = self._forward(x[a : a + self.batch], True)
                off = s["y"] - y[a : a + self.batch]
                value, d = self.loss(off)
                total += value * len(off)
                adam.update(self._backward(s, d))
            losses.append(total / max(len(x), 1))
        return losses

    def attention(self, x: np.ndarray) -> np.ndarray:
        """(query, key): attention between features over the last batch, mean over heads and rows."""
        last = x[(len(x) - 1) // self.batch * self.batch :]
        return self._forward(last, False)["a"].mean((0, 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[a : a + self.batch], False)["y"] for a in range(0, len(x), self.batch)])


def _arrays(design: DataFrame, x: list[str], y: list[str]) -> DataFrame:
    return design.select("series_id", "t", F.array(*x).alias("x"), F.array(*y).alias("y"))


def _read(pdf: pd.DataFrame) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("t")
    return pdf["series_id"].iloc[0], pdf["t"].to_numpy(), np.array(pdf["x"].tolist(), np.float64), np.array(pdf["y"].tolist(), np.float64)


def perceptron_forecasts(design: DataFrame, x: list[str], y: list[str], hidden: int = 32, rate: float = 0.01, epochs: int = 100, seed: int = 0, loss: str | Loss = "mse") -> DataFrame:
    """(series_id, t, h, y, y_hat, first_loss, last_loss), in the units of the targets: fitted on the first four fifths of a series, forecast for the rest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sid, t, a, b = _read(pdf)
        cut = len(t) - -(-len(t) // 5)
        net = Perceptron(a.shape[1], b.shape[1], hidden, rate, epochs, seed, loss)
        losses = net.fit(a[:cut], b[:cut]) if cut else [np.nan]
        out = net.predict(a[cut:])
        m, hs = len(t) - cut, b.shape[1]
        return pd.DataFrame({"series_id": sid, "t": np.repeat(t[cut:], hs), "h": np.tile(np.arange(1, hs + 1, dtype=np.int32), m), "y": b[cut:].ravel(), "y_hat": out.ravel(), "first_loss": losses[0], "last_loss": losses[-1]})

    return _arrays(design, x, y).groupBy("series_id").applyInPandas(run, "series_id string, t long, h int, y double, y_hat double, first_loss double, last_loss double")


def attention_scores(design: DataFrame, x: list[str], y: str, epochs: int = 100, width: int = 72, heads: int = 4, batch: int = 116, seed: int = 0, loss: str | Loss = "mse") -> DataFrame:
    """(series_id, query_idx, key_idx, score): attention between features of a regressor fitted on all of a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sid, _, a, b = _read(pdf)
        net = AttentionRegressor(width, heads, epochs=epochs, batch=batch, seed=seed, loss=loss)
        net.fit(a, b)
        s = net.attention(a)
        n = len(s)
        return pd.DataFrame({"series_id": sid, "query_idx": np.repeat(np.arange(n, dtype=np.int32), n), "key_idx": np.tile(np.arange(n, dtype=np.int32), n), "score": s.ravel()})

    return _arrays(design, x, [y]).groupBy("series_id").applyInPandas(run, "series_id string, query_idx int, key_idx int, score double")


def heat_map(scores: DataFrame) -> DataFrame:
    """(series_id, query_idx, key_idx, score) with a row and a column for the intercept in front, half of the highest score each; features are numbered from 1."""
    size = scores.groupBy("series_id").agg(F.max(F.greatest("query_idx", "key_idx")).alias("last"), (F.max("score") / 2).alias("half"))
    at = F.explode(F.sequence(F.lit(0), F.col("last") + 1)).alias("i")
    edge = size.select("series_id", "half", at).select("series_id", "half", F.explode(F.array(F.struct(F.lit(0).alias("query_idx"), F.col("i").alias("key_idx")), F.struct(F.col("i").alias("query_idx"), F.lit(0).alias("key_idx")))).alias("place"))
    edge = edge.select("series_id", "place.query_idx", "place.key_idx", F.col("half").alias("score")).distinct()
    return edge.unionByName(scores.select("series_id", (F.col("query_idx") + 1).alias("query_idx"), (F.col("key_idx") + 1).alias("key_idx"), "score"))


def write_heat_map(scores: DataFrame, path: str) -> None:
    """``heat_map`` as Parquet, a folder for each series; drawing it is left to the client."""
    heat_map(scores).write.partitionBy("series_id").parquet(path)


def top_features(scores: DataFrame, names: list[str], k: int = 20) -> DataFrame:
    """(series_id, rank, key_idx, feature, score): the k features that get most attention, mean over queries."""
    from pyspark.sql import Window

    mean = scores.groupBy("series_id", "key_idx").agg(F.round(F.avg("score"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("score"), "key_idx"))
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("key_idx") + 1)
    return mean.withColumn("rank", rank).filter(F.col("rank") <= k).select("series_id", "rank", "key_idx", feature.alias("feature"), "score")
