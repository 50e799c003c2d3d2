"""Sequence classification: two LSTM layers and two dense ones over the 40 (time, length) pairs of a full flow, in numpy.

Weights come from the caller; the operator brings the network, the batching and the choice of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyweir.schema import CAP, KEY


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Lstm:
    """kernel: inputs x 4 units, recurrent: units x 4 units, bias: 4 units; gates in the order input, forget, cell, output."""

    kernel: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray, whole: bool) -> np.ndarray:
        n, steps, _ = x.shape
        units = self.recurrent.shape[0]
        h, c, out = np.zeros((n, units)), np.zeros((n, units)), []
        for t in range(steps):
            i, f, g, o = np.split(x[:, t] @ self.kernel + h @ self.recurrent + self.bias, 4, axis=1)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out.append(h)
        return np.stack(out, axis=1) if whole else h


@dataclass
class Network:
    first: Lstm
    second: Lstm
    dense: tuple[np.ndarray, np.ndarray]
    last: tuple[np.ndarray, np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of (flows, steps, 2)."""
        h = self.second(self.first(x, True), False)
        h = np.maximum(h @ self.dense[0] + self.dense[1], 0)
        z = h @ self.last[0] + self.last[1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def random_network(seed: int = 0, sizes: tuple[int, int, int, int] = (128, 64, 64, 10)) -> Network:
    """Untrained weights, for trying the operator."""
    rng = np.random.default_rng(seed)
    w = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    a, b, c, d = sizes
    return Network(Lstm(w(2, 4 * a), w(a, 4 * a), np.zeros(4 * a)), Lstm(w(a, 4 * b), w(b, 4 * b), np.zeros(4 * b)), (w(b, c), np.zeros(c)), (w(c, d), np.zeros(d)))


WEIGHTS = ("first_kernel", "first_recurrent", "first_bias", "second_kernel", "second_recurrent", "second_bias", "dense_kernel", "dense_bias", "last_kernel", "last_bias")


def save_network(network: Network, path: str) -> None:
    """The weights as a file of named arrays (.npz)."""
    a, b = network.first, network.second
    np.savez(path, **dict(zip(WEIGHTS, (a.kernel, a.recurrent, a.bias, b.kernel, b.recurrent, b.bias, *network.dense, *network.last))))


def load_network(path: str) -> Network:
    """The network of a file of named arrays, as the layers' weights are listed by common libraries; shapes must fit each other."""
    with np.load(path) as f:
        if missing := set(WEIGHTS) - set(f.files):
            raise ValueError(f"weights are missing: {sorted(missing)}")
        w = [f[name].astype(float) for name in WEIGHTS]
    for kernel, recurrent, bias in (w[0:3], w[3:6]):
        if kernel.shape[1] != 4 * len(recurrent) or recurrent.shape[1] != kernel.shape[1] or bias.shape != kernel.shape[1:]:
            raise ValueError("an LSTM layer's weights do not fit each other")
    if len(w[1]) != len(w[3]) or len(w[4]) != len(w[6]) or w[6].shape[1] != len(w[8]):
        raise ValueError("the layers do not fit each other")
    return Network(Lstm(*w[0:3]), Lstm(*w[3:6]), (w[6], w[7]), (w[8], w[9]))


def classify(records: DataFrame, network: Network, cap: int = CAP, batch: int = 256) -> DataFrame:
    """(key, session_no, class) of the flows with exactly `cap` packets; others give no row."""
    rows = records.where(f"count = {cap}").select(*KEY, "session_no", "ts", "len")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                x = np.stack([np.stack([np.asarray(t, float), np.asarray(n, float)], axis=1) for t, n in zip(part["ts"], part["len"])])
                yield part[[*KEY, "session_no"]].assign(**{"class": network(x).argmax(axis=1).astype("int32")})

    return rows.mapInPandas(run, "ip1 long, port1 int, ip2 long, port2 int, proto int, session_no long, class int")
