"""A residual convolution network for patches, fitted by workers and scored where the patches are.

A patch is an array of bands by rows by columns. The network is a 3 by 3 convolution to ``width`` channels, two residual blocks
of two convolutions each with halving by means between them, the mean over all cells, and a linear layer to two logits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.operators import fits


def as_arrays(pixels: DataFrame, bands: Sequence[str], side: int) -> DataFrame:
    """(tile, pr, pc, values) of the full patches of ``tumbling`` pixels: values by band, row and column, each band scaled to 0..1 of the patch."""
    cells = F.sort_array(F.collect_list(F.struct("r", "c", *bands)))
    whole = pixels.groupBy("tile", "pr", "pc").agg(cells.alias("_cells")).where(F.size("_cells") == side * side)

    def band(b: str):
        of = F.transform("_cells", lambda x: x[b].cast("double"))
        return F.transform(of, lambda v: (v - F.array_min(of)) / (F.array_max(of) - F.array_min(of) + 1e-5))

    return whole.select("tile", "pr", "pc", F.flatten(F.array(*[band(b) for b in bands])).alias("values"))


def windows(x: np.ndarray) -> np.ndarray:
    """(n, rows, columns, channels * 9) of the 3 by 3 neighbourhoods of (n, channels, rows, columns), zero beyond the border."""
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    view = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))
    return view.transpose(0, 2, 3, 1, 4, 5).reshape(x.shape[0], x.shape[2], x.shape[3], -1)


def convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output, neighbourhoods) for weights (channels * 9, outputs)."""
    cols = windows(x)
    return (cols @ w + b).transpose(0, 3, 1, 2), cols


def convolve_back(d: np.ndarray, cols: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of input, weights and bias from those of the output."""
    flat = d.transpose(0, 2, 3, 1)
    of_w = np.tensordot(cols, flat, ([0, 1, 2], [0, 1, 2]))
    turned = w.reshape(-1, 3, 3, w.shape[1])[:, ::-1, ::-1].transpose(3, 1, 2, 0).reshape(w.shape[1] * 9, -1)
    return (windows(d) @ turned).transpose(0, 3, 1, 2), of_w, flat.sum((0, 1, 2))


def halve(x: np.ndarray) -> np.ndarray:
    """Means of 2 by 2 cells; a last odd row or column is left out."""
    n, c, h, w = x.shape
    return x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).mean((3, 5))


def halve_back(d: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(shape)
    out[:, :, : d.shape[2] * 2, : d.shape[3] * 2] = np.repeat(np.repeat(d, 2, 2), 2, 3) / 4
    return out


@dataclass
class PatchScorer:
    """A fitted network: five convolutions and the linear layer, each a pair of weights and bias."""

    channels: int
    side: int
    layers: list[list]
    history: list[dict] = field(default_factory=list)  # losses of the epochs

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of patches (n, channels, side, side); ``keep`` gathers what the gradients need."""
        h, cols = convolve(x, *self.layers[0])
        steps = [(h, cols)]
        h = np.maximum(h, 0)
        for k in (1, 3):
            a, cols_a = convolve(h, *self.layers[k])
            b, cols_b = convolve(np.maximum(a, 0), *self.layers[k + 1])
            total = h + b
            steps.append((a, cols_a, total, cols_b))
            h = np.maximum(total, 0)
            if k == 1:
                steps.append(h.shape)
                h = halve(h)
        means = h.mean((2, 3))
        if keep is not None:
            keep += [steps, h.shape, means]
        return means @ self.layers[5][0] + self.layers[5][1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.forward(x)
        e = np.exp(z - z.max(1, keepdims=True))
        return e[:, 1] / e.sum(1)

    def score(self, patches: DataFrame, values: str = "values") -> DataFrame:
        """Patches with the probability ``p`` of the positive class."""
        shape, own = (-1, self.channels, self.side, self.side), self

        @F.pandas_udf("double")
        def p(column: pd.Series) -> pd.Series:
            return pd.Series(own.probabilities(np.stack(column.to_numpy()).reshape(shape)))

        return patches.withColumn("p", p(F.col(values)))


def gradients(net: PatchScorer, x: np.ndarray, y: np.ndarray) -> tuple[float, list[list[np.ndarray]]]:
    """(mean cross-entropy of a batch, its gradients by layer)."""
    kept: list = []
    z = net.forward(x, kept)
    (first, one, shape, two), last, means = kept
    e = np.exp(z - z.max(1, keepdims=True))
    d = e / e.sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(d[np.arange(len(y)), y], 1e-300)).mean())
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    out: list = [None] * 6
    out[5] = [means.T @ d, d.sum(0)]
    back = np.broadcast_to((d @ net.layers[5][0].T)[:, :, None, None] / (last[2] * last[3]), last)
    for k, (a, cols_a, total, cols_b) in ((3, two), (1, one)):
        if k == 1:
            back = halve_back(back, shape)
        back = back * (total > 0)
        inner, w, b = convolve_back(back, cols_b, net.layers[k + 1][0])
        out[k + 1] = [w, b]
        through, w, b = convolve_back(inner * (a > 0), cols_a, net.layers[k][0])
        out[k] = [w, b]
        back = back + through
    _, w, b = convolve_back(back * (first[0] > 0), first[1], net.layers[0][0])
    out[0] = [w, b]
    return loss, out


def initial(channels: int, side: int, width: int, rng: np.random.Generator) -> PatchScorer:
    sizes = [(channels * 9, width)] + [(width * 9, width)] * 4 + [(width, 2)]
    return PatchScorer(channels, side, [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in sizes])


class PatchState:
    """Parameters of the network, their moments under Adam, and the number of steps taken."""

    def __init__(self, net: PatchScorer):
        self.net, self.steps = net, 0
        self.learnt = [p for layer in net.layers for p in layer]
        self.first, self.second = [np.zeros_like(p) for p in self.learnt], [np.zeros_like(p) for p in self.learnt]

    def flat(self) -> np.ndarray:
        """All numbers in one array, the steps last."""
        return np.concatenate([*[p.ravel() for p in (*self.learnt, *self.first, *self.second)], [float(self.steps)]])

    def filled(self, flat: np.ndarray) -> PatchState:
        """A state of the same shape with the numbers of ``flat``."""
        out = PatchState(PatchScorer(self.net.channels, self.net.side, [[np.empty_like(p) for p in layer] for layer in self.net.layers]))
        at = 0
        for p in (*out.learnt, *out.first, *out.second):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        out.steps = int(round(flat[at]))
        return out

    def epoch(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int, rate: float) -> float:
        """One pass of Adam over shuffled batches; the mean loss of the batches."""
        losses = []
        for at in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // batch))):
            loss, grads = gradients(self.net, x[at], y[at])
            losses.append(loss)
            self.steps += 1
            for p, g, m, v in zip(self.learnt, [g for layer in grads for g in layer], self.first, self.second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return float(np.mean(losses))


def begun(channels: int, side: int, width: int, seed: int, worker: int = 0, rows: Sequence[int] = ()) -> tuple[PatchScorer, np.random.Generator]:
    """(the network before its fit, a worker's generator behind the shuffles of so many rows in earlier epochs).

    The first worker goes on with the generator that the network's numbers are drawn from, others have generators of their own.
    """
    rng = np.random.default_rng(seed)
    net = initial(channels, side, width, rng)
    rng = rng if worker == 0 else np.random.default_rng([seed, worker])
    for n in rows:
        rng.permutation(n)
    return net, rng


def fit(x: np.ndarray, y: np.ndarray, width: int = 16, epochs: int = 5, batch: int = 16, rate: float = 1e-4, seed: int = 42) -> PatchScorer:
    """Adam on cross-entropy in shuffled batches, of arrays; ``fit_rows`` is the form for tables."""
    net, rng = begun(x.shape[1], x.shape[2], width, seed)
    state = PatchState(net)
    net.history = [{"epoch": epoch, "loss": state.epoch(x, y, rng, batch, rate)} for epoch in range(1, epochs + 1)]
    return net


def fit_rows(patches: DataFrame, channels: int, side: int, y: str, order: Sequence[str], share: float = 0.8, width: int = 16, epochs: int = 5, batch: int = 16, rate: float = 1e-4, seed: int = 42, worker_rows: int = SETTINGS.fit_rows) -> PatchScorer:
    """Fit on all labelled patches (values, y) but about 1 - ``share`` of them, chosen by a hash, which validate each epoch.

    Workers of about ``worker_rows`` patches go over their own ones in each epoch, and are averaged by their patches behind it; up
    to that many patches it is ``fit``. Losses and the percentage told right of the validation are an aggregation.
    """
    known = patches.where(F.col(y).isNotNull()).select(*order, "values", F.col(y).cast("int").alias("y")).withColumn("_h", F.pmod(F.xxhash64(*order, F.lit(42)), F.lit(1 << 24)))
    learn, check = (known.where(x) for x in (F.col("_h") < share * (1 << 24), F.col("_h") >= share * (1 << 24)))
    n = learn.count()
    if n <= 1:
        raise ValueError("too few labelled patches to fit a network")
    dealt = learn.withColumn("worker", F.pmod(F.xxhash64(*order), F.lit(-(-n // worker_rows))).cast("int"))
    state, history = PatchState(begun(channels, side, width, seed)[0]), []
    for epoch in range(1, epochs + 1):

        def pass_(own: PatchState, pdf: pd.DataFrame, worker: int, epoch: int = epoch) -> float:
            x = np.stack(pdf["values"].to_numpy()).reshape(-1, channels, side, side)
            rng = begun(channels, side, width, seed, worker, [len(x)] * (epoch - 1))[1]
            return own.epoch(x, pdf.y.to_numpy(int), rng, batch, rate)

        state, loss = fits.averaged(dealt, state, ["_h", *order], pass_)
        told = state.net.score(check).select(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")).alias("told"))
        val = told.agg(F.avg(-F.log(F.greatest("told", F.lit(1e-12)))).alias("loss"), (100 * F.avg((F.col("told") > 0.5).cast("double"))).alias("right")).first()
        history.append({"epoch": epoch, "loss": loss} | ({} if val["loss"] is None else {"val_loss": val["loss"], "val_accuracy": val["right"]}))
    state.net.history = history
    return state.net
