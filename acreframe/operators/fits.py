"""Fits on all labelled rows, as sums over tasks: parameters go to the tasks, partial sums come back by place.

Each task adds up what its rows give, in numpy, and sends one array; the arrays are exploded by place and summed by place, so that
the driver gets one number a place however many tasks there are. Statistics are one aggregation of built-in functions. Only
landmarks of the kernel machine are a sample, of ``LANDMARKS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.operators import models

LANDMARKS = 128


def _known(c: str):
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def statistics(rows: DataFrame, features: Sequence[str], y: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(labelled rows, means, population deviations of features whose missing values are their means): one aggregation.

    Values that are their mean add nothing to the squares, so the deviation is that of the values there are, spread over all rows.
    """
    each = [f(_known(c)).alias(f"{n}_{k}") for k, c in enumerate(features) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    r = rows.where(F.col(y).isNotNull()).agg(F.count("*").alias("rows"), *each).first()
    mean = np.array([r[f"m_{k}"] or 0.0 for k in range(len(features))])
    std = np.array([np.sqrt((r[f"v_{k}"] or 0.0) * r[f"n_{k}"] / r["rows"]) if r["rows"] else 0.0 for k in range(len(features))])
    return r["rows"], mean, std


def statistics_table(rows: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """(feature, mean, std, rows): the same, a row for each feature."""
    known = rows.where(F.col(y).isNotNull())
    share = lambda c: F.sqrt(F.var_pop(_known(c)) * F.count(_known(c)) / F.count("*"))
    each = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.avg(_known(c)), F.lit(0.0)).alias("mean"), F.coalesce(share(c), F.lit(0.0)).alias("std"), F.count("*").alias("rows")) for c in features]
    return known.agg(F.array(*each).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def labelled(rows: DataFrame, features: Sequence[str], y: str, mean: np.ndarray, std: np.ndarray, eps: float, order: Sequence[str] = ()) -> DataFrame:
    """(order, z: array of z-scores with 0 for missing values, y) of labelled rows."""
    z = [F.coalesce((_known(c) - float(m)) / (float(s) + eps), F.lit(0.0)) for c, m, s in zip(features, mean, std, strict=True)]
    return rows.where(F.col(y).isNotNull()).select(*order, F.array(*z).alias("z"), F.col(y).cast("double").alias("y"))


def summed(rows: DataFrame, width: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part(z, y)`` over all batches of rows (z, y), ``size`` numbers."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    places = rows.select("z", "y").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in places.collect():  # a row for each place
        out[r["k"]] = r["v"]
    return out


def fit_logistic(rows: DataFrame, features: Sequence[str], y: str, ridge: float = 1e-3) -> models.LinearScorer:
    """Logistic regression on z-scores by Newton's method, each step a sum over all rows."""
    n, mean, std = statistics(rows, features, y)
    _enough(n)
    known, d = labelled(rows, features, y, mean, std, 1e-6), len(features) + 1
    w = np.zeros(d)
    for _ in range(50):
        gradient, curvature = logistic_sums(known, w)
        step = np.linalg.solve(curvature + ridge * np.eye(d), gradient - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return models.LinearScorer(list(features), mean.tolist(), std.tolist(), w[:-1].tolist(), float(w[-1]))


def logistic_sums(known: DataFrame, w: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log-likelihood at w, whose last weight is the constant's."""
    w = np.asarray(w, float)
    d = len(w)

    def part(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.concatenate([z, np.ones((len(z), 1))], 1)
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

    sums = summed(known, d - 1, part, d + d * d)
    return sums[:d], sums[d:].reshape(d, d)


def _enough(n: int) -> None:
    if n <= 1:
        raise ValueError("too few labelled rows to fit a model")


def landmarks(known: DataFrame, order: Sequence[str], most: int) -> np.ndarray:
    """Different rows, ``most`` at most, by a hash of the order's columns."""
    found = known.select("z", F.xxhash64(*order).alias("h")).orderBy("h", "z").limit(most).collect()  # most rows
    return np.unique(np.array([r["z"] for r in found], float), axis=0)


def fit_kernel(rows: DataFrame, features: Sequence[str], y: str, order: Sequence[str], c: float = SETTINGS.svm_c, gamma: float | None = None, most: int = LANDMARKS) -> models.KernelScorer:
    """A machine with radial basis functions on all rows: kernels with landmarks, made orthonormal, are columns of a linear machine.

    The linear machine has the squared hinge loss and is solved by Newton steps, each a sum over all rows; a step that does not
    lower the loss is halved. Its decisions are then calibrated as probabilities, by Newton steps too.
    """
    n, mean, deviation = statistics(rows, features, y)
    _enough(n)
    std = np.where(deviation == 0, 1.0, deviation)
    known = labelled(rows, features, y, mean, std, 0.0, order)
    at = landmarks(known, order, most)
    gamma = gamma or 1.0 / (len(features) * max(float(((deviation / std) ** 2).mean()), 1e-12))
    values, vectors = np.linalg.eigh(models.radial(at, at, gamma))
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    d = int(good.sum()) + 1

    def columns(z: np.ndarray) -> np.ndarray:
        return np.concatenate([models.radial(z, at, gamma) @ whiten, np.ones((len(z), 1))], 1)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            x, s = columns(z), np.where(y > 0, 1.0, -1.0)
            short = np.maximum(1 - s * (x @ w), 0)
            x, s, short = x[short > 0], s[short > 0], short[short > 0]
            return np.concatenate([[short @ short], x.T @ (s * short), (x.T @ x).ravel()])

        found = summed(known, len(features), part, 1 + d + d * d)
        return 0.5 * w @ w + c * found[0], w - 2 * c * found[1 : d + 1], np.eye(d) + 2 * c * found[d + 1 :].reshape(d, d)

    w = np.zeros(d)
    loss, gradient, curvature = sums(w)
    for _ in range(30):
        step = np.linalg.solve(curvature, gradient)
        for _ in range(8):
            now = sums(w - step)
            if now[0] <= loss:
                break
            step = step / 2
        if now[0] > loss:
            break
        w, (loss, gradient, curvature) = w - step, now
        if np.abs(step).max() < 1e-7:
            break
    slope, offset = 1.0, 0.0
    for _ in range(50):

        def part(z: np.ndarray, y: np.ndarray, slope: float = slope, offset: float = offset) -> np.ndarray:
            f = columns(z) @ w
            p = 1 / (1 + np.exp(-np.clip(slope * f + offset, -30, 30)))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            return np.array([(h * f * f).sum(), (h * f).sum(), h.sum(), (g * f).sum(), g.sum()])

        ff, f1, one, gf, g = summed(known, len(features), part, 5)
        step = np.linalg.solve([[ff + 1e-6, f1], [f1, one + 1e-6]], [gf + 1e-3 * slope, g])
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return models.KernelScorer(list(features), mean.tolist(), std.tolist(), at, whiten @ w[:-1], float(w[-1]), float(gamma), float(slope), float(offset))


def fit_network(rows: DataFrame, features: Sequence[str], y: str, order: Sequence[str], width: int = 64, seed: int = 42, epochs: int = SETTINGS.epochs, worker_rows: int = SETTINGS.fit_rows) -> models.NetworkScorer:
    """The residual network on all rows: in each epoch every worker goes over its own rows, in shuffled batches from the common
    parameters, and the workers' parameters, moments and losses are averaged by their rows.

    A worker has about ``worker_rows`` rows, chosen by a hash of the order's columns; a label set of one worker is fitted exactly
    as ``models.fit_network`` fits arrays.
    """
    n, mean, std = statistics(rows, features, y)
    _enough(n)
    workers = -(-n // worker_rows)
    hashed = F.pmod(F.xxhash64(*order), F.lit(workers)).cast("int")
    known = labelled(rows, features, y, mean, std, 1e-6, order).withColumn("worker", hashed)
    state = models.NetworkState.initial(len(features), width, seed)
    history = []
    for epoch in range(1, epochs + 1):
        state, loss = _epoch(known, state, seed, epoch, list(order))
        history.append({"epoch": epoch, "loss": loss})
    return state.scorer(features, mean, std, history)


def _epoch(known: DataFrame, state: models.NetworkState, seed: int, epoch: int, order: list[str]) -> tuple[models.NetworkState, float]:
    """The state after an epoch of all workers, and their mean loss."""
    return averaged(known, state, order, lambda own, pdf, worker: own.epoch(np.stack(pdf.z.to_list()), pdf.y.to_numpy(int), np.random.default_rng([seed, epoch, worker])))


def averaged(known: DataFrame, state, order: list[str], epoch: Callable[[object, pd.DataFrame, int], float]):
    """(state, loss) after ``epoch(state, rows, worker)`` of each worker of the rows: the means over workers by their rows.

    A state has ``flat()``, all its numbers, and ``filled(flat)``. A worker's rows come sorted by the order's columns.
    """
    flat = state.flat()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        own = state.filled(flat)
        loss = epoch(own, pdf, int(pdf.worker.iloc[0]))
        return pd.DataFrame({"n": [float(len(pdf))], "values": [[*own.flat().tolist(), loss]]})

    each = known.groupBy("worker").applyInPandas(run, "n double, values array<double>")
    mean = each.select("n", F.posexplode("values").alias("k", "v")).groupBy("k").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
    out = np.zeros(len(flat) + 1)
    for r in mean.collect():  # a row for each parameter
        out[r["k"]] = r["v"]
    return state.filled(out[:-1]), float(out[-1])
