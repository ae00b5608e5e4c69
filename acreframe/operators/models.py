"""Fitting and scoring of pixel classifiers.

``train`` fits on all labelled rows, as sums over tasks (``fits``) or in pyspark.ml; the fits of arrays here are what those sums are
built of and, for the search over settings, what runs on a bounded sample. Scoring runs where the pixels are: a scorer adds a
probability column ``p`` to rows with feature columns.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.functions import stats


@dataclass
class LinearScorer:
    """Logistic score of z-scored features: built-in expressions only."""

    features: list[str]
    mean: list[float]
    std: list[float]
    weights: list[float]
    bias: float

    def score(self, rows: DataFrame) -> DataFrame:
        z = [stats.zscore(F.coalesce(F.nanvl(F.col(f), F.lit(None).cast("double")), F.lit(m)), F.lit(m), F.lit(s)) for f, m, s in zip(self.features, self.mean, self.std, strict=True)]
        return rows.withColumn("p", stats.logistic(stats.dot(z, self.weights, self.bias)))


BN_EPS, BN_MOMENTUM = 1e-5, 0.1


@dataclass
class NetworkScorer:
    """A residual network on z-scored features: linear, normalised and ReLU to ``width``; two blocks of the same that are added to
    their input; linear to two logits."""

    features: list[str]
    mean: list[float]
    std: list[float]
    layers: list[list]  # four pairs of weights and bias
    norms: list[list]  # three of scale, shift, running mean and running variance
    history: list[dict] = field(default_factory=list)  # losses of the epochs

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class of rows of raw features."""
        x = (np.where(np.isnan(x), self.mean, x) - self.mean) / (np.array(self.std) + 1e-6)
        e = self.logits(x)
        e = np.exp(e - e.max(1, keepdims=True))
        return e[:, 1] / e.sum(1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = None
        for (w, b), (scale, shift, mean, var) in zip(self.layers[:3], self.norms, strict=True):
            u = ((x if h is None else h) @ np.array(w) + np.array(b) - np.array(mean)) / np.sqrt(np.array(var) + BN_EPS) * np.array(scale) + np.array(shift)
            h = np.maximum(u, 0) + (0 if h is None else h)
        return h @ np.array(self.layers[3][0]) + np.array(self.layers[3][1])

    def score(self, rows: DataFrame) -> DataFrame:
        forward, n = self.forward, len(self.features)

        @F.pandas_udf("double")
        def p(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(forward(columns.to_numpy(float).reshape(-1, n)))

        return rows.withColumn("p", p(F.struct(*[F.col(f) for f in self.features])))


@dataclass
class ForestScorer:
    """A pyspark.ml forest on raw features, with the fit's means for missing ones."""

    features: list[str]
    mean: list[float]
    model: object

    def score(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        named = {f"_f_{f}": F.coalesce(F.nanvl(F.col(f), F.lit(None).cast("double")), F.lit(m)) for f, m in zip(self.features, self.mean, strict=True)}
        ready = VectorAssembler(inputCols=list(named), outputCol="_features").transform(rows.withColumns(named))
        scored = self.model.transform(ready).withColumn("p", vector_to_array("probability")[1])
        return scored.select(*rows.columns, "p")


def radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """Radial basis functions of all rows of a with those of b."""
    return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


@dataclass
class KernelScorer:
    """A kernel machine with radial basis functions on z-scored features, with a logistic calibration."""

    features: list[str]
    mean: list[float]
    std: list[float]
    support: np.ndarray
    alpha: np.ndarray
    bias: float
    gamma: float
    slope: float
    offset: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        return radial((np.where(np.isnan(x), self.mean, x) - self.mean) / np.array(self.std), self.support, self.gamma) @ self.alpha + self.bias

    def forward(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.decision(x) + self.offset)))

    score = NetworkScorer.score


class Ensemble:
    """Mean of the probabilities of several scorers: an addition of ours, as the choice is offered but not implemented."""

    def __init__(self, scorers):
        self.scorers = scorers

    def score(self, rows: DataFrame) -> DataFrame:
        out = rows
        for k, s in enumerate(self.scorers):
            out = s.score(out).withColumnRenamed("p", f"_p{k}")
        names = [f"_p{k}" for k in range(len(self.scorers))]
        return out.withColumn("p", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)


def matrix(rows: DataFrame, features: Sequence[str], y: str, order: Sequence[str], most: int = SETTINGS.fit_rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(X imputed, y, means, population stds) of labelled rows, in a fixed order, for the search over settings alone.

    Of more than ``most`` rows a sample of about that many is taken, by a hash of the order's columns.
    """
    known = rows.where(F.col(y).isNotNull()).select(*order, *features, y)
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(*order), F.lit(1 << 24)) < most * (1 << 24) // n)
    pdf = known.toPandas().sort_values(list(order))
    x = pdf[list(features)].to_numpy(float)
    mean = np.array([np.nanmean(c) if not np.isnan(c).all() else 0.0 for c in x.T])
    x = np.where(np.isnan(x), mean, x)
    return x, pdf[y].to_numpy(int), mean, x.std(0)


def fit_forest(rows: DataFrame, features: Sequence[str], y: str, **params) -> ForestScorer:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = stats.means(rows, features)
    mean = [v if v is not None else 0.0 for v in known.first()]
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(stats.impute(rows, features, known).fillna(0.0, list(features)))
    forest = RandomForestClassifier(featuresCol="_x", labelCol=y, seed=42, **(SETTINGS.forest | params)).fit(ready.withColumn(y, F.col(y).cast("double")))
    forest.setFeaturesCol("_features")
    return ForestScorer(list(features), mean, forest)


def fit_linear(x: np.ndarray, y: np.ndarray, features: Sequence[str], mean: np.ndarray, std: np.ndarray, ridge: float = 1e-3) -> LinearScorer:
    """Logistic regression on z-scores by Newton's method."""
    z = np.concatenate([(x - mean) / (std + 1e-6), np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return LinearScorer(list(features), mean.tolist(), std.tolist(), w[:-1].tolist(), float(w[-1]))


def fit_svm(x: np.ndarray, y: np.ndarray, features: Sequence[str], mean: np.ndarray, std: np.ndarray, c: float = SETTINGS.svm_c, gamma: float | None = None, rounds: int = 200) -> KernelScorer:
    """Radial-basis machine by coordinate ascent on the dual (bias as one more kernel term); gamma 1 / (d * variance)."""
    std = np.where(std == 0, 1.0, std)
    z = (x - mean) / std
    gamma = gamma or 1.0 / (z.shape[1] * max(z.var(), 1e-12))
    k = radial(z, z, gamma) + 1.0
    s = np.where(y > 0, 1.0, -1.0)
    a, f = np.zeros(len(s)), np.zeros(len(s))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(s)):
            new = min(c, max(0.0, a[i] + (1 - s[i] * f[i]) / k[i, i]))
            if new != a[i]:
                f += (new - a[i]) * s[i] * k[:, i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-5:
            break
    keep = a > 0
    slope, offset = 1.0, 0.0
    for _ in range(100):  # logistic calibration of the decision
        p = 1 / (1 + np.exp(-np.clip(slope * f + offset, -30, 30)))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * f * f).sum() + 1e-6, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * f).sum() + 1e-3 * slope, g.sum()])
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return KernelScorer(list(features), mean.tolist(), std.tolist(), z[keep], (a * s)[keep], float((a * s).sum()), float(gamma), float(slope), float(offset))


def initial_network(d: int, width: int, rng: np.random.Generator) -> tuple[list[list], list[list]]:
    """(layers, norms): uniform within 1 / sqrt(inputs), as linear layers usually begin."""
    layers = [[rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)] for a, b in ((d, width), (width, width), (width, width), (width, 2))]
    return layers, [[np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)] for _ in range(3)]


class NetworkState:
    """Parameters of the network, their moments under Adam, and the number of steps taken."""

    def __init__(self, layers: list[list], norms: list[list]):
        self.layers, self.norms, self.steps = layers, norms, 0
        self.learnt = [p for layer in layers for p in layer] + [p for n in norms for p in n[:2]]
        self.first, self.second = [np.zeros_like(p) for p in self.learnt], [np.zeros_like(p) for p in self.learnt]

    @classmethod
    def initial(cls, d: int, width: int, seed: int) -> NetworkState:
        return cls(*initial_network(d, width, np.random.default_rng(seed)))

    def _arrays(self) -> list[np.ndarray]:
        return [*self.learnt, *self.first, *self.second, *[p for n in self.norms for p in n[2:]]]

    def flat(self) -> np.ndarray:
        """All numbers in one array, the steps last."""
        return np.concatenate([*[p.ravel() for p in self._arrays()], [float(self.steps)]])

    def filled(self, flat: np.ndarray) -> NetworkState:
        """A state of the same shape with the numbers of ``flat``."""
        out = NetworkState([[np.empty_like(p) for p in layer] for layer in self.layers], [[np.empty_like(p) for p in n] for n in self.norms])
        at = 0
        for p in out._arrays():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        out.steps = int(round(flat[at]))
        return out

    def epoch(self, z: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> float:
        """One pass of Adam over shuffled batches of z-scores; the mean loss of the batches."""
        losses = []
        for at in np.array_split(rng.permutation(len(z)), max(1, -(-len(z) // SETTINGS.batch))):
            loss, grads, stats_ = gradients(self.layers, self.norms, z[at], y[at])
            losses.append(loss)
            for n, (m, v) in zip(self.norms, stats_, strict=True):
                n[2] += BN_MOMENTUM * (m - n[2])
                n[3] += BN_MOMENTUM * (v * len(at) / max(1, len(at) - 1) - n[3])
            self.steps += 1
            for p, g, m, v in zip(self.learnt, grads, self.first, self.second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                p -= SETTINGS.learning_rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return float(np.mean(losses))

    def scorer(self, features: Sequence[str], mean: np.ndarray, std: np.ndarray, history: list[dict]) -> NetworkScorer:
        layers, norms = [[p.tolist() for p in layer] for layer in self.layers], [[p.tolist() for p in n] for n in self.norms]
        return NetworkScorer(list(features), np.asarray(mean).tolist(), np.asarray(std).tolist(), layers, norms, history)


def fit_network(x: np.ndarray, y: np.ndarray, features: Sequence[str], mean: np.ndarray, std: np.ndarray, width: int = 64, seed: int = 42, epochs: int = SETTINGS.epochs, validation: tuple[np.ndarray, np.ndarray] | None = None) -> NetworkScorer:
    """Adam on cross-entropy, in shuffled batches, with batch normalisation, of arrays; ``fits.fit_network`` is the form for tables.

    ``history`` has each epoch's mean loss of its batches and, where rows for validation are given, their loss and the
    percentage that is told right.
    """
    z, state, history = (x - mean) / (std + 1e-6), NetworkState.initial(x.shape[1], width, seed), []
    for epoch in range(1, epochs + 1):
        history.append({"epoch": epoch, "loss": state.epoch(z, y, np.random.default_rng([seed, epoch, 0]))})
        if validation is not None:
            p, truth = state.scorer(features, mean, std, []).forward(validation[0]), validation[1]
            told = np.clip(np.where(truth == 1, p, 1 - p), 1e-12, 1)
            history[-1] |= {"val_loss": float(-np.log(told).mean()), "val_accuracy": float(100 * ((p > 0.5) == (truth == 1)).mean())}
    return state.scorer(features, mean, std, history)


def gradients(layers: list[list], norms: list[list], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """(mean cross-entropy of a batch, its gradients by layers then norms, the batch's mean and variance of each norm)."""
    inputs, normal, spread, live, stats_ = [], [], [], [], []
    h = x
    for k, ((w, b), (scale, shift, _, _)) in enumerate(zip(layers[:3], norms, strict=True)):
        inputs.append(h)
        u = h @ w + b
        m, v = u.mean(0), u.var(0)
        stats_.append((m, v))
        spread.append(np.sqrt(v + BN_EPS))
        normal.append((u - m) / spread[-1])
        a = normal[-1] * scale + shift
        live.append(a > 0)
        h = np.maximum(a, 0) + (h if k else 0)
    logits = h @ layers[3][0] + layers[3][1]
    e = np.exp(logits - logits.max(1, keepdims=True))
    d = e / e.sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(d[np.arange(len(y)), y], 1e-300)).mean())
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    of_layers: list = [None] * 4
    of_norms: list = [None] * 3
    of_layers[3] = [h.T @ d, d.sum(0)]
    back = d @ layers[3][0].T
    for k in (2, 1, 0):
        a = back * live[k]
        of_norms[k] = [(a * normal[k]).sum(0), a.sum(0)]
        n = a * norms[k][0]
        u = (n - n.mean(0) - normal[k] * (n * normal[k]).mean(0)) / spread[k]
        of_layers[k] = [inputs[k].T @ u, u.sum(0)]
        back = u @ layers[k][0].T + (back if k else 0)
    return loss, [p for layer in of_layers for p in layer] + [p for n in of_norms for p in n], stats_


def f1(y: np.ndarray, predicted: np.ndarray) -> float:
    hit = int(((y == 1) & (predicted == 1)).sum())
    total = int((y == 1).sum() + (predicted == 1).sum())
    return 2 * hit / total if total else 0.0


def grid_search(x: np.ndarray, y: np.ndarray, fit, grid: Sequence[dict], folds: int = 3) -> tuple[dict, float]:
    """The first of the settings with the best mean F1 over stratified folds; ``fit(x, y, **setting)`` gives a predictor."""
    rank = np.zeros(len(y), int)
    for value in (0, 1):
        rank[y == value] = np.arange((y == value).sum())
    fold = rank % folds
    scores = [np.mean([f1(y[fold == k], fit(x[fold != k], y[fold != k], **setting)(x[fold == k])) for k in range(folds)]) for setting in grid]
    best = int(np.argmax(scores))
    return grid[best], float(scores[best])


def train(choice: str, rows: DataFrame, features: Sequence[str], y: str, order: Sequence[str]):
    """A fitted scorer by name: RandomForest, SVM, ResNet, Logistic or Ensemble."""
    if choice == "RandomForest":
        return fit_forest(rows, features, y)
    if choice == "Ensemble":
        return Ensemble([train(c, rows, features, y, order) for c in ("RandomForest", "SVM", "ResNet")])
    from acreframe.operators import fits

    if choice == "Logistic":
        return fits.fit_logistic(rows, features, y)
    if choice == "SVM":
        return fits.fit_kernel(rows, features, y, order)
    if choice == "ResNet":
        return fits.fit_network(rows, features, y, order)
    raise ValueError(f"unknown model: {choice}")


def tune(rows: DataFrame, features: Sequence[str], y: str, order: Sequence[str], svm: Sequence[dict] | None = None, trees: Sequence[int] = (100, 200), depths: Sequence[int] = (6, 8, 10)) -> dict[str, dict]:
    """The best settings of the kernel machine and of the forest by mean F1 over three folds."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    x, target, mean, std = matrix(rows, features, y, order)

    def machine(a: np.ndarray, b: np.ndarray, c: float, gamma: str):
        m, s = a.mean(0), np.where(a.std(0) == 0, 1.0, a.std(0))
        found = fit_svm(a, b, features, m, s, c, None if gamma == "scale" else 1.0 / a.shape[1])
        return lambda z: (found.forward(z) >= 0.5).astype(int)

    grid = svm or [{"c": c, "gamma": g} for c in (0.1, 1.0, 10.0) for g in ("scale", "auto")]
    best, score = grid_search(x, target, machine, grid)
    full = stats.impute(rows, features, stats.means(rows, features)).fillna(0.0, list(features))
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(full).withColumn(y, F.col(y).cast("double"))
    forest = RandomForestClassifier(featuresCol="_x", labelCol=y, seed=42)
    params = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(labelCol=y, metricName="fMeasureByLabel", metricLabel=1.0)
    found = CrossValidator(estimator=forest, estimatorParamMaps=params, evaluator=judge, numFolds=3, seed=42, parallelism=4).fit(ready)
    k = int(np.argmax(found.avgMetrics))
    return {"SVM": best | {"f1": score}, "RandomForest": {"numTrees": params[k][forest.numTrees], "maxDepth": params[k][forest.maxDepth], "f1": float(found.avgMetrics[k])}}


def _plain(value):
    if isinstance(value, np.ndarray):
        return value.tolist()
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def save(scorer, path: str) -> None:
    """A scorer in a folder of any file system: its numbers as JSON, a forest by pyspark.ml's own writer, members in folders of theirs."""
    spark = SparkSession.getActiveSession()
    held: dict = {}
    if isinstance(scorer, Ensemble):
        for k, one in enumerate(scorer.scorers):
            save(one, f"{path}/member-{k}")
        held = {"members": len(scorer.scorers)}
    else:
        held = {f.name: _plain(getattr(scorer, f.name)) for f in fields(scorer) if f.name != "model"}
        if isinstance(scorer, ForestScorer):
            scorer.model.write().overwrite().save(f"{path}/forest")
    text = json.dumps({"kind": type(scorer).__name__, "fields": held})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scorer")


def load(path: str):
    """The scorer that ``save`` left."""
    found = json.loads(SparkSession.getActiveSession().read.option("wholetext", True).text(f"{path}/scorer").first()[0])
    held = found["fields"]
    if found["kind"] == "Ensemble":
        return Ensemble([load(f"{path}/member-{k}") for k in range(held["members"])])
    if found["kind"] == "ForestScorer":
        from pyspark.ml.classification import RandomForestClassificationModel

        return ForestScorer(**held, model=RandomForestClassificationModel.load(f"{path}/forest"))
    if found["kind"] == "KernelScorer":
        held |= {k: np.array(held[k]) for k in ("support", "alpha")}
    return {c.__name__: c for c in (LinearScorer, NetworkScorer, KernelScorer)}[found["kind"]](**held)
