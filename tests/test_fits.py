"""Percentiles without sorting, and fits as sums over tasks, against numpy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acreframe.operators import fits, models, patchnet, quantiles


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.integers(-3, 3).map(float)), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.4, 0.5, 1.0]))
def test_percentiles_of_any_numbers(spark, values, fraction):
    frame = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "v double").coalesce(2)
    got = quantiles.percentiles(frame, F.col("v"), [fraction], bins=4)[0]
    order = sorted(values)
    at = fraction * (len(order) - 1)
    low, high = order[math.floor(at)], order[math.ceil(at)]
    assert got == low + (high - low) * (at - math.floor(at)) or (math.isinf(high - low) and not math.isfinite(got))


def test_percentiles_of_many_values(spark):
    """Values over 600 orders of magnitude, and one value that makes up half of all; no step gives more rows than bins."""
    frame = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit(0.25)).otherwise(F.pow(F.lit(10.0), (F.col("id") * 7919 % 600 - 300))).alias("v"))
    values = np.sort([r.v for r in frame.collect()])
    fractions = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    at = [f * (len(values) - 1) for f in fractions]
    want = [values[math.floor(p)] + (values[math.ceil(p)] - values[math.floor(p)]) * (p - math.floor(p)) for p in at]
    assert quantiles.percentiles(frame, F.col("v"), fractions) == want
    assert quantiles.percentiles(frame.where("v < 0"), F.col("v"), [0.5, 0.9]) == [None, None]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(int)
    x[::7, 2] = np.nan
    table = [(i, *(float(v) for v in r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*table, (999, 1.0, 1.0, 1.0, None)], "k long, a double, b double, c double, y int").repartition(5)


def arrays(rows):
    x, y, mean, std = models.matrix(rows, ["a", "b", "c"], "y", ["k"])
    return x, y, mean, std


def test_statistics_cover_all_labelled_rows(rows):
    x, y, mean, std = arrays(rows)
    n, m, s = fits.statistics(rows, ["a", "b", "c"], "y")
    assert n == 400 and np.allclose(m, mean) and np.allclose(s, std)
    told = {r.feature: (r["mean"], r["std"], r["rows"]) for r in fits.statistics_table(rows, ["a", "b", "c"], "y").collect()}
    assert np.allclose([told[f] for f in "abc"], np.column_stack([mean, std, [400] * 3]))
    assert len(models.matrix(rows, ["a"], "y", ["k"], most=100)[0]) < 200  # the sample of a search does not touch them


def test_logistic_sums_and_fit(rows):
    x, y, mean, std = arrays(rows)
    z, w = np.concatenate([(x - mean) / (std + 1e-6), np.ones((400, 1))], 1), np.array([0.2, -0.1, 0.3, 0.05])
    p = 1 / (1 + np.exp(-z @ w))
    gradient, curvature = fits.logistic_sums(fits.labelled(rows, ["a", "b", "c"], "y", mean, std, 1e-6), w)
    assert np.allclose(gradient, z.T @ (y - p)) and np.allclose(curvature, (z * (p * (1 - p))[:, None]).T @ z)
    one, two = fits.fit_logistic(rows, ["a", "b", "c"], "y"), models.fit_linear(x, y, ["a", "b", "c"], mean, std)
    assert np.allclose([*one.weights, one.bias], [*two.weights, two.bias], atol=1e-8)


def auc(p, y):
    order = np.argsort(np.argsort(p))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_kernel_machine_by_landmarks_is_near_the_exact_one(rows):
    x, y, mean, std = arrays(rows)
    exact = models.fit_svm(x, y, ["a", "b", "c"], mean, std)
    near = fits.fit_kernel(rows, ["a", "b", "c"], "y", ["k"])
    assert len(near.support) == fits.LANDMARKS and abs(near.gamma - exact.gamma) < 1e-9
    assert abs(auc(near.forward(x), y) - auc(exact.forward(x), y)) < 0.01 < 0.9 < auc(near.forward(x), y)
    assert np.all((near.forward(x) > 0) & (near.forward(x) < 1))


def test_kernel_machine_of_rows_that_repeat(spark):
    frame = spark.createDataFrame([(i, float(i % 2), i % 2) for i in range(50)], "k long, a double, y int")
    found = fits.fit_kernel(frame, ["a"], "y", ["k"])
    assert len(found.support) == 2 and found.forward(np.array([[0.0], [1.0]])).round().tolist() == [0, 1]


def test_a_network_of_one_worker_is_that_of_arrays(rows):
    x, y, mean, std = arrays(rows)
    one = fits.fit_network(rows, ["a", "b", "c"], "y", ["k"], width=8, epochs=2)
    two = models.fit_network(x, y, ["a", "b", "c"], mean, std, width=8, epochs=2)
    assert np.allclose(one.forward(x), two.forward(x), atol=1e-9) and np.allclose([h["loss"] for h in one.history], [h["loss"] for h in two.history])


def test_workers_are_averaged_by_their_rows(rows):
    known = fits.labelled(rows, ["a", "b", "c"], "y", *fits.statistics(rows, ["a", "b", "c"], "y")[1:], 1e-6, ["k"]).withColumn("worker", (F.col("k") % 3 % 2).cast("int"))
    begin = models.NetworkState.initial(3, 4, 7)
    got, loss = fits._epoch(known, begin, 7, 1, ["k"])
    flats, losses, sizes = [], [], []
    for worker in (0, 1):
        own = known.where(F.col("worker") == worker).toPandas().sort_values("k")
        state = begin.filled(begin.flat())
        losses.append(state.epoch(np.stack(own.z.to_list()), own.y.to_numpy(int), np.random.default_rng([7, 1, worker])))
        flats.append(state.flat())
        sizes.append(len(own))
    assert np.allclose(got.flat()[:-1], np.average(flats, axis=0, weights=sizes)[:-1]) and np.isclose(loss, np.average(losses, weights=sizes))
    many = fits.fit_network(rows, ["a", "b", "c"], "y", ["k"], width=16, epochs=12, worker_rows=150)
    assert len(many.history) == 12 and many.history[-1]["loss"] < many.history[0]["loss"]


def test_a_patch_network_of_one_worker_is_that_of_arrays(spark):
    rng = np.random.default_rng(6)
    x, y = rng.random((60, 2 * 5 * 5)), rng.integers(0, 2, 60)
    table = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k long, values array<double>, y int").repartition(3)
    hashed = F.pmod(F.xxhash64("k", F.lit(42)), F.lit(1 << 24))
    kept = [r.k for r in table.where(hashed < 0.8 * (1 << 24)).orderBy(hashed, "k").collect()]
    own = np.isin(np.arange(60), kept)
    one = patchnet.fit_rows(table, 2, 5, "y", ["k"], width=3, epochs=2)
    two = patchnet.fit(x[kept].reshape(-1, 2, 5, 5), y[kept], width=3, epochs=2)
    assert 30 < own.sum() < 60 and all(np.allclose(a, b) for p, q in zip(one.layers, two.layers, strict=True) for a, b in zip(p, q, strict=True))
    p = one.probabilities(x[~own].reshape(-1, 2, 5, 5))
    assert np.isclose(one.history[-1]["val_loss"], -np.log(np.where(y[~own] == 1, p, 1 - p)).mean())
    many = patchnet.fit_rows(table, 2, 5, "y", ["k"], width=3, epochs=1, worker_rows=10)
    assert len(many.history) == 1 and np.isfinite(many.history[0]["loss"])


def test_too_few_rows(rows):
    for fit in (lambda r: fits.fit_logistic(r, ["a"], "y"), lambda r: fits.fit_kernel(r, ["a"], "y", ["k"]), lambda r: fits.fit_network(r, ["a"], "y", ["k"])):
        with pytest.raises(ValueError, match="too few"):
            fit(rows.where("k = 1"))
