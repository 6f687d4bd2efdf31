"""Folds against a loop, and the sparse model against the conditions of its optimum."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from lodestone.operators.classification import SparseLogistic, metrics, stratified_folds
from lodestone.plans import training


def test_folds_equal_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(k * 3 % 997, rng.choice([0, 0, 0, 1])) for k in range(300)] + [(5000, None)]
    df, folds = stratified_folds(spark.createDataFrame(rows, "id long, label int"), "id", "label", seed=7)
    want, seen = {}, Counter()
    for key, label in sorted((r for r in rows if r[1] is not None), key=lambda r: (hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), r[0])):
        want[key] = (label, seen[label] % 5)
        seen[label] += 1
    assert folds == 5 and {r.id: (r.label, r.fold) for r in df.collect()} == want
    for label in (0, 1):
        sizes = Counter(f for y, f in want.values() if y == label)
        assert max(sizes.values()) - min(sizes.values()) <= 1
    few = spark.createDataFrame([(k, int(k < 3)) for k in range(20)], "id long, label int")
    assert stratified_folds(few, "id", "label")[1] == 3 and stratified_folds(few.limit(0), "id", "label")[0].count() == 0


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack((rng.normal(size=400), rng.normal(size=400) * 50, rng.normal(size=400), rng.integers(0, 2, 400)))
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.6 * x[:, 0] - 0.03 * x[:, 1] - 0.5)))).astype(int)
    rows = [(*map(float, r), int(label), k % 4) for k, (r, label) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, d double, label int, fold int").repartition(3)


@pytest.mark.parametrize(("c", "alpha"), [(1.0, 1.0), (0.05, 1.0), (0.3, 0.5)])
def test_the_fit_is_the_optimum(data, c, alpha):
    """Gradient and penalty balance for each kept weight; the others' gradients stay within the penalty."""
    x, y, df = data
    model = SparseLogistic(df, ["a", "b", "c", "d"], "label", [-1, 2], c=c, alpha=alpha)
    for held, w in model.coefficients.items():
        some = np.arange(len(y)) % 4 != held
        own, label = np.column_stack((x[some], np.ones(some.sum()))), y[some]
        weight = np.where(label == 1, len(label) / (2 * label.sum()), len(label) / (2 * (1 - label).sum()))
        gradient = c * own.T @ (weight * (1 / (1 + np.exp(-own @ w)) - label)) + np.append((1 - alpha) * w[:-1], 0.0)
        for j, g in enumerate(gradient):
            bound = 1e-3 * (1 + np.abs(own[:, j]).max())
            assert abs(g) < bound if j == 4 else abs(g + alpha * np.sign(w[j])) < bound if w[j] else abs(g) <= alpha + bound
    if c == 0.05:
        assert np.sum(model.coefficients[-1][:-1] == 0) >= 1


def test_held_out_metrics(data):
    x, y, df = data
    model = SparseLogistic(df, ["a", "b", "c", "d"], "label", [0, 1, 2, 3])
    judged = model.scores(df)
    for r in judged.collect():
        w = model.coefficients[r.fold]
        assert r.guess == int(w @ np.array([r.a, r.b, r.c, r.d, 1.0]) > 0)
    by = {r.fold: r for r in metrics(judged, ["fold"]).collect()}
    assert len(by) == 4 and all(r.tp + r.fp + r.fn + r.tn == 100 and r.accuracy > 0.7 for r in by.values())
    r = by[0]
    assert r.precision == round(r.tp / (r.tp + r.fp), 4) and r.f1 == round(2 * r.tp / (2 * r.tp + r.fp + r.fn), 4)


def test_odd_values_and_classes(spark):
    rows = [(float("nan"), 1, 0), (None, 0, 1), (float("inf"), 1, 1), (1.0, 0, 0)]
    df = spark.createDataFrame(rows, "a double, label int, fold int")
    assert SparseLogistic(df, ["a"], "label", [0, 1]).scores(df).count() == 4
    one = spark.createDataFrame([(1.0, 1, 0), (2.0, 1, 1)], "a double, label int, fold int")  # a class without rows
    assert {r.guess for r in SparseLogistic(one, ["a"], "label", [-1]).scores(one.selectExpr("a", "label", "-1 AS fold")).collect()} == {1}


def test_models_of_the_corpus(spark):
    rows = {r.fold: r for r in training.sparse_logistic(spark, SF).collect()}
    assert set(rows) == {-1, 0, 1, 2, 3, 4} and rows[-1].tp == sum(rows[k].tp for k in range(5))
    told = training.sparse_coefficients(spark, SF).collect()
    assert len({r.feature for r in told}) == len(told) <= len(training.NAMES)
