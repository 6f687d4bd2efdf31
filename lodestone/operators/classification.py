"""Stratified folds and sparse logistic models, fitted for all folds at once by passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.statistics import running
from lodestone.operators.written import write_once

STRETCHES = 256


def stratified_folds(rows: DataFrame, key: str, label: str, most: int = 5, seed: int = 42) -> tuple[DataFrame, int]:
    """rows with fold, and the number of folds: `most`, or the size of the smallest class where that is less (then at least 1).

    Each class is dealt out in turn, in the order of a hash of the key: its folds differ by one row at most. The running counts
    are cut into STRETCHES, so that no task holds a class. Rows without label are left out; ties of the hash go by key.
    """
    rows = rows.where(F.col(label).isNotNull())
    sizes = [r[0] for r in rows.groupBy(label).agg(F.count("*").alias("n")).select("n").collect()]  # a number a class
    folds = max(1, min([most, *sizes]))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    placed = rows.withColumn("__place", place).withColumn("__stretch", F.conv(F.substring("__place", 1, 2), 16, 10).cast("int"))
    counted = running(placed, [label], "__stretch", ["__place", key], {"__at": F.lit(1)})
    return counted.withColumn("fold", F.pmod(F.col("__at") - 1, F.lit(folds)).cast("int")).drop("__place", "__stretch", "__at"), folds


def _solve(hessian: np.ndarray, linear: np.ndarray, start: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The least of x'Hx / 2 - linear'x + l1 |x| + l2 x'x / 2 by coordinate descent; the last coordinate (the intercept) is free."""
    x, penal1, penal2 = start.copy(), np.full(len(start), l1), np.full(len(start), l2)
    penal1[-1] = penal2[-1] = 0.0
    scale = np.diag(hessian) + penal2
    for _ in range(2000):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            rest = linear[j] - hessian[j] @ x + hessian[j, j] * x[j]
            new = np.sign(rest) * max(abs(rest) - penal1[j], 0.0) / scale[j]
            moved = max(moved, abs(new - x[j]) * np.sqrt(scale[j]))
            x[j] = new
        if moved < 1e-10:
            break
    return x


class SparseLogistic:
    """Logistic regression with an elastic net: the least of c * (weighted log-loss) + alpha |w| + (1 - alpha) w'w / 2, the intercept free.

    One model for each of `held` (a fold, which it leaves out, or -1: none). Each Newton step is one pass: tasks sum the gradients and
    curvatures of their rows for all models at once, and send one small matrix a model; the driver solves the quadratic
    models by coordinate descent and halves a step that doesn't lower the loss (one more pass). What reaches the driver grows with
    features, models and tasks, not with rows.
    """

    def __init__(self, rows: DataFrame, features: list[str], label: str, held: list[int], c: float = 1.0, alpha: float = 1.0, balanced: bool = True, steps: int = 60) -> None:
        self.features, self.label, self.held, self.c, self.alpha, self.steps = features, label, held, c, alpha, steps
        clean = [F.when(F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf")), 0.0).otherwise(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in features]
        self.rows = write_once(rows.select(F.col(label).cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), *clean), "training")
        sizes = {(r.fold, r.label): r.n for r in self.rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}  # a number a fold and class
        self.weights = {}
        for h in held:
            n = [sum(m for (f, y), m in sizes.items() if f != h and y == k) for k in (0, 1)]
            self.weights[h] = [sum(n) / (2 * m) if m and balanced else 1.0 for m in n]
        self.coefficients = {h: np.zeros(len(features) + 1) for h in held}
        self._fit()

    def _sums(self, at: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """For each model loss, gradient and curvature of the log-loss at these coefficients."""
        features, weights, size = self.features, self.weights, len(self.features) + 1

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {h: np.zeros(1 + size + size * size) for h in at}
            for batch in batches:
                x = np.column_stack([*[batch.column(f).to_numpy(zero_copy_only=False) for f in features], np.ones(len(batch))])
                y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                for h, w in at.items():
                    some = fold != h
                    own, sign = x[some], 2.0 * y[some] - 1
                    s = np.where(y[some] == 1, weights[h][1], weights[h][0])
                    margin = own @ w * sign
                    p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
                    total[h][0] += (s * np.logaddexp(0, -margin)).sum()
                    total[h][1 : size + 1] += -(own.T @ (s * sign * p))
                    total[h][size + 1 :] += ((own * (s * p * (1 - p))[:, None]).T @ own).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], names=["model", "sums"])

        told = self.rows.mapInArrow(partial, "model int, sums array<double>")
        told = told.select("model", F.posexplode("sums").alias("at", "x")).groupBy("model", "at").agg(F.sum("x").alias("x"))
        out = {h: np.zeros(1 + size + size * size) for h in at}
        for r in told.collect():  # features squared numbers a model
            out[r.model][r["at"]] = r.x
        return {h: (t[0], t[1 : size + 1], t[size + 1 :].reshape(size, size)) for h, t in out.items()}

    def _objective(self, loss: float, w: np.ndarray) -> float:
        return self.c * loss + self.alpha * np.abs(w[:-1]).sum() + (1 - self.alpha) * (w[:-1] ** 2).sum() / 2

    def _fit(self) -> None:
        at, l1, l2 = dict(self.coefficients), self.alpha, 1 - self.alpha
        open_, sums = set(self.held), self._sums(at)
        for _ in range(self.steps):
            aim = {}
            for h in open_:
                _, gradient, curve = sums[h]
                curve = self.c * curve + np.diag(np.full(len(gradient), 1e-10 * (1 + np.trace(curve))))
                aim[h] = _solve(curve, curve @ at[h] - self.c * gradient, at[h], l1, l2)
            share, waiting = 1.0, set(aim)
            while waiting and share > 1e-6:  # models whose step doesn't help try half of it
                tried = {h: at[h] + share * (aim[h] - at[h]) for h in waiting}
                new = self._sums(tried)
                for h in list(waiting):
                    before, after = self._objective(sums[h][0], at[h]), self._objective(new[h][0], tried[h])
                    if after <= before:
                        if before - after <= 1e-9 * (1 + abs(before)):
                            open_.discard(h)
                        at[h], sums[h] = tried[h], new[h]
                        waiting.discard(h)
                share /= 2
            open_ -= waiting
            if not open_:
                break
        self.coefficients, self.sums = at, sums

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows with guess (0 or 1), each by the model that left its fold out."""
        models = rows.sparkSession.createDataFrame([(h, [float(x) for x in w]) for h, w in self.coefficients.items()], "fold int, __w array<double>")
        value = F.get("__w", F.lit(len(self.features)))
        for k, f in enumerate(self.features):
            x = F.col(f).cast("double")
            value = value + F.get("__w", F.lit(k)) * F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
        return rows.join(F.broadcast(models), "fold").withColumn("guess", (value > 0).cast("int")).drop("__w")  # a row a fold


def metrics(judged: DataFrame, by: list[str]) -> DataFrame:
    """(label, guess) -> tp, fp, fn, tn, accuracy, precision, recall, f1 by the given columns; shares of nothing are 0."""
    cell = lambda y, g: F.sum(((F.col("label") == y) & (F.col("guess") == g)).cast("long"))
    t = judged.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, n: F.round(F.when(n > 0, a / n).otherwise(0.0), 4)
    return t.select("*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
