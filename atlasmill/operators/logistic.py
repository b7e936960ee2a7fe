"""Cross-validated logistic regressions of many groups in one job.

Every group (a projection, a resampling round) is fitted once per fold: multinomial, classes balanced, weights (not intercepts)
shrunk as with C = 1. Newton steps need a gradient, a Hessian and a loss per group and fold, which are sums over rows: a
group is cut into parts of bounded size, each packed in one row once, coefficients travel to the parts, sums travel back.
A group of one part is fitted where it lies, by the same functions. The Hessian has (3 x classes)^2 cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow, release, ship_package
from .arrays import vector
from .sweep import MAX_TASKS

#: Rows of a part; Newton steps at most; change of a coefficient at which a fit stands; cells of a sum at a time.
PART, STEPS, STILL, CELLS = 1 << 18, 60, 1e-8, 1 << 17


def fold_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of weighted rows, in one array; ``x`` ends in a column of ones, ``coef`` is (classes, features)."""
    c, f = coef.shape
    loss, slope, bend = 0.0, np.zeros((c, f)), np.zeros((c * f, c * f))
    corner = bend.reshape(c, f, c, f)
    width = max(1, CELLS // (c * f))
    for at in range(0, len(x), width):
        part, w, label = x[at:at + width], weight[at:at + width], y[at:at + width]
        z = part @ coef.T
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=1, keepdims=True)
        p /= total
        here = np.arange(len(part))
        loss -= float(w @ (z[here, label] - np.log(total[:, 0])))
        spread = (p[:, :, None] * part[:, None, :]).reshape(len(part), -1)
        scaled = spread * w[:, None]
        bend -= scaled.T @ spread
        corner[np.arange(c), :, np.arange(c), :] += (scaled.T @ part).reshape(c, f, f)
        p[here, label] -= 1.0
        slope += (p * w[:, None]).T @ part
    return np.concatenate(([loss], slope.ravel(), bend.ravel()))


class Fit:
    """Damped Newton steps of one fold, fed with sums at the coefficients it asks for."""

    def __init__(self, classes: int, features: int, state: np.ndarray | None = None):
        self.shape, self.size = (classes, features), classes * features
        if state is None:
            state = np.concatenate((np.zeros(2 * self.size), [np.inf, 0.0]))
        self.coef, self.last = state[:self.size].copy(), state[self.size:2 * self.size].copy()
        self.loss, self.still = float(state[-2]), bool(state[-1])

    def state(self) -> np.ndarray:
        return np.concatenate((self.coef, self.last, [self.loss, float(self.still)]))

    def take(self, sums: np.ndarray) -> None:
        c, f = self.shape
        shrunk = np.tile([1.0] * (f - 1) + [0.0], c)
        loss = sums[0] + (shrunk * self.coef ** 2).sum() / 2
        if loss > self.loss + 1e-12 * abs(self.loss):  # too far: half the way back
            self.still = bool(np.abs(self.coef - self.last).max() < STILL)
            self.coef = self.last.copy() if self.still else (self.coef + self.last) / 2
            return
        slope = sums[1:1 + self.size] + shrunk * self.coef
        hessian = sums[1 + self.size:].reshape(self.size, self.size) + np.diag(shrunk)
        # equal shifts of all intercepts change nothing: a small ridge picks one
        step = np.linalg.solve(hessian + 1e-9 * (1 + np.trace(hessian) / self.size) * np.eye(self.size), slope)
        self.loss, self.last, self.coef = loss, self.coef, self.coef - step
        self.still = bool(np.abs(step).max() < STILL)


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(vector(table["row"], np.int64))
    x = np.column_stack([vector(table[c])[order] for c in ("x", "y")] + [np.ones(len(order))])
    return x, vector(table["class"], np.int64)[order], vector(table["fold"], np.int64)[order]


def _weights(counts: np.ndarray, fold: int) -> np.ndarray:
    """Weight of every class outside the fold; ``counts`` is (folds, classes)."""
    left = counts.sum(axis=0) - counts[fold]
    return np.divide(left.sum(), (left > 0).sum() * left, out=np.zeros(len(left)), where=left > 0)


def _counts(value: bytes, folds: int) -> np.ndarray:
    return np.frombuffer(value, np.int64).reshape(folds, -1)


def _closed(rows: pa.Table, facts: pa.Table) -> pa.Table:
    x, y, fold = _rows(rows)
    folds = facts["folds"][0].as_py()
    counts = _counts(facts["counts"][0].as_py(), folds)
    guess, coefs = np.zeros(len(x), np.int64), []
    for k in range(folds):
        train, weight = fold != k, _weights(counts, k)
        fit = Fit(counts.shape[1], x.shape[1])
        if coefs:  # folds share most rows: the fit without the last one is near
            fit.coef = coefs[-1].ravel().copy()
        tx, ty = x[train], y[train]
        tw = weight[ty]
        for _ in range(STEPS):
            if fit.still:
                break
            fit.take(fold_sums(tx, ty, tw, fit.coef.reshape(fit.shape)))
        coefs.append(fit.coef.reshape(fit.shape))
        guess[~train] = (x[~train] @ coefs[-1].T).argmax(axis=1)
    cells, n = np.unique(y * counts.shape[1] + guess, return_counts=True)
    grp = facts["grp"][0].as_py()
    return pa.table({"grp": pa.array([grp] * len(cells), pa.int64()), "truth": cells // counts.shape[1], "guess": cells % counts.shape[1], "n": n})


def _packed(rows: pa.Table) -> pa.Table:
    """A part as one row: its coordinates, classes and folds by row number."""
    x, y, fold = _rows(rows)
    value = x[:, :2].tobytes() + y.astype(np.int32).tobytes() + fold.astype(np.int32).tobytes()
    return pa.table({"grp": rows["grp"][:1], "part": rows["part"][:1], "n": pa.array([len(y)], pa.int32()), "value": pa.array([value], pa.binary())})


def _unpacked(value: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.column_stack((np.frombuffer(value, np.float64, 2 * n).reshape(n, 2), np.ones(n)))
    y, fold = np.frombuffer(value, np.int32, 2 * n, 16 * n).reshape(2, n)
    return x, y.astype(np.int64), fold.astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Part after part with the state of its group: (grp, x, y, fold, counts, states)."""
    for b in batches:
        for at in range(b.num_rows):
            one = {c: b.column(c)[at].as_py() for c in ("grp", "n", "value", "folds", "counts", "state")}
            states = np.frombuffer(one["state"]).reshape(one["folds"], -1)
            yield one["grp"], *_unpacked(one["value"], one["n"]), _counts(one["counts"], one["folds"]), states


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one part for every fold that still moves."""
    for grp, x, y, fold, counts, states in _parts(batches):
        for k, state in enumerate(states):
            fit, train, weight = Fit(counts.shape[1], x.shape[1], state), fold != k, _weights(counts, k)
            if not fit.still:
                sums = fold_sums(x[train], y[train], weight[y[train]], fit.coef.reshape(fit.shape)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([k], pa.int32()), pa.array([sums], pa.binary())], names=["grp", "fold", "sums"])


def _stepped(facts: pa.Table, sums: pa.Table) -> pa.Table:
    folds = facts["folds"][0].as_py()
    counts, states = _counts(facts["counts"][0].as_py(), folds), np.frombuffer(facts["state"][0].as_py()).reshape(folds, -1).copy()
    features = (states.shape[1] - 2) // (2 * counts.shape[1])
    for k in range(folds):
        mine = sorted(s for s, f in zip(sums["sums"].to_pylist(), sums["fold"].to_pylist(), strict=True) if f == k)
        if mine:
            fit = Fit(counts.shape[1], features, states[k])
            fit.take(np.sum([np.frombuffer(s) for s in mine], axis=0))
            states[k] = fit.state()
    return facts.set_column(facts.schema.get_field_index("state"), "state", pa.array([states.tobytes()], pa.binary())).set_column(
        facts.schema.get_field_index("still"), "still", pa.array([bool(states[:, -1].all())]))


def _guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for grp, x, y, fold, counts, states in _parts(batches):
        guess = np.zeros(len(x), np.int64)
        for k, state in enumerate(states):
            guess[fold == k] = (x[fold == k] @ Fit(counts.shape[1], x.shape[1], state).coef.reshape(counts.shape[1], -1).T).argmax(axis=1)
        cells, n = np.unique(y * counts.shape[1] + guess, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([grp] * len(cells), pa.int64()), pa.array(cells // counts.shape[1]), pa.array(cells % counts.shape[1]), pa.array(n)], names=["grp", "truth", "guess", "n"])


_CELLS = "grp bigint, truth bigint, guess bigint, n bigint"
_FACTS = "grp bigint, folds int, counts binary, parts int, state binary, still boolean"


def confusion(rows: DataFrame, sizes: DataFrame, part: int = PART) -> DataFrame:
    """Cells (grp, truth, guess, n) of the predictions that every row gets from the fit without its fold.

    ``rows(grp, row, x, y, class, fold)`` with ``row`` unique in the group and classes from 0; ``sizes(grp, fold, class, n)``
    counts them.
    """
    ship_package(rows.sparkSession)

    def facts_of(table: pa.Table) -> pa.Table:
        fold, label, n = (vector(table[c], np.int64) for c in ("fold", "class", "n"))
        counts = np.zeros((fold.max() + 1, label.max() + 1), np.int64)
        counts[fold, label] = n
        start = np.tile(Fit(counts.shape[1], 3).state(), (len(counts), 1))
        return pa.table({"grp": table["grp"][:1], "folds": pa.array([len(counts)], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary()),
                         "parts": pa.array([-(-int(counts.sum()) // part)], pa.int32()), "state": pa.array([start.tobytes()], pa.binary()), "still": [False]})

    facts = cut_lineage(sizes.groupBy("grp").applyInArrow(facts_of, _FACTS))
    small, large = facts.where("parts = 1"), facts.where("parts > 1")
    cells = rows.join(small.select("grp"), "grp", "left_semi").groupBy("grp").cogroup(small.groupBy("grp")).applyInArrow(_closed, _CELLS)
    if large.isEmpty():
        return cells
    cut = rows.join(large.select("grp", "parts"), "grp").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    n_parts = large.agg(F.sum("parts")).first()[0]
    held = cut_lineage(cut.repartition(min(n_parts, MAX_TASKS), "grp", "part").groupBy("grp", "part").applyInArrow(_packed, "grp bigint, part int, n int, value binary"))
    told = lambda f: held.join(F.broadcast(f.select("grp", "folds", "counts", "state")), "grp")  # noqa: E731 - few groups have several parts
    now = cut_lineage(large)
    for _ in range(STEPS):
        sums = map_arrow(told(now.where("not still")), _partial, "grp bigint, fold int, sums binary")
        after = cut_lineage(now.groupBy("grp").cogroup(sums.groupBy("grp")).applyInArrow(_stepped, _FACTS))
        release(now)
        now = after
        if now.where("not still").isEmpty():
            break
    guesses = cut_lineage(map_arrow(told(now), _guessed, _CELLS))
    release(held)
    return cells.unionByName(guesses.groupBy("grp", "truth", "guess").agg(F.sum("n").alias("n")))
