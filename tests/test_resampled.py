"""Rounds that share one search give what a search in each round gives."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.operators import logistic, metrics, resampled, sweep
from atlasmill.plans import benchmark


def refused(*_args, **_kwargs):
    raise AssertionError("a search in each round")


def points(spark, n=160, labels=3):
    """Points on a lattice (ties everywhere), some of them copies, some rows without a label."""
    rng = np.random.default_rng(5)
    low = rng.integers(0, 9, (n, 2)).astype(float)
    vec = np.column_stack((low, rng.integers(0, 4, (n, 3)).astype(float)))
    vec[10:30] = vec[3]
    low[40:60] = low[7]
    rows = [(i, vec[i].tolist(), low[i].tolist(), None if i % 17 == 0 else int(rng.integers(0, labels))) for i in range(n)]
    return spark.createDataFrame(rows, "identifier bigint, vec array<double>, low array<double>, label int")


def found(df, *keys):
    return {tuple(r[c] for c in keys): r["value"] for r in df.collect()}


def test_grid_of_rounds_from_one_search(spark, monkeypatch):
    df = points(spark)
    drawn = metrics.bootstrap_samples(df, "identifier", 9, 0.8)
    want = found(benchmark._scored_rounds(drawn, df, 128, [1, 4], 5), "round", "metric")
    monkeypatch.setattr(metrics, "stack_groups", refused)
    got = found(benchmark.bootstrap_grid(df, 9, [1, 4], 0.8, 5), "round", "metric")
    assert got.keys() == want.keys() and len(got) == 36
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # lists that are too short for a round are made longer
    monkeypatch.setattr(resampled, "_list_length", lambda k, share, total: k)
    assert found(benchmark.bootstrap_grid(df, 9, [1, 4], 0.8, 5), "round", "metric") == pytest.approx(got)


def test_repeated_keys_are_searched_round_by_round(spark):
    df = points(spark, 40)
    assert not resampled.one_row_each(df.unionByName(df.limit(1)), ["identifier"], [], ["vec", "low"])
    assert not resampled.one_row_each(df.withColumn("low", F.array(F.lit(1.0), F.lit(None).cast("double"))), ["identifier"], [], ["vec", "low"])
    assert resampled.one_row_each(df, ["identifier"], [], ["vec", "low"])


def test_evaluation_of_rounds_from_one_search(spark, monkeypatch):
    rng = np.random.default_rng(6)
    xy = {"A": rng.normal(size=(150, 2)) * [1, 40], "B": rng.normal(size=(150, 2)) + 1000}
    xy["B"][20:50] = xy["B"][4]
    projections = spark.createDataFrame([(p, i, float(v[i, 0]), float(v[i, 1])) for p, v in xy.items() for i in range(150)], "projection_name string, identifier bigint, x double, y double")
    labels = spark.createDataFrame([(i, None if i % 19 == 0 else "abc"[i % 3], None if i % 31 == 0 else float(rng.integers(50, 90))) for i in range(150)], "identifier bigint, label string, seq_length double")
    run = lambda: found(benchmark.bootstrap_evaluation(projections, labels, 7, 4, 0.8), "round", "projection_name", "metric")
    with monkeypatch.context() as patch:
        patch.setattr(resampled, "one_row_each", lambda *_a: False)
        want = run()
    assert len(want) == 28
    with monkeypatch.context() as patch:
        patch.setattr(resampled, "_list_length", lambda k, share, total: 4)  # most rounds stay open and are searched again
        assert run() == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(benchmark, "_purity", refused)
    monkeypatch.setattr(metrics, "grouped_knn", refused)
    monkeypatch.setattr(resampled, "_list_length", lambda k, share, total: 60)
    assert run() == pytest.approx(want, abs=1e-9)


def test_sums_of_a_fold_stay_in_the_cache():
    rng = np.random.default_rng(7)
    x, y, weight, coef = np.column_stack((rng.normal(size=(60_000, 2)), np.ones(60_000))), rng.integers(0, 10, 60_000), rng.random(60_000), rng.normal(size=(10, 3))
    tracemalloc.start()
    sums = logistic.fold_sums(x, y, weight, coef)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    z = np.exp(x @ coef.T)
    p = z / z.sum(axis=1, keepdims=True)
    inner = np.einsum("na,nab->nab", p, np.eye(10)[None] - p[:, None, :])
    hessian = np.einsum("n,nab,ni,nj->aibj", weight, inner, x, x, optimize=True).reshape(30, 30)
    assert np.allclose(sums[31:].reshape(30, 30), hessian) and abs(sums[0] + weight @ np.log(p[np.arange(60_000), y])) < 1e-6
    assert np.allclose(sums[1:31].reshape(10, 3), ((p - np.eye(10)[y]) * weight[:, None]).T @ x)
    assert peak < 8 << 20


def test_a_round_of_a_large_table_is_fitted_in_one_task(spark, monkeypatch):
    """82,051 rows a round: no job a step."""
    df = spark.range(82_051).selectExpr("4L as grp", "id as row", "sin(id) as x", "cos(3 * id) as y", "id % 2 as class", "id % 3 as fold")
    monkeypatch.setattr(logistic, "map_arrow", refused)
    cells = logistic.confusion(df, df.groupBy("grp", "fold", "class").agg(F.count("*").alias("n"))).collect()
    assert sum(c["n"] for c in cells) == 82_051


def test_large_tables_are_not_copied_to_hundreds_of_blocks(spark):
    """A sweep sends every row to every block: 600,000 rows of 64 numbers must not become more than 24 GB."""
    rows = 600_000
    _, blocks = sweep.hash_blocks(spark.range(rows).withColumnRenamed("id", "gid"), rows, resampled.BLOCK_ROWS)
    assert blocks * rows * 600 < 24e9
