"""Layout steps by blocks, fits of many groups in one job, and their single counterparts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.model import ReducerParams
from atlasmill.operators import block_steps, field, layout, linalg, logistic, metrics
from atlasmill.plans import benchmark


def graph(spark, seed=0):
    rng = np.random.default_rng(seed)
    sizes = {0: 300, 5: 40}
    nodes = [(g, p, [float(v) for v in rng.normal(size=2)] + [1.0]) for g, n in sizes.items() for p in range(n)]
    edges = [(g, int(a), int(b), float(w), 0) for g, n in sizes.items() for a, b, w in zip(rng.integers(0, n, 6 * n), rng.integers(0, n, 6 * n), rng.random(6 * n), strict=True) if a != b]
    edges += [(0, 7, b, 0.1, 0) for b in range(8, 300)]  # a hub: its block has several parts
    return (spark.createDataFrame(nodes, "grp bigint, pos bigint, s array<double>"),
            spark.createDataFrame(edges, "grp bigint, i bigint, j bigint, w double, kind int"))


def states(df) -> dict:
    return {(r["grp"], r["pos"]): np.array(r["s"]) for r in df.collect()}


def test_blocks_step_like_one_task(spark):
    nodes, edges = graph(spark)
    rule = layout._CurveRule(2, 1.5, 0.9, 20, 5, 42)
    whole = states(block_steps.run_steps(nodes, edges, rule, 4))
    cut = states(block_steps.run_steps(nodes, edges, rule, 4, block=64, part=200))
    assert whole.keys() == cut.keys() and len(whole) == 340
    assert max(np.abs(whole[k] - cut[k]).max() for k in whole) < 1e-9


def test_steps_are_the_plain_forces(spark):
    nodes, edges = graph(spark, 1)
    rule = layout._CurveRule(2, 1.5, 0.9, 20, 3, 42)
    got = states(block_steps.run_steps(nodes, edges, rule, 1))
    start = states(nodes)
    for g, n in ((0, 300), (5, 40)):
        y = np.array([start[g, p] for p in range(n)])
        force = np.zeros((n, 2))
        for r in edges.where(F.col("grp") == g).collect():
            gap = y[r["i"], :2] - y[r["j"], :2]
            force[r["i"]] += rule.pull(0, np.array([gap @ gap]), np.array([r["w"]]), np.array([0]))[0] * gap
        for offset in rule.offsets(0, n):
            for i in range(n):
                gap = y[i, :2] - y[(i + offset) % n, :2]
                force[i] += rule.push(0, np.array([gap @ gap]), y[i:i + 1])[0] * gap
        want = rule.move(0, y, force)
        assert np.allclose([got[g, p] for p in range(n)], want, atol=1e-9)


def test_redrawn_pairs(spark):
    """Further pairs are near, new, distinct, and as many as wanted where there are enough; both forms keep the same rule."""
    rng = np.random.default_rng(3)
    coords = np.vstack((rng.normal(size=(400, 2)) * 4, rng.normal(size=(100, 2)) * 30, [[500.0, 500.0]]))
    n, n_far = len(coords), 12
    near = {(i, (i + 1) % n) for i in range(n)}
    d2 = ((coords[:, None] - coords[None]) ** 2).sum(axis=2)
    i, j = layout.near_draws(coords, n_far, np.array([a * n + b for a, b in near]), 7)
    nodes = spark.createDataFrame([(0, p, [float(v) for v in c]) for p, c in enumerate(coords)], "grp bigint, pos bigint, s array<double>")
    frame = layout.near_draws_frame(nodes, spark.createDataFrame([(0, *p) for p in near], "grp bigint, i bigint, j bigint"), n_far, 2, 7)
    for pairs in (list(zip(i.tolist(), j.tolist(), strict=True)), [(r["i"], r["j"]) for r in frame.collect()]):
        assert len(pairs) == len(set(pairs)) and not near & set(pairs)
        assert all(a != b and d2[a, b] < layout.LOCAL_REACH ** 2 for a, b in pairs)
        per_node = np.bincount([a for a, _ in pairs], minlength=n)
        assert per_node.max() <= n_far and (per_node[:400] == n_far).mean() > 0.98 and per_node[-1] == 0


def points(seed=0, n=90, dim=6):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    return rng.normal(size=(3, dim))[label] * 3 + rng.normal(size=(n, dim)), label


def test_umap_by_group_is_umap_of_each_group(spark):
    rows = [(g, f"p{i:03d}", [float(v) for v in x]) for g in (3, 8) for i, x in enumerate(points(g, 60 + g)[0])]
    df = spark.createDataFrame(rows, "round int, identifier string, vec array<double>")
    params = ReducerParams(n_neighbors=10)
    both, _ = layout.umap(df, 2, params, 12, by="round")
    got = {(r["round"], r["identifier"]): r["coords"] for r in both.collect()}
    assert len(got) == len(rows)
    for g in (3, 8):
        one, _ = layout.umap(df.where(F.col("round") == g).drop("round"), 2, params, 12)
        for r in one.collect():
            assert np.allclose(r["coords"], got[g, r["identifier"]], atol=1e-6)


def test_contrastive_pca_by_group(spark):
    rows = [(g, f"p{i:03d}", [float(v) for v in x]) for g in (0, 1, 2) for i, x in enumerate(points(g, 50 + g)[0])] + [(9, "lone", [0.0] * 6)]
    df = spark.createDataFrame(rows, "round int, identifier string, vec array<double>")
    back = spark.createDataFrame([([float(v) for v in x],) for x in points(5)[0]], "vec array<double>")
    m = linalg.moments(back, "vec")
    for scaled in (True, False):
        got = {(r["round"], r["identifier"]): r["coords"] for r in linalg.contrastive_pca_by_group(df, "round", m, 2, standard_scale=scaled, part_rows=20).collect()}
        assert got[9, "lone"] is None
        for g in (0, 1, 2):
            one, _ = linalg.contrastive_pca(df.where(F.col("round") == g), back, 2, standard_scale=scaled)
            for r in one.collect():
                assert np.allclose(r["coords"], got[g, r["identifier"]], atol=1e-7)


def test_contrastive_axes_solve_the_eigenproblem(spark):
    """Residual and scaling of target v = value (background + mu I) v."""
    a, b = (np.cov(points(s)[0].T) for s in (1, 2))
    values, axes = linalg.contrastive_axes(a, b, 3, 1e-3)
    shifted = b + 1e-3 * np.eye(len(b))
    assert np.allclose(a @ axes, shifted @ axes * values, atol=1e-9) and np.allclose(axes.T @ shifted @ axes, np.eye(3), atol=1e-9)


def test_refits_of_all_methods(spark):
    x, label = points(4, 80)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(label[i])) for i, r in enumerate(x)], "identifier bigint, vec array<double>, label int")
    grid = benchmark.bootstrap_refit(df, 3, [1, 15], methods=("pca", "ppca", "umap"), background=df.where("label = 1"), params=ReducerParams(n_neighbors=8), iterations=15)
    got = {(r["method"], r["round"], r["metric"]): r["value"] for r in grid.collect()}
    assert {k[0] for k in got} == {"pca", "ppca", "umap"} and {k[1] for k in got} == {0, 1, 2}
    assert {k[2] for k in got} == {"trustworthiness_1", "trustworthiness_15", "knn_accuracy", "silhouette"} and len(got) == 36
    # one round alone, fitted by the single operators
    sample = metrics.bootstrap_samples(df, "identifier", 3).where("round = 1").select("identifier", "vec", "label")
    fits = {"pca": linalg.pca(sample, 2)[0], "ppca": linalg.contrastive_pca(sample, df.where("label = 1"), 2)[0], "umap": layout.umap(sample, 2, ReducerParams(n_neighbors=8), 15)[0]}
    for method, coords in fits.items():
        low = coords.select("identifier", F.col("coords").alias("low")).join(sample.select("identifier", "vec"), "identifier")
        trust = {r["k"]: r["trustworthiness"] for r in metrics.trustworthiness(metrics.neighborhoods(low, 15), 64, [1, 15]).collect()}
        assert abs(trust[1] - got[method, 1, "trustworthiness_1"]) < 1e-6 and abs(trust[15] - got[method, 1, "trustworthiness_15"]) < 1e-6
    with pytest.raises(ValueError, match="background"):
        benchmark.bootstrap_refit(df, 1, [1], methods=("ppca",))


def gradient_fit(x, y, weight, classes):
    """Weights by plain gradient descent with a safe step, to compare with Newton's."""
    w, size = np.zeros((classes, x.shape[1])), len(x)
    rate = 1.0 / (weight.max() * (x * x).sum(axis=1).max() * size)
    shrunk = np.array([1.0] * (x.shape[1] - 1) + [0.0])
    velocity = np.zeros_like(w)
    for _ in range(8_000):
        ahead = w + 0.97 * velocity
        z = x @ ahead.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(size), y] -= 1
        slope = (p * weight[:, None]).T @ x + shrunk * ahead
        velocity = 0.97 * velocity - rate * slope
        w = w + velocity
        if np.abs(slope).max() < 1e-9:
            break
    return w


def test_newton_finds_the_plain_optimum():
    x, y = points(6, 120)
    x = np.column_stack(((x[:, :2] - x[:, :2].mean(axis=0)) / x[:, :2].std(axis=0), np.ones(len(x))))
    weight = (len(y) / (3 * np.bincount(y)))[y]
    fit = logistic.Fit(3, 3)
    for _ in range(50):
        if fit.still:
            break
        fit.take(logistic.fold_sums(x, y, weight, fit.coef.reshape(3, 3)))
    want = gradient_fit(x, y, weight, 3)
    shift = lambda w: w - w.mean(axis=0)  # noqa: E731 - equal shifts of all classes change nothing
    assert fit.still and np.allclose(shift(fit.coef.reshape(3, 3)), shift(want), atol=1e-4)


def test_macro_f1_of_groups(spark):
    x, y = points(6, 150)
    rows = [(g, i, "abc"[int(y[i])], float(x[i, 2 * g]), float(x[i, 2 * g + 1])) for g in (0, 1) for i in range(150)]
    rows += [(2, i, "only", 0.5 * i, 1.0) for i in range(9)] + [(3, 0, "a", 1.0, 2.0), (3, 1, "b", 2.0, 1.0), (0, 999, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "projection_name int, identifier bigint, label string, x double, y double")
    got = {r["projection_name"]: r["macro_f1"] for r in metrics.macro_f1(df, by=["projection_name"]).collect()}
    assert got[2] is None and got[3] is None
    for g in (0, 1):
        one = df.where((F.col("projection_name") == g) & F.col("label").isNotNull())
        assert abs(metrics.macro_f1(one.drop("projection_name")).first()[0] - got[g]) < 1e-12
        # plain: the same folds, one fit each
        scaled = metrics.standard_scaled(one, ["x", "y"])
        placed = metrics.stratified_folds(scaled, "identifier", "label", 5).toPandas()
        z, label = np.column_stack((placed["x"], placed["y"], np.ones(150))), placed["label"].map({"a": 0, "b": 1, "c": 2}).to_numpy()
        guess = np.zeros(150, int)
        for fold in range(5):
            train = (placed["fold"] != fold).to_numpy()
            weight = (train.sum() / (3 * np.bincount(label[train])))[label]
            guess[~train] = (z[~train] @ gradient_fit(z[train], label[train], weight[train], 3).T).argmax(axis=1)
        f1 = np.mean([2 * ((guess == c) & (label == c)).sum() / ((guess == c).sum() + (label == c).sum()) for c in range(3)])
        assert abs(f1 - got[g]) < 1e-12


def test_large_groups_are_fitted_in_parts(spark):
    x, y = points(7, 200)
    rows = spark.createDataFrame([(4, i, float(x[i, 0]), float(x[i, 1]), int(y[i]), i % 3) for i in range(200)], "grp bigint, row bigint, x double, y double, class bigint, fold bigint")
    sizes = rows.groupBy("grp", "fold", "class").agg(F.count("*").alias("n"))
    cells = lambda part: sorted(map(tuple, logistic.confusion(rows, sizes, part).collect()))
    assert cells(70) == cells(1000) and sum(c[3] for c in cells(70)) == 200


def exact_field(y):
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap ** 2).sum(axis=2))
    np.fill_diagonal(q, 0)
    return ((q * q)[:, :, None] * gap).sum(axis=1), q.sum(axis=1)


@pytest.mark.parametrize("n, k, scale, outliers", [(500, 2, 10.0, 0), (500, 2, 1e-4, 0), (4000, 2, 40.0, 0), (4000, 2, 40.0, 3), (1200, 3, 12.0, 2), (1, 2, 1.0, 0), (60, 2, 0.0, 0)])
def test_repulsion_by_cells(n, k, scale, outliers):
    """One method for any number of points: 95 of 100 forces within five per cent, with and without points far away."""
    rng = np.random.default_rng(0)
    y = (rng.normal(size=(20, k)) * scale)[rng.integers(0, 20, n)] + rng.normal(size=(n, k)) * scale / 12
    y[:outliers] = rng.normal(size=(outliers, k)) * scale * 300
    force, q = field.repulsion(y)
    want, total = exact_field(y)
    size = np.linalg.norm(want, axis=1)
    error = np.linalg.norm(force - want, axis=1)
    if scale == 0 or n == 1:  # all in one place: nothing pushes; what is left is the interpolation's error for each pair
        assert error.max() <= 0.002 * n
    else:
        assert np.quantile(error / size, 0.95) < 0.05
    assert abs(q.sum() - total.sum()) <= 0.01 * total.sum() + 1e-9


def test_fields_of_blocks_and_of_one_task(spark):
    nodes, edges = graph(spark, 2)
    nodes = nodes.select("grp", "pos", F.concat(F.slice("s", 1, 2), F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])).alias("s"))
    rule = layout._GradientRule(2, 8, 5.0)
    whole = states(block_steps.run_steps(nodes, edges, rule, 3))
    cut = states(block_steps.run_steps(nodes, edges, rule, 3, block=100, part=400))
    assert len(whole) == 340 and max(np.abs(whole[k] - cut[k]).max() for k in whole) < 1e-7 * max(np.abs(v).max() for v in whole.values())


def test_components_of_long_vectors(spark, monkeypatch):
    """Beyond the limit of the covariance matrix: the same components by passes, with a small residual."""
    rng = np.random.default_rng(0)
    n, dim = 60, 5000
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, dim)) + 0.3 * rng.normal(size=(n, dim)) + rng.normal(size=dim)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "identifier int, vec array<double>").repartition(3)
    coords, info = linalg.pca(df, 2)
    got = np.array([r["coords"] for r in coords.orderBy("identifier").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = u[:, :2] * s[:2] * np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(axis=1)])
    assert info["svd_solver"] == "lanczos" and info["residual"] < 1e-6 and np.allclose(got, want, atol=1e-4 * np.abs(want).max())
    assert np.allclose(info["explained_variance_ratio"], s[:2] ** 2 / (s ** 2).sum(), rtol=1e-6)
    small = spark.createDataFrame([(i, r[:40].tolist()) for i, r in enumerate(x)], "identifier int, vec array<double>")
    whole = {r["identifier"]: r["coords"] for r in linalg.pca(small, 3)[0].collect()}
    monkeypatch.setattr(linalg, "MAX_DIM", 30)
    passed = {r["identifier"]: r["coords"] for r in linalg.pca(small, 3)[0].collect()}
    assert all(np.allclose(whole[i], passed[i], atol=1e-5) for i in whole)


def test_widths_of_the_fan_in(spark, tmp_path):
    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert linalg.fan_widths(df, 64) == [2]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        first, last = linalg.fan_widths(df, 64)
        assert first > 64 and last <= 64 and last == int(first ** 0.5)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_group_of_ten_thousand_runs_in_one_task_and_large_ones_keep_their_edges_packed(spark, monkeypatch):
    from atlasmill.operators import layout

    edges = spark.createDataFrame([(0, 2, k, k % 2, 0, 0, 1.0, 1 - k % 2) for k in range(5, 0, -1)], "grp bigint, block bigint, i0 int, b int, part int, src int, w double, kind int")
    edges = edges.selectExpr("grp", "block", "part", "cast(20 + i0 as bigint) as i", "cast(7 * i0 as bigint) as j", "w", "kind")
    row = block_steps._packed_edges(edges, 10).toArrow()
    got = block_steps._unpacked_edges(row)
    assert got["i"].tolist() == [1, 2, 3, 4, 5] and got["j"].tolist() == [7, 14, 21, 28, 35] and got["kind"].tolist() == [0, 1, 0, 1, 0]
    assert len(block_steps._unpacked_edges(row[:0])["i"]) == 0

    def refuse(*_):
        raise AssertionError("a job per step")

    monkeypatch.setattr(block_steps, "_open", refuse)
    n = 10_000
    nodes = spark.range(n).selectExpr("cast(0 as bigint) as grp", "id as pos", "array(cast(id as double), 0D, 1D) as s")
    links = spark.range(n).selectExpr("cast(0 as bigint) as grp", "id as i", f"(id + 1) % {n} as j", "1D as w", "0 as kind")
    rule = layout._CurveRule(2, 1.5, 0.9, 2, 1, 1)
    assert block_steps.run_steps(nodes, links, rule, 2).count() == n
