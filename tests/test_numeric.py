import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atlasmill.model import ReducerParams
from atlasmill.operators import distances as kernels
from atlasmill.operators import layout, linalg, metrics, neighbors
from atlasmill.operators import sweep as blocked
from atlasmill.operators.neighbors import distance_ranks, knn
from atlasmill.plans import backgrounds, benchmark


def frame(spark, x, ids=None, **cols):
    ids = ids if ids is not None else [f"p{i:04d}" for i in range(len(x))]
    rows = [(i, [float(v) for v in r], *[c[n] for c in cols.values()]) for n, (i, r) in enumerate(zip(ids, x))]
    kinds = {int: "int", str: "string", float: "double"}
    extra = "".join(f", {k} {kinds[type(v[0])]}" for k, v in cols.items())
    return spark.createDataFrame(rows, f"identifier string, vec array<double>{extra}")


def distances(x, metric="euclidean"):
    if metric == "manhattan":
        return np.abs(x[:, None] - x[None]).sum(-1)
    if metric == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ((x[:, None] - x[None]) ** 2).sum(-1)


def hot_points(n=500, dim=5, seed=0):
    """A third of the rows share one vector, a few more are paired copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[rng.random(n) < 0.33] = x[0]
    x[50:60] = x[40:50]
    return x, [f"p{i:04d}" for i in rng.permutation(n)]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_knn_matches_brute_force(spark, metric):
    x, ids = hot_points()
    d = distances(x, metric)
    place = np.argsort(np.argsort(ids))
    got = {(r["i"], r["rank"]): r["j"] for r in knn(frame(spark, x, ids), 7, metric=metric, block_rows=64).collect()}
    assert len(got) == 7 * len(x)
    for a in range(len(x)):
        order = np.lexsort((place, d[a]))
        order = order[order != a][:7]
        assert [got[(ids[a], r + 1)] for r in range(7)] == [ids[b] for b in order]


def test_knn_few_rows(spark):
    got = knn(frame(spark, np.array([[0.0], [1.0], [3.0]])), 10).collect()
    assert len(got) == 6
    same = knn(frame(spark, np.zeros((4, 2))), 2).collect()
    assert {(r["i"], r["j"]) for r in same if r["i"] == "p0000"} == {("p0000", "p0001"), ("p0000", "p0002")}


def test_knn_ties_on_a_lattice(spark):
    x = np.array([[i, j] for i in range(12) for j in range(12)], dtype=float)
    d = distances(x)
    got = {(r["i"], r["rank"]): r["j"] for r in knn(frame(spark, x), 6, block_rows=16).collect()}
    for a in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[a]))
        order = order[order != a][:6]
        assert [got[(f"p{a:04d}", r + 1)] for r in range(6)] == [f"p{b:04d}" for b in order]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_ranks_match_brute_force(spark, metric):
    x, ids = hot_points()
    low = frame(spark, x[:, :2], ids)
    pairs = knn(low, 6, block_rows=64).select("i", "j")
    d = distances(x, metric)
    at = {v: k for k, v in enumerate(ids)}
    rows = distance_ranks(pairs, frame(spark, x, ids), metric=metric, block_rows=64).collect()
    assert len(rows) == 6 * len(x)
    for r in rows:
        a, b = at[r["i"]], at[r["j"]]
        own = d[a].copy()
        own[a] = np.inf
        limit = d[a, b] - (1e-12 if metric == "cosine" else 0.0)
        assert 1 + (own < limit).sum() == r["rank_hi"]


def test_ranks_with_many_thresholds_for_one_vector(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([np.zeros((150, 3)), rng.normal(size=(150, 3))])
    low = rng.normal(size=(300, 2))
    pairs = knn(frame(spark, low), 8).select("i", "j")
    d = distances(x)
    for r in distance_ranks(pairs, frame(spark, x), block_rows=64).collect():
        a, b = int(r["i"][1:]), int(r["j"][1:])
        own = d[a].copy()
        own[a] = np.inf
        assert 1 + (own < d[a, b]).sum() == r["rank_hi"]


def brute_silhouette(x, labels):
    d = np.sqrt(distances(x))
    out = []
    for i in range(len(x)):
        same = labels == labels[i]
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_silhouette(spark):
    x, ids = hot_points(dim=2)
    labels = np.array(["abcd"[i % 4] for i in range(len(x))])
    labels[7] = "single"
    df = frame(spark, x, ids, label=[str(v) for v in labels])
    got = metrics.silhouette(df, vec_col="vec", block_rows=64).first()["silhouette"]
    assert abs(got - brute_silhouette(x, labels)) < 1e-9
    assert metrics.silhouette(df.withColumn("label", F.lit("one")), vec_col="vec").first()["silhouette"] is None
    both = df.withColumn("g", F.lit(0)).unionByName(
        df.filter("label in ('a', 'b')").withColumn("g", F.lit(1))
    ).unionByName(df.withColumn("g", F.lit(2)).withColumn("label", F.lit("one")))
    got = {r["g"]: r["silhouette"] for r in metrics.silhouette(both, vec_col="vec", by=["g"], block_rows=64).collect()}
    keep = np.isin(labels, ["a", "b"])
    assert abs(got[0] - brute_silhouette(x, labels)) < 1e-9
    assert abs(got[1] - brute_silhouette(x[keep], labels[keep])) < 1e-9
    assert got[2] is None


def test_trustworthiness_is_one_for_identity(spark):
    x = np.random.default_rng(1).normal(size=(60, 2))
    df = frame(spark, x).withColumn("low", F.col("vec"))
    assert metrics.trustworthiness(metrics.neighborhoods(df, 5), 60, [1, 5]).collect()[0]["trustworthiness"] == 1.0


def test_moments_pca_and_contrastive(spark):
    rng = np.random.default_rng(42)
    x, b = rng.normal(size=(50, 20)) @ rng.normal(size=(20, 20)), rng.normal(size=(15, 20))
    m = linalg.moments(frame(spark, x).repartition(7))
    assert m.n == 50 and np.allclose(m.mean, x.mean(0)) and np.allclose(m.covariance, np.cov(x.T))
    out, info = linalg.pca(frame(spark, x), 3)
    got = np.array([r["coords"] for r in out.orderBy("identifier").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = u[:, :3] * s[:3]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert np.allclose(info["explained_variance_ratio"], (s**2 / (s**2).sum())[:3])
    with pytest.raises(np.linalg.LinAlgError):
        linalg.contrastive_pca(frame(spark, x), frame(spark, b), 2, mu=0.0)
    for scale in (True, False):
        out, info = linalg.contrastive_pca(frame(spark, x), frame(spark, b), 2, mu=1e-3, standard_scale=scale)
        got = np.array([r["coords"] for r in out.orderBy("identifier").collect()])
        z = lambda a: (a - a.mean(0)) / (a.std(0, ddof=1) if scale else 1.0)
        st, sb = np.cov(z(x).T), np.cov(z(b).T) + 1e-3 * np.eye(20)
        w, v = np.linalg.eig(np.linalg.solve(sb, st))
        order = np.argsort(w.real)[::-1][:2]
        assert np.allclose(info["eigenvalue_ratios"], w.real[order])
        assert info["eigenvalue_ratios"][0] >= info["eigenvalue_ratios"][1] > 0
        for k in range(2):
            axis = v[:, order[k]].real
            axis = axis / np.sqrt(axis @ sb @ axis)
            axis = axis * np.sign(axis[np.abs(axis).argmax()])
            assert np.allclose(got[:, k], z(x) @ axis, atol=1e-6)
    with pytest.raises(ValueError):
        linalg.contrastive_pca(frame(spark, x), frame(spark, b[:, :5]), 2)
    with pytest.raises(Exception, match="dimension mismatch"):
        linalg.moments(frame(spark, x).unionByName(frame(spark, b[:, :5])))


def test_scaling_and_similarity(spark):
    x = np.random.default_rng(0).normal(size=(20, 3))
    x[:, 2] = 4.0
    got = np.array([r["scaled"] for r in linalg.scale_vectors(frame(spark, x)).orderBy("identifier").collect()])
    assert np.allclose(got[:, 2], 0) and np.allclose(got[:, 0].std(ddof=1), 1)
    edges = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.75), ("b", "b", 1.0)], "i string, j string, sim double")
    assert [r["distance"] for r in linalg.similarity_to_distance(edges).orderBy("i", "j").collect()] == [0.0, 0.5, 0.0]
    raw = edges.withColumn("sim", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("sim")))
    assert [r["distance"] for r in linalg.similarity_to_distance(raw).orderBy("i", "j").collect()] == [0.0, 0.75, 0.0]


def test_normalize_projection(spark):
    x = np.random.default_rng(5).normal(size=(40, 2)) @ np.array([[3.0, 1.0], [0.2, 0.5]]) + 7
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "identifier int, x double, y double")
    got = np.array([(r["nx"], r["ny"]) for r in linalg.normalize_projection(df).orderBy("identifier").collect()])
    c = x - x.mean(0)
    s = c / c.std()
    w, v = np.linalg.eigh(np.cov(s.T))
    v = v[:, ::-1]
    v[:, 0] *= np.sign(v[0, 0])
    v[:, 1] *= np.sign(v[1, 1])
    assert np.allclose(got, s @ v)


def test_backgrounds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 4))
    vecs = frame(spark, x)
    meta = spark.createDataFrame(
        [(f"p{i:04d}", "yes" if i % 2 else " No ", "MKTAYIAKQR", "1", "8") for i in range(12)],
        "identifier string, sp string, sequence string, s string, e string",
    )
    rows, details = backgrounds.annotation_background(vecs, meta, ReducerParams(background_annotation="sp"))
    assert rows.count() == 6 and details["selector"]["rule"] == "truthy_non_missing"
    rows, _ = backgrounds.annotation_background(vecs, meta, ReducerParams(background_annotation="sp", background_values=("NO",)))
    assert sorted(r[0] for r in rows.select("identifier").collect()) == [f"p{i:04d}" for i in range(0, 12, 2)]
    with pytest.raises(ValueError, match="not found"):
        backgrounds.annotation_background(vecs, meta, ReducerParams(background_annotation="gone"))
    with pytest.raises(ValueError, match="at least 2"):
        backgrounds.annotation_background(vecs, meta, ReducerParams(background_annotation="sp", background_values=("x",)))
    from atlasmill.operators.embed import composition

    p = ReducerParams(derived_start_column="s", derived_end_column="e", background_annotation="sp")
    rows, details = backgrounds.derived_background(vecs, meta, p, composition(4))
    assert rows.count() == 6 and details["n_derived_segments"] == 6
    fasta = spark.createDataFrame([("p0001", "MK")], "identifier string, sequence string")
    seg = {r["identifier"]: r["reason"] for r in backgrounds.derived_segments(vecs, meta, p, fasta).collect()}
    assert seg["p0001"] == "short" and seg["p0003"] == "ok"
    with pytest.raises(ValueError, match="derived mode needs"):
        backgrounds.derived_segments(vecs, meta, ReducerParams())
    mature = frame(spark, x[:5] - 1.0)
    rows, details = backgrounds.paired_background(vecs, None, ReducerParams(paired_delta_scale=0.5), vecs, mature)
    got = np.array([r["vec"] for r in rows.collect()])
    assert got.shape == (10, 4) and np.allclose(np.abs(got), 0.5) and np.allclose(got.sum(0), 0)
    assert details["missing_mature"] == 7
    with pytest.raises(ValueError, match="pair"):
        backgrounds.paired_background(vecs, None, ReducerParams(), vecs, mature.limit(1))


def clusters(n=150, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim)) * 4
    label = rng.integers(0, 5, n)
    return centers[label] + rng.normal(size=(n, dim)), label


@pytest.mark.parametrize(
    "name, dims, options",
    [
        ("pacmap", 2, {"iterations": 30}), ("localmap", 2, {"iterations": 30}), ("umap", 2, {"iterations": 20}),
        ("mds", 3, {"iterations": 5}),
    ],
)
def test_layout_contract(spark, name, dims, options):
    x, label = clusters()
    x[:40] = x[0]
    label[:40] = label[0]
    df = frame(spark, x, label=[int(v) for v in label])
    coords, info = getattr(layout, name)(df, dims, **options)
    got = {r["identifier"]: r["coords"] for r in coords.collect()}
    y = np.array([got[f"p{i:04d}"] for i in range(len(x))])
    assert y.shape == (150, dims) and np.isfinite(y).all() and info["n_components"] == dims
    d = distances(y)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert (label[near] == label[:, None]).mean() > 0.85


def dense_tsne(x, iterations, perplexity, rate, neighbors):
    """Plain t-SNE on full matrices, same neighbour truncation and start."""
    n = len(x)
    d = distances(x)
    p = np.zeros((n, n))
    for i in range(n):
        idx = np.lexsort((np.arange(n), d[i]))
        idx = idx[idx != i][:neighbors]
        gap, lo, hi, beta = d[i][idx] - d[i][idx].min(), 0.0, np.inf, 1.0
        for _ in range(200):
            w = np.exp(-gap * beta)
            w /= w.sum()
            if -(w * np.log(w + 1e-300)).sum() > np.log(perplexity):
                lo, beta = beta, beta * 2 if hi == np.inf else (beta + hi) / 2
            else:
                hi, beta = beta, (beta + lo) / 2
        p[i, idx] = w
    p = (p + p.T) / (2 * n)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = u[:, :2] * s[:2] * np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(axis=1)])
    y = y / y[:, 0].std() * 1e-4
    m, gain = np.zeros_like(y), np.ones_like(y)
    for step in range(iterations):
        ex, momentum = (12.0, 0.5) if step < iterations // 4 else (1.0, 0.8)
        q = 1 / (1 + distances(y))
        np.fill_diagonal(q, 0.0)
        grad = 4 * (((ex * p - q / q.sum()) * q)[:, :, None] * (y[:, None] - y[None])).sum(1)
        gain = np.maximum(np.where(grad * m > 0, gain * 0.8, gain + 0.2), 0.01)
        m = momentum * m - rate * gain * grad
        y = y + m
    return y


def test_tsne_follows_the_dense_gradient(spark):
    x, _ = clusters(90)
    coords, info = layout.tsne(frame(spark, x), 2, ReducerParams(learning_rate=50.0, perplexity=10.0), iterations=12, accuracy=(0.004, 0.0))
    got = np.array([r["coords"] for r in coords.orderBy("identifier").collect()])
    want = dense_tsne(x, 12, 10.0, 50.0, 31)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6 * np.abs(want).max()) and info["perplexity"] == 10.0


def test_layout_is_deterministic(spark):
    x, _ = clusters(60)
    run = lambda: sorted((r["identifier"], *np.round(r["coords"], 6)) for r in layout.pacmap(frame(spark, x), 2, iterations=4)[0].collect())
    assert run() == run()


def test_mds_recovers_a_plane(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(40, 2))
    coords, info = layout.mds(frame(spark, np.hstack([y, np.zeros((40, 3))])), 2)
    got = np.array([r["coords"] for r in coords.orderBy("identifier").collect()])
    assert np.allclose(distances(got), distances(y), atol=1e-6) and info["stress"] < 1e-8


def test_mds_from_edges(spark):
    ids = spark.createDataFrame([(c,) for c in "abcd"], "identifier string")
    edges = spark.createDataFrame([("a", "b", 0.1), ("c", "d", 0.1)], "i string, j string, distance double")
    coords, info = layout.mds_from_edges(ids, edges, 2, iterations=40, missing=1.0)
    p = {r["identifier"]: np.array(r["coords"]) for r in coords.collect()}
    gap = lambda a, b: np.linalg.norm(p[a] - p[b])
    assert gap("a", "b") < 0.4 < gap("a", "c") and np.isfinite(info["stress"])


def test_umap_curve():
    a, b = layout.curve_parameters(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02


def test_label_metrics(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "identifier int, label string")
    got = {r["identifier"]: r["label"] for r in metrics.min_class_labels(df, "label", 2).collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: None}
    assert metrics.min_class_labels(df, "label", 2, drop_rows=True).count() == 2
    assert tuple(metrics.label_summary(df).first()) == (4, 3, 2)
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, predicted string")
    assert abs(metrics.macro_f1_from_pairs(pairs).first()[0] - 2 / 3) < 1e-12


def test_bootstrap_size_is_exact(spark):
    df = spark.range(997).select(F.col("id").alias("identifier"))
    sizes = {r["round"]: r["count"] for r in metrics.bootstrap_samples(df, "identifier", 3).groupBy("round").count().collect()}
    assert sizes == {0: 797, 1: 797, 2: 797}


def test_benchmark_methods(spark, tmp_path):
    x, label = clusters(80)
    df = frame(spark, x, label=[int(v) for v in label])
    measures = {"trust": benchmark.trust_metric(5), "sil": benchmark.silhouette_metric(), "acc": benchmark.accuracy_metric(5), "bad": lambda rows: 1 / 0}
    results, rows = benchmark.benchmark_methods(df, ["pca", "nope"], measures=measures)
    got = {(r["method"], r["metric"]): r["value"] for r in rows.collect()}
    assert got[("pca", "trust")] > 0.7 and got[("pca", "acc")] > 0.5 and got[("pca", "bad")] is None and ("nope", "error") in got
    from atlasmill.sources import bundle

    benchmark.write_benchmark(results, rows, df.select("identifier", "label"), str(tmp_path))
    ann, info, data, _ = bundle.read_tables(spark, str(tmp_path))
    assert data.count() == 80 and info.first()["projection_name"] == "pca" and ann.columns == ["protein_id", "label"]
    assert spark.read.csv(f"{tmp_path}/metrics.csv", header=True).count() == rows.count()
    sweep = benchmark.contrastive_sweep(df, frame(spark, np.random.default_rng(0).normal(size=(50, 12))), [1e-3, 1e-1], [True])
    assert sweep.count() == 2


def test_groups_stay_apart_and_cheap(spark, monkeypatch):
    """Wide vectors in many groups: brute-force lists, small blocks, and few pairs measured twice."""
    rng = np.random.default_rng(11)
    vecs = rng.normal(size=(1200, 256))
    vecs[5] = vecs[17]  # one vector in one group twice, and in another group
    vecs[6] = vecs[17]
    group = np.arange(1200) % 12
    rows = spark.createDataFrame(
        [(int(i), f"g{group[i]:02d}", vecs[i].tolist()) for i in range(1200)], "identifier bigint, part string, vec array<double>"
    )
    near = neighbors.knn(rows, 4, group_col="part").collect()
    got = {}
    for r in sorted(near, key=lambda r: (r["i"], r["rank"])):
        got.setdefault(r["i"], []).append(r["j"])
    for i in (0, 5, 6, 17, 700, 1199):
        others = [j for j in range(1200) if group[j] == group[i] and j != i]
        d = ((vecs[others] - vecs[i]) ** 2).sum(axis=1)
        assert got[i] == [others[x] for x in np.lexsort((others, d))[:4]]
    assert len(near) == 1200 * 4
    pairs = spark.createDataFrame([(0, 12), (0, 600), (17, 5)], "i bigint, j bigint")
    for r in neighbors.distance_ranks(pairs, rows, group_col="part").collect():
        others = [j for j in range(1200) if group[j] == group[r["i"]] and j != r["i"]]
        d = ((vecs[others] - vecs[r["i"]]) ** 2).sum(axis=1)
        assert r["rank_hi"] == 1 + (d < ((vecs[r["j"]] - vecs[r["i"]]) ** 2).sum()).sum()

    measured = []
    state = neighbors._TopK(4, "euclidean")
    real = kernels.exact_pairs
    monkeypatch.setattr(kernels, "exact_pairs", lambda a, r, b, c, m: measured.append(len(r)) or real(a, r, b, c, m))
    mine = np.flatnonzero(group == 3)
    table = pa.table({"gid": pa.array(mine), "vec": pa.array(vecs[mine].tolist(), pa.list_(pa.float64()))})
    state.start(table)
    state.step(table.to_batches()[0])
    assert sum(measured) < 0.1 * len(mine) ** 2


def test_block_sizes_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(blocked, "MAX_PIVOTS", 2)
    rng = np.random.default_rng(3)
    rows = frame(spark, rng.normal(size=(3000, 3))).select(F.substring("identifier", 2, 9).cast("bigint").alias("gid"), F.lit(1).cast("bigint").alias("w"), "vec")
    blocks = blocked.assign_blocks(rows, block_rows=100)
    sizes = [r["count"] for r in blocks.points.groupBy("block").count().collect()]
    assert len(blocks.ids) == 2 and sum(sizes) == 3000 and max(sizes) <= 400
    assert max(r["block"] for r in blocks.points.select("block").distinct().collect()) < blocks.n_blocks


def test_pca_by_group_is_pca_of_each_group(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(301, 6)) * [5, 3, 2, 1, 1, 1]
    part = ["a" if i % 3 else "b" for i in range(300)] + ["one"]
    rows = frame(spark, x, part=part)
    got = {r["identifier"]: r["coords"] for r in linalg.pca_by_group(rows, "part", 2, part_rows=40).collect()}
    assert len(got) == 301 and got["p0300"] is None
    for name in ("a", "b"):
        at = [i for i in range(300) if part[i] == name]
        alone = linalg.pca(rows.filter(F.col("part") == name), 2)[0].collect()
        assert len(alone) == len(at)
        for r in alone:
            np.testing.assert_allclose(got[r["identifier"]], r["coords"], atol=1e-9)


def test_distance_tiles_are_small_and_screens_bound_their_error():
    from atlasmill.operators import distances as kernel
    from atlasmill.operators import neighbors

    for cols in (100, 10_000):
        tile = next(iter(kernel.tiles(100_000, cols)))
        assert (tile.stop - tile.start) * cols <= 1 << 20
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 64)), rng.normal(size=(2500, 64)) * 100
    whole = np.abs(a[:, None] - b[None]).sum(axis=2)
    rough, slack = kernel.screen(a, b, "manhattan", True)
    assert rough.dtype == np.float32 and np.abs(rough - whole).max() <= slack < 1.0
    assert np.abs(kernel.screen(a, b, "manhattan")[0] - whole).max() < 1e-9
    assert np.allclose(kernel.planar(a[:, :2], b[:, :2]), np.sqrt(((a[:, None, :2] - b[None, :, :2]) ** 2).sum(axis=2)))
    # one pass for 50 thresholds, by a sort of the row or by comparisons
    values = rng.integers(0, 30, (40, 500)).astype(float)
    low, high = np.sort(values[:, :50], axis=1) - 0.25, np.sort(values[:, :50], axis=1) + 0.25
    for width in (3, 50):
        below, upto = neighbors._CountCloser._places(values, low[:, :width], high[:, :width])
        assert np.array_equal(below, (values[:, None] < low[:, :width, None]).sum(axis=2))
        assert np.array_equal(upto, (values[:, None] <= high[:, :width, None]).sum(axis=2))
    assert neighbors.THRESHOLDS_PER_ROW >= 50
