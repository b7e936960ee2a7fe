"""Linear algebra from sufficient statistics.

A data set of any length is reduced to (n, mean, scatter) by one pass of
per-partition partial statistics merged pairwise in one or two fan-in stages, so
that no task receives more than about the square root of all summaries. Only that
D x D summary (D is checked) reaches the driver, where the small eigenproblem
is solved; the rows themselves stay distributed. Beyond ``MAX_DIM`` dimensions
principal components are found without that matrix, by passes that multiply it with
a few vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow
from .arrays import list_column, matrix, vector
from .ordering import one_row

MAX_DIM = 4096
FAN_IN_BYTES = 256 << 20
#: Components by passes: extra vectors of a block, passes at most, residual (share of the largest eigenvalue) that ends them.
EXTRA, PASSES, RESIDUAL = 8, 40, 1e-7


@dataclass(frozen=True)
class Moments:
    """n rows, their mean and centred scatter matrix."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        if self.n < 2:
            raise ValueError(f"need at least 2 rows for a covariance, got {self.n}")
        cov = self.scatter / (self.n - 1)
        return 0.5 * (cov + cov.T)

    @property
    def std(self) -> np.ndarray:
        """Sample standard deviation; constant columns count as 1."""
        std = np.sqrt(np.maximum(np.diag(self.covariance), 0.0))
        return np.where(std < 1e-12, 1.0, std)

    @property
    def correlation(self) -> np.ndarray:
        """Covariance of the columns after scaling each to unit variance."""
        return self.covariance / np.outer(self.std, self.std)


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray] | None:
    total = None
    for n, mean, scatter in parts:
        if total is None:
            total = (n, mean, scatter)
            continue
        n0, m0, s0 = total
        delta = mean - m0
        joint = n0 + n
        total = (joint, m0 + delta * (n / joint), s0 + scatter + np.outer(delta, delta) * (n0 * n / joint))
    return total


def _emit(part) -> Iterator[pa.RecordBatch]:
    if part is not None:
        n, mean, scatter = part
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), list_column(mean[None, :]), list_column(scatter.reshape(1, -1))],
            names=["n", "mean", "scatter"],
        )


def fan_widths(df: DataFrame, most: int) -> list[int]:
    """Widths of the fan-in stages behind one summary per task of ``df``: the last has ``most`` tasks at most.

    The number of tasks is estimated from the sizes of the tables that are read; one of unknown size counts as the cluster's width.
    """
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    leaves, tasks = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        tasks += size // split + 1 if size < 1 << 60 else spark.sparkContext.defaultParallelism
    first = min(4096, math.isqrt(tasks) + 1)
    return [first] if first <= most else [first, max(1, min(most, math.isqrt(first)))]


def moments(df: DataFrame, vec_col: str = "vec") -> Moments:
    """Count, mean and scatter matrix of a vector column."""
    head = df.select(F.size(vec_col).alias("dim")).first()
    if head is None:
        raise ValueError("no vectors")
    dim = int(head["dim"])
    if dim > MAX_DIM:
        raise ValueError(f"vectors of length {dim} exceed the supported {MAX_DIM}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0), dim)
            if len(x):
                mean = x.mean(axis=0)
                c = x - mean
                part = (len(x), mean, c.T @ c)
                total = part if total is None else _merge([total, part])
        yield from _emit(total)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            n = vector(batch.column("n"), np.int64)
            mean, scatter = matrix(batch.column("mean")), matrix(batch.column("scatter"))
            for i in range(len(n)):
                part = (int(n[i]), mean[i], scatter[i].reshape(dim, dim))
                total = part if total is None else _merge([total, part])
        yield from _emit(total)

    schema = "n bigint, mean array<double>, scatter array<double>"
    fan_in = max(1, min(64, FAN_IN_BYTES // (8 * dim * dim)))
    parts = map_arrow(df.select(F.col(vec_col).cast("array<double>").alias("vec")), partial, schema)
    for width in fan_widths(df, fan_in):
        parts = map_arrow(parts.repartition(width), combine, schema)
    rows = parts.collect()  # at most fan_in summaries of bounded size
    n, mean, scatter = _merge(
        [(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(dim, dim)) for r in sorted(rows)]
    )
    return Moments(n, mean, scatter)


def column_stats(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Mean and sample standard deviation of each vector position."""
    long = df.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "v"))
    return long.groupBy("pos").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )


def covariance_cells(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Sample covariance as cells (a, b, cov)."""
    cov = moments(df, vec_col).covariance
    a, b = np.indices(cov.shape)
    table = pa.table({"a": pa.array(a.ravel(), pa.int32()), "b": pa.array(b.ravel(), pa.int32()), "cov": cov.ravel()})
    return df.sparkSession.createDataFrame(table)


def project(df: DataFrame, shift: np.ndarray, axes: np.ndarray, vec_col: str = "vec", out: str = "coords") -> DataFrame:
    """Replace the vector by ``(vec - shift) @ axes`` in Arrow batches."""
    keep = [f for f in df.schema.fields if f.name not in (vec_col, out)]
    names = [f.name for f in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{out} array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords = (matrix(batch.column(vec_col), len(shift)) - shift) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [list_column(coords)], names=[*names, out]
            )

    return map_arrow(df.select(*names, F.col(vec_col).cast("array<double>").alias(vec_col)), run, schema)


def fix_signs(axes: np.ndarray) -> np.ndarray:
    """The entry of largest magnitude of every axis is made positive."""
    top = np.abs(axes).argmax(axis=0)
    signs = np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return axes * signs


def pca(df: DataFrame, k: int = 2, vec_col: str = "vec") -> tuple[DataFrame, dict]:
    """Principal component scores (column ``coords``) and the fit's parameters."""
    head = df.select(F.size(vec_col).alias("dim")).first()
    if head is not None and head["dim"] > MAX_DIM:
        return _pca_by_passes(df, k, vec_col, int(head["dim"]))
    m = moments(df, vec_col)
    dim = len(m.mean)
    if k > min(m.n, dim):
        raise ValueError(f"n_components={k} exceeds min(rows, features)={min(m.n, dim)}")
    values, vectors = np.linalg.eigh(m.covariance)
    order = np.argsort(values)[::-1]
    values = np.maximum(values[order], 0.0)
    axes = fix_signs(vectors[:, order[:k]])
    total = values.sum()
    info = {
        "n_components": k,
        "svd_solver": "full",
        "explained_variance_ratio": (values[:k] / total if total > 0 else values[:k] * 0.0).tolist(),
    }
    return project(df, m.mean, axes, vec_col), info


def _summed(df: DataFrame, vec_col: str, shape: tuple[int, ...], of) -> np.ndarray:
    """Sum over all rows of ``of(x)``, an array of that shape for a block of rows ``x``."""
    size = int(np.prod(shape))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                total += of(matrix(batch.slice(at, 256).column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = map_arrow(df.select(F.col(vec_col).cast("array<double>").alias("vec")), partial, "total binary")
    for width in fan_widths(df, max(1, min(64, FAN_IN_BYTES // (8 * size)))):
        parts = map_arrow(parts.repartition(width), combine, "total binary")
    return np.sum([np.frombuffer(r["total"]) for r in parts.collect()], axis=0).reshape(shape)


def _pca_by_passes(df: DataFrame, k: int, vec_col: str, dim: int) -> tuple[DataFrame, dict]:
    """Principal components of long vectors: block Lanczos steps on the covariance, which is never formed.

    A pass multiplies the centred rows with a block of vectors and back (D x block numbers a task); Ritz vectors over all blocks so far
    stand when their residuals are below ``RESIDUAL`` of the largest eigenvalue.
    """
    n = df.count()
    if k > min(n, dim):
        raise ValueError(f"n_components={k} exceeds min(rows, features)={min(n, dim)}")
    if n < 2:
        raise ValueError(f"need at least 2 rows for a covariance, got {n}")
    facts = _summed(df, vec_col, (2, dim), lambda x: np.stack((x.sum(axis=0), (x * x).sum(axis=0))))
    mean = facts[0] / n
    total = float(np.maximum(facts[1] - n * mean * mean, 0.0).sum() / (n - 1))
    block = min(k + EXTRA, n, dim)
    step = np.linalg.qr(np.random.Generator(np.random.PCG64(0)).standard_normal((dim, block)))[0]
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for passes in range(1, PASSES + 1):
        shared = df.sparkSession.sparkContext.broadcast((mean, step))  # D x block numbers

        def product(x: np.ndarray, shared=shared) -> np.ndarray:
            center, v = shared.value
            rows = x - center
            return rows.T @ (rows @ v)

        out = _summed(df, vec_col, step.shape, product) / (n - 1)
        shared.unpersist()
        basis, image = np.hstack((basis, step)), np.hstack((image, out))
        inner = basis.T @ image
        values, ritz = np.linalg.eigh(0.5 * (inner + inner.T))
        top = np.argsort(values)[::-1][:k]
        values, vectors = np.maximum(values[top], 0.0), basis @ ritz[:, top]
        residual = np.linalg.norm(image @ ritz[:, top] - vectors * values, axis=0).max() / max(values[0], 1e-300)
        if residual <= RESIDUAL or basis.shape[1] >= min(n, dim):
            break
        for _ in range(2):  # twice is enough against rounding
            out = out - basis @ (basis.T @ out)
        step, size = np.linalg.qr(out)
        step = step[:, np.abs(np.diag(size)) > 1e-12 * max(values[0], 1e-300)]
        if not step.shape[1]:
            break
    info = {
        "n_components": k, "svd_solver": "lanczos", "passes": passes, "residual": float(residual),
        "explained_variance_ratio": (values / total if total > 0 else values * 0.0).tolist(),
    }
    return project(df, mean, fix_signs(vectors), vec_col), info


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Stretches of a sorted batch in which the columns don't change."""
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        v = batch.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    cuts = np.flatnonzero(new).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def pca_by_group(df: DataFrame, by: str, k: int = 2, vec_col: str = "vec", out: str = "coords", part_rows: int = 1 << 17) -> DataFrame:
    """Adds principal component scores of every group, each fitted on the group's own rows.

    All groups share one scan: rows are sorted by group, so a task holds one
    summary (D x D) at a time; groups larger than ``part_rows`` are summed in
    parts. Groups with fewer rows than components get NULL scores.
    """

    def principal(m: Moments) -> np.ndarray | None:
        if m.n < max(2, k):
            return None
        values, vectors = np.linalg.eigh(m.covariance)
        return fix_signs(vectors[:, np.argsort(values)[::-1][:k]])

    return _fitted_by_group(df, by, k, lambda: principal, vec_col, out, part_rows)


def contrastive_pca_by_group(
    df: DataFrame, by: str, background: Moments, k: int = 2, vec_col: str = "vec", mu: float = 1e-3, standard_scale: bool = True,
    out: str = "coords", part_rows: int = 1 << 17,
) -> DataFrame:
    """Adds scores of :func:`contrastive_pca` for every group, each against the same background; all groups share one scan.

    Groups of fewer than two rows get NULL scores.
    """
    shared = df.sparkSession.sparkContext.broadcast(background)  # D x D, D is checked

    def fitted():
        other = shared.value

        def fit(m: Moments) -> np.ndarray | None:
            if m.n < 2:
                return None
            if standard_scale:
                return contrastive_axes(m.correlation, other.correlation, k, mu)[1] / m.std[:, None]
            return contrastive_axes(m.covariance, other.covariance, k, mu)[1]

        return fit

    return _fitted_by_group(df, by, k, fitted, vec_col, out, part_rows)


def _fitted_by_group(df: DataFrame, by: str, k: int, fitted, vec_col: str, out: str, part_rows: int) -> DataFrame:
    """Scores of every group on the axes that ``fitted()`` finds from its moments."""
    head = df.select(F.size(vec_col).alias("dim")).first()
    dim = int(head["dim"]) if head else 0
    if dim > MAX_DIM:
        raise ValueError(f"vectors of length {dim} exceed the supported {MAX_DIM}")
    parts = df.groupBy(by).agg(F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("_parts"))
    parts = cut_lineage(parts)
    group = f"{by} {df.schema[by].dataType.simpleString()}"
    salted = df.join(parts, by).withColumn("_part", F.pmod(F.xxhash64(vec_col), F.col("_parts")).cast("int")).drop("_parts")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, name = None, None, None

        def close():
            n, mean, scatter = total
            return pa.RecordBatch.from_arrays(
                [name, pa.array([n], pa.int64()), list_column(mean[None, :]), list_column(scatter.reshape(1, -1))],
                names=[by, "n", "mean", "scatter"],
            )

        for batch in batches:
            for run in _runs(batch, [by, "_part"]):
                x = matrix(run.column("vec"), dim)
                mean = x.mean(axis=0)
                part = (len(x), mean, (x - mean).T @ (x - mean))
                at = (run.column(by)[0].as_py(), run.column("_part")[0].as_py())
                if at != key and total is not None:
                    yield close()
                    total = None
                key, name = at, run.column(by).slice(0, 1)
                total = part if total is None else _merge([total, part])
        if total is not None:
            yield close()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, name, fit = None, None, None, fitted()

        def close():
            m = Moments(*total)
            found = fit(m)
            axes = np.full((k, dim), np.nan) if found is None else found.T
            return pa.RecordBatch.from_arrays([name, list_column(np.vstack((m.mean, axes)).reshape(1, -1))], names=[by, "fit"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                at = row.column(by)[0].as_py()
                part = (row.column("n")[0].as_py(), matrix(row.column("mean"))[0], matrix(row.column("scatter"))[0].reshape(dim, dim))
                if at != key and total is not None:
                    yield close()
                    total = None
                key, name = at, row.column(by)
                total = part if total is None else _merge([total, part])
        if total is not None:
            yield close()

    slim = salted.select(by, "_part", F.col(vec_col).cast("array<double>").alias("vec")).repartition(by, "_part").sortWithinPartitions(by, "_part")
    sums = map_arrow(slim, partial, f"{group}, n bigint, mean array<double>, scatter array<double>")
    fits = map_arrow(sums.repartition(by).sortWithinPartitions(by), solve, f"{group}, fit array<double>")
    fits = cut_lineage(fits).join(parts, by).select(by, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "fit")
    names = df.columns
    stream = fits.withColumn("_role", F.lit(0)).unionByName(salted.withColumn("_role", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition(by, "_part").sortWithinPartitions(by, "_part", "_role")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = None
        for batch in batches:
            for run in _runs(batch, [by, "_part", "_role"]):
                if run.column("_role")[0].as_py() == 0:
                    fit = matrix(run.column("fit"))[0].reshape(k + 1, dim)
                    continue
                scores = (matrix(run.column(vec_col), dim) - fit[0]) @ fit[1:].T
                column = list_column(scores) if np.isfinite(fit).all() else pa.nulls(len(scores), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[run.column(c) for c in names], column], names=[*names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(stream.select(*names, "_part", "_role", "fit"), place, f"{kinds}, {out} array<double>")


def contrastive_axes(target: np.ndarray, background: np.ndarray, k: int, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """Top generalized eigenpairs of ``target v = lambda (background + mu I) v``."""
    shifted = background + mu * np.eye(len(background)) if mu > 0 else background
    try:
        lower = np.linalg.cholesky(shifted)
    except np.linalg.LinAlgError as err:
        raise np.linalg.LinAlgError(
            f"background covariance is not positive definite with regularization_mu={mu}; increase it"
        ) from err
    inner = np.linalg.solve(lower, np.linalg.solve(lower, target).T)
    values, vectors = np.linalg.eigh(0.5 * (inner + inner.T))
    valid = np.isfinite(values) & (values > -1e-12)
    values, vectors = np.maximum(values[valid], 0.0), vectors[:, valid]
    if len(values) < k:
        raise ValueError(f"only {len(values)} usable eigenvalues for n_components={k}; increase regularization_mu")
    order = np.argsort(values)[::-1][:k]
    axes = np.linalg.solve(lower.T, vectors[:, order])
    return values[order], fix_signs(axes)


def contrastive_pca(
    df: DataFrame,
    background: DataFrame,
    k: int = 2,
    vec_col: str = "vec",
    background_col: str = "vec",
    mu: float = 1e-3,
    standard_scale: bool = True,
    target: DataFrame | None = None,
    statistics: tuple[Moments, Moments] | None = None,
) -> tuple[DataFrame, dict]:
    """Axes with much variance in the target and little in the background.

    Each set is scaled by its own statistics for the eigenproblem; every row of
    ``df`` is then projected in the target's frame. ``statistics`` are the moments of
    target and background where they are at hand, so that several fits scan them once.
    """
    t, b = statistics or (moments(df if target is None else target, vec_col), moments(background, background_col))
    if len(t.mean) != len(b.mean):
        raise ValueError(f"background has {len(b.mean)} features but input has {len(t.mean)}")
    if k > len(t.mean):
        raise ValueError(f"n_components={k} > n_features={len(t.mean)}")
    if min(t.n, b.n) < 2:
        raise ValueError(f"need at least 2 target and 2 background rows, got {t.n} and {b.n}")
    if standard_scale:
        values, axes = contrastive_axes(t.correlation, b.correlation, k, mu)
        rows = axes / t.std[:, None]
    else:
        values, axes = contrastive_axes(t.covariance, b.covariance, k, mu)
        rows = axes
    info = {
        "n_components": k,
        "regularization_mu": mu,
        "standard_scale": standard_scale,
        "eigenvalue_ratios": values.tolist(),
        "n_background_samples": b.n,
        "n_target": t.n,
    }
    return project(df, t.mean, rows, vec_col), info


def paired_delta(full: DataFrame, mature: DataFrame, scale: float = 0.5, id_col: str = "identifier", vec_col: str = "vec") -> DataFrame:
    """Background rows ``+-scale * (full - mature)`` for ids present in both sets."""
    if scale <= 0:
        raise ValueError("paired delta scale must be > 0")
    a = full.select(id_col, F.col(vec_col).cast("array<double>").alias("va"))
    b = mature.select(id_col, F.col(vec_col).cast("array<double>").alias("vb"))
    both = a.join(b, id_col)
    signs = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sign")
    return both.select(id_col, "va", "vb", signs).select(
        id_col,
        F.when(F.col("sign") > 0, "pos").otherwise("neg").alias("part"),
        F.zip_with("va", "vb", lambda x, y: F.col("sign") * F.lit(scale) * (x - y)).alias(vec_col),
    )


def pairing_report(ids: DataFrame, full: DataFrame, mature: DataFrame, id_col: str = "identifier") -> DataFrame:
    """How many requested ids can be paired and which side is missing."""
    f = full.select(id_col).distinct().withColumn("_f", F.lit(True))
    m = mature.select(id_col).distinct().withColumn("_m", F.lit(True))
    joined = ids.select(id_col).join(f, id_col, "left").join(m, id_col, "left")
    return joined.agg(
        F.count_if(F.col("_f").isNotNull() & F.col("_m").isNotNull()).alias("n_pairs"),
        F.count_if(F.col("_f").isNull()).alias("missing_full"),
        F.count_if(F.col("_m").isNull()).alias("missing_mature"),
    )


def similarity_to_distance(edges: DataFrame, sim_col: str = "sim") -> DataFrame:
    """``sqrt(max - sim)`` over an edge list ``(i, j, sim)`` when its diagonal is 1.

    When the stored diagonal is not (about) 1 the values already are distances.
    """
    facts = edges.agg(
        F.max(sim_col).alias("_top"),
        F.count_if((F.col("i") == F.col("j")) & (F.abs(F.col(sim_col) - 1.0) > 1e-8 + 1e-5)).alias("_off"),
    )
    fact = one_row(facts)
    value = F.when(fact["_off"] == 0, F.sqrt(fact["_top"] - F.col(sim_col))).otherwise(F.col(sim_col))
    return edges.withColumn("distance", value)


def scale_vectors(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Each vector position centred and scaled by its own sample statistics."""
    m = moments(df, vec_col)
    return project(df, m.mean, np.diag(1.0 / m.std), vec_col, "scaled")


def with_xyz(df: DataFrame, dims: int, coords: str = "coords", dtype: str = "float") -> DataFrame:
    """Split the coordinate list into x, y, z (z NULL in 2-D)."""
    z: Column = F.col(coords)[2].cast(dtype) if dims == 3 else F.lit(None).cast(dtype)
    return df.withColumns({"x": F.col(coords)[0].cast(dtype), "y": F.col(coords)[1].cast(dtype), "z": z}).drop(coords)


def normalize_projection(df: DataFrame) -> DataFrame:
    """Centre, scale by the pooled deviation, rotate x/y to principal axes.

    The first axis points to positive x and the second to positive y.
    """
    s = df.agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"),
    )
    sd = F.sqrt((F.col("vx") + F.col("vy")) / 2.0)
    s = s.withColumn("sd", F.when(sd > 1e-10, sd).otherwise(F.lit(1.0)))
    # unit eigenvector of the larger eigenvalue by its half angle; the second is its normal
    angle = F.atan2(2.0 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2.0
    s = s.withColumns({"c": F.cos(angle), "s": F.sin(angle)})
    s = s.withColumns({
        "c1": F.when(F.col("c") < 0, -F.col("c")).otherwise(F.col("c")),
        "s1": F.when(F.col("c") < 0, -F.col("s")).otherwise(F.col("s")),
    })
    # second axis (-s, c), flipped so that its y component is not negative
    s = s.withColumns({
        "s2": F.when(F.col("c") < 0, F.col("s")).otherwise(-F.col("s")),
        "c2": F.when(F.col("c") < 0, -F.col("c")).otherwise(F.col("c")),
    })
    fact = one_row(s)
    px = (F.col("x") - fact["mx"]) / fact["sd"]
    py = (F.col("y") - fact["my"]) / fact["sd"]
    return df.withColumns({"nx": px * fact["c1"] + py * fact["s1"], "ny": px * fact["s2"] + py * fact["c2"]})
