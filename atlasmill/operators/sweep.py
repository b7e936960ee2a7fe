"""Block sweep: compare every point with all others without emitting pairs.

Points are cut into blocks of bounded size. Each task owns one block of
*receivers*, keeps it as a matrix, and streams past it the rows of the other
blocks it has to visit; only the folded result (a top-k list, counts, sums)
leaves the task. Blocks are parts of Voronoi cells of sampled pivots, so the
triangle inequality tells which cells need not meet; a crowded cell is cut into
several blocks by hash, whatever the number of cells. Points may belong to
groups (column ``grp``): a cell holds points of one group, and only cells of one
group meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow
from . import distances
from .arrays import list_column, matrix

MAX_PIVOTS = 2048
MAX_CELLS = 4096  # of all groups together, if there are fewer groups
MAX_TASKS = 4096
PIVOT_BYTES = 32 << 20


@dataclass(frozen=True)
class Blocks:
    """Blocked points plus the summary per cell kept on the driver (bounded by the cells)."""

    points: DataFrame  # gid BIGINT, w BIGINT, vec ARRAY<DOUBLE>, ..., grp, cell INT, block INT
    rows: int
    dim: int
    metric: str
    n_blocks: int
    ids: np.ndarray  # cells, 0..n-1
    group: np.ndarray  # number of the cell's group
    first: np.ndarray  # first block of the cell
    chunks: np.ndarray  # blocks of the cell
    centers: np.ndarray
    radius: np.ndarray
    weight: np.ndarray
    count: np.ndarray


def _target(points: DataFrame, rows: int, block_rows: int) -> int:
    width = max(points.sparkSession.sparkContext.defaultParallelism, 1)
    return min(block_rows, max(64, math.ceil(rows / (2 * width))))


def assign_blocks(points: DataFrame, metric: str = "euclidean", block_rows: int = 4096) -> Blocks:
    """Cut ``points(gid, w, vec[, grp], ...)`` into blocks of about ``block_rows`` rows.

    The number of cells is bounded, the number of blocks grows with the input.
    ``vec`` is replaced by its metric space form (unit vectors for cosine).
    """
    spark = points.sparkSession
    if "grp" not in points.columns:
        points = points.withColumn("grp", F.lit(0))
    n = points.count()
    groups = max(1, points.select("grp").distinct().count())
    head = points.select(F.size("vec").alias("dim")).first()
    dim = int(head["dim"]) if head else 0
    limit = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * max(dim, 1)), MAX_CELLS // groups))
    target = _target(points, n, block_rows)
    want = max(1, min(limit, math.ceil(n / groups / target)))
    sample = (
        points.select("gid", "vec").orderBy(F.xxhash64("gid"), "gid").limit(want).orderBy("gid").collect()
    )
    pivots = distances.prepare(np.array([r["vec"] for r in sample], dtype=np.float64).reshape(len(sample), dim), metric)

    keep = [f for f in points.schema.fields if f.name not in ("vec", "block", "cell")]
    names = [f.name for f in keep]
    out_schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in keep] + ["vec array<double>", "pivot int", "reach double"]
    )

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vecs = distances.prepare(matrix(batch.column("vec"), dim), metric)
            pivot = np.empty(len(vecs), dtype=np.int32)
            for part in distances.tiles(len(vecs), len(pivots)):
                pivot[part] = distances.screen(vecs[part], pivots, metric)[0].argmin(axis=1)
            reach = distances.exact(vecs, pivots[pivot], metric)
            if metric != "manhattan":
                reach = np.sqrt(reach)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [list_column(vecs), pa.array(pivot), pa.array(reach)],
                names=[*names, "vec", "pivot", "reach"],
            )

    located = cut_lineage(map_arrow(points.select(*names, "vec"), locate, out_schema))
    cells = sorted(
        located.groupBy("grp", "pivot").agg(F.max("reach").alias("r"), F.sum("w").alias("w"), F.count("*").alias("n")).collect(),
        key=lambda r: (r["grp"], r["pivot"]),
    )
    chunks = np.array([math.ceil(r["n"] / (2 * target)) for r in cells], dtype=np.int64)
    first = np.cumsum(chunks) - chunks
    plan = [(r["grp"], r["pivot"], c, int(first[c]), int(chunks[c])) for c, r in enumerate(cells)]
    kind = points.schema["grp"].dataType.simpleString()
    layout = spark.createDataFrame(plan, f"grp {kind}, pivot int, cell int, first int, chunks int")
    blocked = located.join(F.broadcast(layout), ["grp", "pivot"]).select(
        *names, "vec", "cell",
        (F.col("first") + F.pmod(F.xxhash64("gid"), F.col("chunks"))).cast("int").alias("block"),
    )
    number = {g: i for i, g in enumerate(sorted({r["grp"] for r in cells}))}
    return Blocks(
        points=blocked,
        rows=n,
        dim=dim,
        metric=metric,
        n_blocks=int(chunks.sum()),
        ids=np.arange(len(cells)),
        group=np.array([number[r["grp"]] for r in cells], dtype=np.int64),
        first=first,
        chunks=chunks,
        centers=pivots[[r["pivot"] for r in cells]] if cells else np.empty((0, dim)),
        radius=np.array([r["r"] for r in cells]),
        weight=np.array([r["w"] for r in cells], dtype=np.int64),
        count=np.array([r["n"] for r in cells], dtype=np.int64),
    )


def hash_blocks(points: DataFrame, rows: int, block_rows: int = 4096) -> tuple[DataFrame, int]:
    """Blocks by hash of ``gid``, for sweeps in which every block meets every other."""
    n_blocks = max(1, math.ceil(rows / _target(points, rows, block_rows)))
    return points.withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(n_blocks)).cast("int")), n_blocks


def group_blocks(points: DataFrame, block_rows: int = 4096) -> tuple[DataFrame, int, DataFrame]:
    """Blocks by hash within each group (``grp``), their number, and the visits by which all blocks of a group meet."""
    counts = points.groupBy("grp").agg(F.count("*").alias("n")).withColumn("cell", F.monotonically_increasing_id())
    sizes = cut_lineage(counts).collect()
    target = _target(points, sum(r["n"] for r in sizes), block_rows)
    plan, owners, at = [], [], 0
    for cell, r in enumerate(sizes):
        chunks = math.ceil(r["n"] / target)
        plan.append((r["grp"], cell, at, chunks))
        owners.append((cell, [(at, chunks)]))
        at += chunks
    spark, kind = points.sparkSession, points.schema["grp"].dataType.simpleString()
    layout = spark.createDataFrame(plan, f"grp {kind}, cell int, first int, chunks int")
    block = (F.col("first") + F.pmod(F.xxhash64("gid"), F.col("chunks"))).cast("int")
    blocked = points.join(F.broadcast(layout), "grp").withColumn("block", block).drop("first", "chunks")
    return blocked, at, spark.createDataFrame(owners, VISITS)


def center_gap(blocks: Blocks, row: int) -> np.ndarray:
    """Distance of one block centre to all block centres."""
    diff = blocks.centers - blocks.centers[row]
    if blocks.metric == "manhattan":
        return np.abs(diff).sum(axis=1)
    return np.sqrt((diff * diff).sum(axis=1))


def bounds(blocks: Blocks, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound on point distances from one cell to each cell; infinite for cells of other groups."""
    gap = center_gap(blocks, row)
    reach = blocks.radius + blocks.radius[row]
    slack = 1e-9 * (1.0 + gap + reach)
    own = blocks.group == blocks.group[row]
    return np.where(own, np.maximum(gap - reach - slack, 0.0), np.inf), np.where(own, gap + reach + slack, np.inf)


def knn_visits(blocks: Blocks, k: int) -> list[np.ndarray]:
    """Per receiver cell, the cells that can hold one of its k nearest."""
    visits = []
    for row in range(len(blocks.ids)):
        low, high = bounds(blocks, row)
        order = np.argsort(high, kind="stable")
        enough = np.searchsorted(np.cumsum(blocks.count[order]), k + 1)
        reach = high[order[enough]] if enough < len(order) else np.inf
        visits.append(np.flatnonzero((low <= reach) & np.isfinite(low)))
    return visits


VISITS = "cell int, owners array<struct<first:int,chunks:int>>"


def visit_table(spark, blocks: Blocks, visits: list[np.ndarray]) -> DataFrame:
    """(cell, owners): for each streamed cell the runs of receiver blocks it must reach."""
    owners: list[list[tuple[int, int]]] = [[] for _ in blocks.ids]
    for row, targets in enumerate(visits):
        run = (int(blocks.first[row]), int(blocks.chunks[row]))
        for t in targets:
            owners[t].append(run)
    return spark.createDataFrame([(i, o) for i, o in enumerate(owners) if o], VISITS)


def sweep(
    receivers: DataFrame,
    streamed: DataFrame,
    fold: Callable[[], object],
    schema: str,
    n_blocks: int,
    visits: DataFrame | None = None,
    order: list[str] = (),
) -> DataFrame:
    """Stream ``streamed`` past every block of ``receivers``.

    ``fold()`` builds an object with ``start(table)``, ``step(batch)`` and
    ``finish() -> iterator of RecordBatch``. ``visits`` tells which blocks the rows of a cell meet; without it
    each of the ``n_blocks`` receiver blocks (numbered from 0) meets all of them. A task may hold
    several blocks, one after the other.
    """
    if visits is None:
        tagged = streamed.withColumn("owner", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0)))))
    else:
        runs = streamed.join(visits, "cell").withColumn("_run", F.explode("owners")).drop("owners")
        last = F.col("_run.first") + F.col("_run.chunks") - 1
        tagged = runs.withColumn("owner", F.explode(F.sequence("_run.first", last))).drop("_run")
    left = receivers.withColumns({"owner": F.col("block"), "role": F.lit(0)}).drop("block", "cell")
    right = tagged.withColumn("role", F.lit(1)).drop("block", "cell")
    tasks = max(1, min(n_blocks, MAX_TASKS))
    stream = (
        left.unionByName(right, allowMissingColumns=True)
        .repartitionById(tasks, F.pmod("owner", F.lit(tasks)).cast("int"))
        .sortWithinPartitions("owner", "role", *order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state, held = None, None, []

        def close():
            if state is not None:
                yield from state.finish()
            elif held:
                idle = fold()
                idle.start(pa.Table.from_batches(held))
                yield from idle.finish()

        for batch in batches:
            keys = batch.column("owner").to_numpy()
            roles = batch.column("role").to_numpy()
            code = keys.astype(np.int64) * 2 + roles
            cuts = np.flatnonzero(np.diff(code)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(code)]):
                if hi <= lo:
                    continue
                piece = batch.slice(lo, hi - lo)
                if keys[lo] != owner:
                    yield from close()
                    owner, state, held = keys[lo], None, []
                if roles[lo] == 0:
                    held.append(piece)
                    continue
                if state is None:
                    if not held:
                        continue
                    state = fold()
                    state.start(pa.Table.from_batches(held))
                    held = []
                state.step(piece)
        yield from close()

    return map_arrow(stream, run, schema)
