"""Exact nearest neighbours and distance ranks at scale.

Ties are always broken by identifier. Copies of one vector are collapsed to a
single weighted point first, so a vector shared by a third of all rows costs
one point, and each row's list is rebuilt from at most ``k + 1`` members per
distinct vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, map_arrow
from . import distances
from .arrays import list_column, matrix, vector
from .sweep import Blocks, assign_blocks, bounds, knn_visits, sweep, visit_table

THRESHOLDS_PER_ROW = 64
#: From so many thresholds on a row of distances is sorted, below it is compared with each of them.
SORTED_FROM = 6
HOT_SHARE = 1024


class _TopK:
    """Keeps the k best (score, gid) of each receiver row."""

    def __init__(self, k: int, metric: str):
        self.k, self.metric = k, metric

    def start(self, table: pa.Table) -> None:
        self.gid = vector(table["gid"], np.int64)
        self.vec = matrix(table["vec"])
        m = len(self.gid)
        self.row = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.other = np.empty(0, np.int64)
        self.kth = np.full(m, np.inf)

    def step(self, batch: pa.RecordBatch) -> None:
        other = vector(batch.column("gid"), np.int64)
        vec = matrix(batch.column("vec"))
        rows, scores, ids = [], [], []
        sq = distances.squares(vec) if self.metric != "manhattan" else None
        for part in distances.tiles(len(self.gid), len(other)):
            rough, slack = distances.screen(self.vec[part], vec, self.metric, True, sq)
            limit = self.kth[part] + 2 * slack
            near = rough <= limit[:, None]
            need = self.k + 1  # the row itself may be among them
            if len(other) > need and np.count_nonzero(near) > 8 * need * len(rough):
                # no useful bound yet: take one from this batch
                kth = np.partition(rough, need - 1, axis=1)[:, need - 1]
                near = rough <= np.minimum(limit, kth + 2 * slack)[:, None]
            r, c = np.nonzero(near)
            r += part.start
            keep = self.gid[r] != other[c]
            r, c = r[keep], c[keep]
            rows.append(r)
            scores.append(distances.exact_pairs(self.vec, r, vec, c, self.metric))
            ids.append(other[c])
        self._merge(np.concatenate(rows), np.concatenate(scores), np.concatenate(ids))

    def _merge(self, rows, scores, ids) -> None:
        row = np.concatenate([self.row, rows])
        score = np.concatenate([self.score, scores])
        other = np.concatenate([self.other, ids])
        order = np.lexsort((other, score, row))
        row, score, other = row[order], score[order], other[order]
        first = np.searchsorted(row, row, side="left")
        place = np.arange(len(row)) - first
        keep = place < self.k
        full = place == self.k - 1
        self.kth[row[full]] = score[full]
        self.row, self.score, self.other = row[keep], score[keep], other[keep]

    def finish(self) -> Iterator[pa.RecordBatch]:
        place = np.arange(len(self.row)) - np.searchsorted(self.row, self.row, side="left")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(self.gid[self.row]), pa.array(self.other), pa.array(self.score),
                pa.array((place + 1).astype(np.int32)),
            ],
            names=["gid", "other", "score", "rank"],
        )


class _CountCloser:
    """Adds up the weight of streamed points strictly closer than each threshold."""

    def __init__(self, metric: str):
        self.metric = metric

    def start(self, table: pa.Table) -> None:
        self.vec = matrix(table["vec"])
        pairs = table["pairs"].combine_chunks()
        sizes = pairs.value_lengths().to_numpy(zero_copy_only=False)
        shape = (len(sizes), int(sizes.max(initial=0)))
        self.used = np.arange(shape[1])[None, :] < sizes[:, None]
        self.pair = np.zeros(shape, np.int64)
        self.pair[self.used] = vector(pairs.flatten(), np.int64)
        self.score = np.full(shape, -np.inf)
        self.score[self.used] = vector(table["scores"].combine_chunks().flatten())
        self.total = np.repeat(vector(table["base"], np.int64)[:, None], shape[1], axis=1)

    def step(self, batch: pa.RecordBatch) -> None:
        vec = matrix(batch.column("vec"))
        w = vector(batch.column("w"), np.int64)
        heavy = np.flatnonzero(w > 1)
        surplus = (w[heavy] - 1).astype(np.float64)
        sq = distances.squares(vec) if self.metric != "manhattan" else None
        for part in distances.tiles(len(self.vec), len(w)):
            rough, slack = distances.screen(self.vec[part], vec, self.metric, False, sq)
            low, high = self.score[part] - 2 * slack, self.score[part] + 2 * slack
            below, upto = self._places(rough, low, high)
            add = below.astype(np.int64)
            if len(heavy):
                heavy_rough = rough[:, heavy]
                for q in range(self.score.shape[1]):
                    add[:, q] += np.rint((heavy_rough < low[:, q, None]) @ surplus).astype(np.int64)
            for q in np.flatnonzero((upto > below).any(axis=0)):
                open_rows = np.flatnonzero(upto[:, q] > below[:, q])
                some = rough[open_rows]
                r, c = np.nonzero((some >= low[open_rows, q, None]) & (some <= high[open_rows, q, None]))
                r = open_rows[r]
                close = distances.exact_pairs(self.vec[part], r, vec, c, self.metric) < self.score[part][r, q]
                np.add.at(add[:, q], r[close], w[c[close]])
            self.total[part] += add

    @staticmethod
    def _places(rough: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values of a row are below ``low`` and up to ``high``, for every threshold of the row."""
        below, upto = np.empty(low.shape, np.int64), np.empty(high.shape, np.int64)
        if low.shape[1] < SORTED_FROM:
            for q in range(low.shape[1]):
                below[:, q] = np.count_nonzero(rough < low[:, q, None], axis=1)
                upto[:, q] = np.count_nonzero(rough <= high[:, q, None], axis=1)
            return below, upto
        # one sort of a row costs less than comparing it with every threshold
        ordered = np.sort(rough, axis=1)
        for row, values in enumerate(ordered):
            below[row] = values.searchsorted(low[row], "left")
            upto[row] = values.searchsorted(high[row], "right")
        return below, upto

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.pair[self.used]), pa.array(self.total[self.used])], names=["pair", "closer"]
        )


def _vec64(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def ordered_keys(df: DataFrame, id_col: str) -> DataFrame:
    """Add ``key BIGINT`` that sorts like the (unique) identifier.

    Integral identifiers are their own key; others are numbered after a range
    sort, and the numbering is persisted so that it stays fixed.
    """
    if isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return df.withColumn("key", F.col(id_col).cast("bigint"))
    numbered = df.select(id_col).orderBy(id_col).withColumn("key", F.monotonically_increasing_id())
    return df.join(cut_lineage(numbered), id_col)


def collapse_copies(points: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """``points(key, vec[, grp])`` -> (members(key, gid), distinct(gid, w, vec[, grp])).

    ``gid`` is the smallest key that holds the vector (in its group); members is
    None when no vector repeats (then every key is its own gid). The aggregation
    combines map-side, so a hot vector shrinks to one row per task before the
    shuffle. Members of the vectors that hold more than one row in ``HOT_SHARE``
    (hence fewer than that many) are found by a broadcast, the others by a shuffle.
    """
    same = ["vec", *[c for c in points.columns if c == "grp"]]
    distinct = cut_lineage(points.groupBy(*same).agg(F.min("key").alias("gid"), F.count("*").alias("w")))
    shared = distinct.filter("w > 1").select(*same, "gid", "w")
    if shared.isEmpty():
        return None, distinct.select("gid", "w", *same)
    floor = distinct.agg(F.sum("w")).first()[0] / HOT_SHARE
    hot = F.broadcast(shared.filter(F.col("w") > floor).drop("w"))
    rare = shared.filter(F.col("w") <= floor).drop("w")
    members = points.join(hot, same).select("key", "gid").unionByName(
        points.join(hot, same, "left_anti").join(rare, same, "left").select("key", F.coalesce("gid", "key").alias("gid"))
    )
    return cut_lineage(members), distinct.select("gid", "w", *same)


def knn(
    points: DataFrame,
    k: int,
    id_col: str = "identifier",
    vec_col: str = "vec",
    metric: str = "euclidean",
    block_rows: int = 4096,
    group_col: str | None = None,
) -> DataFrame:
    """Exact k nearest neighbours, self excluded: ``(i, j, rank, distance)``.

    With ``group_col`` neighbours are sought within the row's own group; identifiers
    are unique over all groups.
    """
    keyed, source = _sources(points, id_col, vec_col, metric, group_col)
    members, distinct = collapse_copies(source)
    blocks = assign_blocks(distinct, "euclidean" if metric == "cosine" else metric, block_rows)
    lists = _knn_distinct(blocks, k)
    if members is None:
        out = lists.select(F.col("gid").alias("i"), F.col("other").alias("j"), "rank", "score")
    else:
        out = _expand(members, distinct, lists.drop("rank"), k)
    out = out.withColumn("distance", _distance(F.col("score"), metric)).drop("score")
    return _named(out, keyed, id_col)


def _sources(points: DataFrame, id_col: str, vec_col: str, metric: str, group_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their keys, and ``(key, vec[, grp])`` to search in."""
    group = [F.col(group_col).alias("grp")] if group_col else []
    keyed = ordered_keys(points.select(id_col, _vec64(vec_col).alias("vec"), *group), id_col)
    source = keyed.select("key", *(["grp"] if group_col else []), "vec")
    return keyed, source if metric != "cosine" else _unit(source)


def _unit(df: DataFrame) -> DataFrame:
    """Unit vectors, so that directions that agree exactly collapse."""
    at = df.columns.index("vec")

    def scale(batches):
        for b in batches:
            yield b.set_column(at, "vec", list_column(distances.prepare(matrix(b.column("vec")), "cosine")))

    return map_arrow(df, scale, df.schema)


def _distance(score: Column, metric: str) -> Column:
    return {"euclidean": F.sqrt(score), "cosine": score / 2.0}.get(metric, score)


def _named(df: DataFrame, keyed: DataFrame, id_col: str) -> DataFrame:
    """Replace keys i, j by identifiers (no join when the identifier is its own key)."""
    cols = [c for c in df.columns if c not in ("i", "j")]
    kind = keyed.schema[id_col].dataType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return df.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), *cols)
    names = keyed.select("key", F.col(id_col).alias("_name"))
    for side in ("i", "j"):
        df = df.join(names.withColumnRenamed("key", side), side).drop(side).withColumnRenamed("_name", side)
    return df.select("i", "j", *cols)


def _knn_distinct(blocks: Blocks, k: int) -> DataFrame:
    """Top-k list over distinct points: (gid, other, score)."""
    spark = blocks.points.sparkSession
    visits = visit_table(spark, blocks, knn_visits(blocks, k))
    side = blocks.points.select("gid", "vec", "cell", "block")
    metric = blocks.metric
    return sweep(
        side, side, lambda: _TopK(k, metric), "gid bigint, other bigint, score double, rank int", blocks.n_blocks, visits
    )


def _expand(members: DataFrame, distinct: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Distinct-point lists -> per-row lists (i, j, rank, score)."""
    first = Window.partitionBy("gid").orderBy("key")
    heads = (
        members.withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= k + 1)
        .select(F.col("gid").alias("other"), F.col("key").alias("j"))
    )
    own = distinct.filter("w > 1").select("gid", F.col("gid").alias("other"), F.lit(0.0).alias("score"))
    candidates = lists.unionByName(own).join(heads, "other").select("gid", "score", "j")
    best = Window.partitionBy("gid").orderBy("score", "j")
    listed = (
        candidates.withColumn("nth", F.row_number().over(best))
        .filter(F.col("nth") <= k + 1)
        .groupBy("gid")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "score", "j"))).alias("list"))
    )
    mine = F.slice(F.filter("list", lambda e: e["j"] != F.col("key")), 1, k)
    return (
        members.join(listed, "gid")
        .select(F.col("key").alias("i"), F.posexplode(mine).alias("pos", "e"))
        .select("i", F.col("e.j").alias("j"), (F.col("pos") + 1).alias("rank"), F.col("e.score").alias("score"))
    )


def pair_scores(pairs: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    """Score of given key pairs ``(i, j, ...)`` from ``points(key, vec)``."""
    left = points.select(F.col("key").alias("i"), F.col("vec").alias("va"))
    right = points.select(F.col("key").alias("j"), F.col("vec").alias("vb"))
    joined = pairs.join(left, "i").join(right, "j")
    keep = pairs.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def measure(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            a = distances.prepare(matrix(b.column("va")), metric)
            c = distances.prepare(matrix(b.column("vb")), metric)
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in keep] + [pa.array(distances.exact(a, c, metric))], names=[*keep, "score"]
            )

    return map_arrow(joined.select(*keep, "va", "vb"), measure, f"{kinds}, score double")


def distance_ranks(
    pairs: DataFrame,
    points: DataFrame,
    id_col: str = "identifier",
    vec_col: str = "vec",
    metric: str = "euclidean",
    block_rows: int = 4096,
    group_col: str | None = None,
) -> DataFrame:
    """Rank of j among all rows (of its group) by distance from i, for given pairs ``(i, j, ...)``.

    rank = 1 + number of rows other than i strictly closer to i than j is
    (rows at equal distance share the rank). Adds ``rank_hi``.
    """
    keyed, source = _sources(points, id_col, vec_col, metric, group_col)
    space = "euclidean" if metric == "cosine" else metric
    members, distinct = collapse_copies(source)
    blocks = assign_blocks(distinct, space, block_rows)

    kind = points.schema[id_col].dataType
    integral = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    names = keyed.select("key", F.col(id_col).alias("_name"))
    numbered = pairs
    for side in ("i", "j"):
        if integral:
            numbered = numbered.withColumn(f"k{side}", F.col(side).cast("bigint"))
        else:
            numbered = numbered.join(names.withColumnRenamed("_name", side), side).withColumnRenamed("key", f"k{side}")
    # copies of one vector see the same world: only distinct (vector, vector) pairs are counted
    if members is None:
        placed = numbered.withColumns({"gi": F.col("ki"), "gj": F.col("kj")})
    else:
        placed = numbered.join(members.select(F.col("key").alias("ki"), F.col("gid").alias("gi")), "ki").join(
            members.select(F.col("key").alias("kj"), F.col("gid").alias("gj")), "kj"
        )
    placed = cut_lineage(placed)
    todo = placed.select(F.col("gi").alias("i"), F.col("gj").alias("j")).distinct()
    scored = pair_scores(todo, distinct.select(F.col("gid").alias("key"), "vec"), space)
    scored = cut_lineage(scored.withColumn("pair", F.monotonically_increasing_id()))
    # one receiver row per point and at most a few dozen thresholds: a point that is asked for
    # more of them is spread over several rows
    asked = scored.groupBy("i").agg(F.ceil(F.count("*") / THRESHOLDS_PER_ROW).alias("parts"))
    receivers = cut_lineage(
        scored.join(asked, "i")
        .groupBy("i", F.pmod(F.xxhash64("j"), F.col("parts")).alias("part"))
        .agg(
            F.collect_list(F.struct("pair", "score")).alias("t"),
            F.min("score").alias("lo"),
            F.max("score").alias("hi"),
        )
        .join(blocks.points.select(F.col("gid").alias("i"), "vec", "cell", "block"), "i")
        .select(F.col("t.pair").alias("pairs"), F.col("t.score").alias("scores"), "lo", "hi", "vec", "cell", "block")
    )

    reach = {
        r["cell"]: (r["lo"], r["hi"])
        for r in receivers.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    }
    squared = space != "manhattan"
    visits, base = [], []
    for row, cell in enumerate(blocks.ids):
        if cell not in reach:
            visits.append(np.empty(0, np.int64))
            continue
        lo, hi = (np.sqrt(reach[cell]) if squared else np.array(reach[cell]))
        low, high = bounds(blocks, row)
        inside = high < lo
        visits.append(np.flatnonzero((low <= hi) & ~inside))
        base.append((int(cell), int(blocks.weight[inside].sum())))
    spark = points.sparkSession
    bases = spark.createDataFrame(base or [(0, 0)], "cell int, base bigint")
    counted = sweep(
        receivers.drop("lo", "hi").join(F.broadcast(bases), "cell"),
        blocks.points.select("w", "vec", "cell"),
        lambda: _CountCloser(space),
        "pair bigint, closer bigint",
        blocks.n_blocks,
        visit_table(spark, blocks, visits),
    )
    # the row itself is strictly closer than any row at a positive distance
    ranks = scored.join(counted, "pair").select(
        F.col("i").alias("gi"), F.col("j").alias("gj"),
        (F.col("closer") + F.when(F.col("score") > 0, 0).otherwise(1)).alias("rank_hi"),
    )
    return placed.join(ranks, ["gi", "gj"]).select(*pairs.columns, "rank_hi")
