"""Compact codes of vectors: every part of a vector is replaced by its nearest codebook entry.

Components become integers (floor of 256 x), so that every distance, sum and tie is exact. Tasks cut their rows into blocks
and build one metric tree per block and part position by the anchors hierarchy: about sqrt(n) anchors are placed middle-out
(each new one is the point farthest from its anchor and takes over what lies nearer to it), merged pairwise into ever larger
balls above, and split again below. Each ball keeps its centre, radius, sum and count. Blocks and trees are written once;
every round walks down the trees with the list of entries that can still be nearest to something in the ball: a list
shrinks on the way down, and when one entry is left the ball belongs to it whole, by its cached sum and count. What is
still open in a leaf is compared point by point.

Between rounds the driver holds the codebooks alone (entries x dimensions integers); tasks send sums per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow, release

#: Parts of a vector, entries of a codebook, rounds of learning, rows of a block, points of a leaf.
PARTS, ENTRIES, ROUNDS, BLOCK, LEAF = 16, 64, 2, 8192, 64
#: Largest component (after scaling) for which all sums of squares stay within 64 bits.
LARGEST = 1 << 26
_TOO_LARGE = f"components beyond {LARGEST // 256} are out of reach of exact 64-bit sums"


@dataclass
class Tree:
    """Balls in arrays; a ball's points are ``order[start:stop]``, a leaf has no children (-1)."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    count: np.ndarray


def _anchors(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner of every point among at most ``k`` anchors, and the anchors' points."""
    place = [0]
    owner, far = np.zeros(len(x), np.int64), np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(place) < k:
        new = int(np.argmax(far))
        if far[new] == 0:
            break
        apart = np.sqrt(((x[place] - x[new]) ** 2).sum(axis=1))
        open_ = np.nonzero(far * 2 > apart[owner])[0]  # nearer to their anchor than half the way: never taken over
        d = np.sqrt(((x[open_] - x[new]) ** 2).sum(axis=1))
        took = d < far[open_]
        owner[open_[took]], far[open_[took]] = len(place), d[took]
        place.append(new)
    return owner, np.array(place)


class _Builder:
    def __init__(self, x: np.ndarray, weight: np.ndarray):
        self.x, self.weight, self.balls = x.astype(np.float64), weight, []

    def ball(self, points: np.ndarray, left: int = -1, right: int = -1) -> int:
        w = self.weight[points]
        center = (self.x[points] * w[:, None]).sum(axis=0) / w.sum()
        radius = float(np.sqrt(((self.x[points] - center) ** 2).sum(axis=1).max()))
        self.balls.append((points, left, right, center, radius))
        return len(self.balls) - 1

    def build(self, points: np.ndarray) -> int:
        if len(points) <= LEAF:
            return self.ball(points)
        owner, place = _anchors(self.x[points], int(np.ceil(np.sqrt(len(points)))))
        if len(place) == 1:
            return self.ball(points)
        tops = [self.build(points[owner == i]) for i in range(len(place))]
        return self.merged(tops)

    def merged(self, tops: list[int]) -> int:
        """Balls joined two by two, those first whose joint ball is smallest."""
        n = len(tops)
        center, radius = np.array([self.balls[t][3] for t in tops]), np.array([self.balls[t][4] for t in tops])
        width = np.sqrt(((center[:, None] - center[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]
        np.fill_diagonal(width, np.inf)
        for _ in range(n - 1):
            i, j = divmod(int(np.argmin(width)), n)
            a, b = tops[i], tops[j]
            tops[i] = self.ball(np.concatenate((self.balls[a][0], self.balls[b][0])), a, b)
            center[i], radius[i] = self.balls[tops[i]][3], self.balls[tops[i]][4]
            alive = np.isfinite(width[i])
            fresh = np.where(alive, np.sqrt(((center - center[i]) ** 2).sum(axis=1)) + radius + radius[i], np.inf)
            fresh[[i, j]] = np.inf
            width[i], width[:, i] = fresh, fresh
            width[j], width[:, j] = np.inf, np.inf
        return tops[i]


def grow(x: np.ndarray, weight: np.ndarray) -> Tree:
    """The tree over the rows of ``x`` (integers), row ``i`` standing for ``weight[i]`` equal points; the root is ball 0."""
    made = _Builder(x, weight)
    root = made.build(np.arange(len(x)))
    balls, order, number, todo = [], [], {}, [root]
    while todo:
        b = todo.pop()
        number[b] = len(balls)
        points, left, right, center, radius = made.balls[b]
        start = sum(map(len, order))
        balls.append((start, start + len(points), left, right, center, radius))
        if left < 0:
            order.append(points)
        else:
            todo += [right, left]
    order = np.concatenate(order)
    start, stop = (np.array([b[i] for b in balls], np.int64) for i in (0, 1))
    sums = np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order] * weight[order][:, None], axis=0)))
    many = np.concatenate(([0], np.cumsum(weight[order])))
    child = [np.array([number.get(b[i], -1) for b in balls], np.int64) for i in (2, 3)]
    return Tree(order, start, stop, *child, np.array([b[4] for b in balls]), np.array([b[5] for b in balls]), sums[stop] - sums[start], many[stop] - many[start])


def descend(tree: Tree, x: np.ndarray, book: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Who owns what: ("ball", balls, entries) for balls that one entry owns, ("point", rows, entries) for the rest.

    The nearest entry wins, on equal distance the one with the lower index. An entry leaves a ball's list only if
    another is nearer to every place in the ball by more than rounding can blur.
    """
    e = book.astype(np.float64)
    _, first = np.unique(book, axis=0, return_index=True)
    twin = np.ones(len(book), bool)
    twin[first] = False  # an entry equal to an earlier one never wins
    square = (e * e).sum(axis=1)
    gap = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * e @ e.T, 0))
    blur = 1e-9 * (1 + square.max() + (tree.center ** 2).sum(axis=1).max())
    balls, lists = np.zeros(1, np.int64), ~twin[None]
    while len(balls):
        c = tree.center[balls]
        d = np.where(lists, square[None] - 2 * c @ e.T + (c * c).sum(axis=1)[:, None], np.inf)
        best = d.argmin(axis=1)
        room = d - d[np.arange(len(balls)), best][:, None] - 2 * tree.radius[balls][:, None] * gap[best]
        lists = lists & (room <= blur)
        lone = lists.sum(axis=1) == 1
        yield "ball", balls[lone], best[lone]
        leaf = ~lone & (tree.left[balls] < 0)
        if leaf.any():
            at = balls[leaf]
            size = tree.stop[at] - tree.start[at]
            places = np.arange(size.sum()) + np.repeat(tree.start[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            rows, entries = np.nonzero(np.repeat(lists[leaf], size, axis=0))
            points = tree.order[places]
            apart = ((x[points[rows]] - book[entries]) ** 2).sum(axis=1)
            rank = np.lexsort((entries, apart, rows))
            pick = rank[np.concatenate(([True], rows[rank][1:] != rows[rank][:-1]))]
            yield "point", points, entries[pick]
        inner = ~lone & ~leaf
        balls = np.concatenate((tree.left[balls[inner]], tree.right[balls[inner]]))
        lists = np.concatenate((lists[inner], lists[inner]))


def sums_by_entry(tree: Tree, x: np.ndarray, weight: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Per entry the sum of its points' components, then their number."""
    out = np.zeros((len(book), x.shape[1] + 1), np.int64)
    for kind, at, entry in descend(tree, x, book):
        part = (tree.total[at], tree.count[at]) if kind == "ball" else (x[at] * weight[at][:, None], weight[at])
        np.add.at(out, entry, np.column_stack(part))
    return out


def nearest(tree: Tree, x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entry of every row of ``x``."""
    out = np.zeros(len(x), np.int64)
    for kind, at, entry in descend(tree, x, book):
        if kind == "point":
            out[at] = entry
        else:
            for a, b, k in zip(tree.start[at].tolist(), tree.stop[at].tolist(), entry.tolist(), strict=True):
                out[tree.order[a:b]] = k
    return out


_TREE = ("order", "start", "stop", "left", "right", "center", "radius", "total", "count")
_WIDTH = {"order": "<i4", "start": "<i4", "stop": "<i4", "left": "<i4", "right": "<i4", "center": "<f8", "radius": "<f8", "total": "<i8", "count": "<i8"}


def _pack(tree: Tree) -> list[bytes]:
    return [np.ascontiguousarray(getattr(tree, k), _WIDTH[k]).tobytes() for k in _TREE]


def _unpack(values: list[bytes], width: int) -> Tree:
    found = {k: np.frombuffer(v, _WIDTH[k]) for k, v in zip(_TREE, values, strict=True)}
    whole = {k: v.astype(np.int64) for k, v in found.items() if k in ("order", "start", "stop", "left", "right")}
    shape = (len(found["radius"]), width)
    return Tree(**{**found, **whole, "center": found["center"].reshape(shape), "total": found["total"].reshape(shape)})


def edges_of(dimensions: int, parts: int) -> list[int]:
    """Where parts begin and end: equal parts, or parts that differ by one if the dimension cannot be divided."""
    return [dimensions * i // parts for i in range(parts + 1)]


def _blocks(dimensions: int, parts: int, block: int):
    edges = edges_of(dimensions, parts)

    def row(ids: list[pa.Array], labels: list[pa.Array], values: list[np.ndarray]) -> pa.RecordBatch:
        ids, labels, x = pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(values)
        stored = []
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                stored.append([np.zeros(len(x), "<i4").tobytes(), b"", b"", *[b""] * len(_TREE)])
                continue
            points, which, weight = np.unique(x[:, a:b], axis=0, return_inverse=True, return_counts=True)
            stored.append([which.astype("<i4").tobytes(), points.astype("<i4").tobytes(), weight.astype("<i8").tobytes(), *_pack(grow(points, weight))])
        offsets = pa.array([0, len(x)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, labels), pa.array([stored], pa.list_(pa.list_(pa.binary())))], ["ids", "labels", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values, n = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(flat * 256).reshape(part.num_rows, dimensions)
                if len(x) and np.abs(x).max() > LARGEST:
                    raise ValueError(_TOO_LARGE)
                ids.append(part.column("id"))
                labels.append(part.column("label"))
                values.append(x.astype(np.int64))
                n += part.num_rows
                if n >= block:
                    yield row(ids, labels, values)
                    ids, labels, values, n = [], [], [], 0
        if n:
            yield row(ids, labels, values)

    return run


def _opened(stored: list[list[bytes]], edges: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Tree | None]]:
    """(part, row to point, points, weights, tree) of a block."""
    for p, (which, points, weight, *tree) in enumerate(stored):
        width = edges[p + 1] - edges[p]
        which = np.frombuffer(which, "<i4").astype(np.int64)
        if not width:
            yield p, which, np.zeros((1, 0), np.int64), np.ones(1, np.int64), None
            continue
        yield p, which, np.frombuffer(points, "<i4").astype(np.int64).reshape(-1, width), np.frombuffer(weight, "<i8"), _unpack(tree, width)


def _learned(blocks: DataFrame, books: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """The codebooks after one round."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in shared.value]
        for batch in batches:
            for stored in batch.column("parts"):
                for p, _, points, weight, tree in _opened(stored.as_py(), edges):
                    if tree is not None:
                        total[p] += sums_by_entry(tree, points, weight, shared.value[p])
        flat = np.concatenate([t.ravel() for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["slot", "amount"])

    rows = map_arrow(blocks.select("parts"), run, "slot int, amount bigint").groupBy("slot").agg(F.sum("amount").alias("amount")).collect()
    flat = np.zeros(sum(b.shape[0] * (b.shape[1] + 1) for b in books), np.int64)
    for r in rows:  # as many as the codebooks have numbers
        flat[r["slot"]] = r["amount"]
    out, at = [], 0
    for b in books:
        n = b.shape[0] * (b.shape[1] + 1)
        part = flat[at:at + n].reshape(b.shape[0], -1)
        used = part[:, -1:] > 0
        out.append(np.where(used, part[:, :-1] // np.maximum(part[:, -1:], 1), b))
        at += n
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(vec_id, code, error, label, label_error, codebooks_sha256): one row per row of ``vectors`` that is kept.

    Rows whose vector is null or empty or holds a null, NaN or infinity are dropped, as are vectors of another length
    than that of the smallest id. The codebooks start from the ``entries`` smallest ids (rows without an id come last, rows
    of one id in the order of their vectors; fewer rows give fewer entries); ids and rows that repeat each count. ``code``
    has two hex digits a part, ``error`` is the squared distance over all parts, ``label_error`` its sum over the rows
    with the same label (null is a label). A component beyond 2^18 is refused with an error. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    kept = vectors.select(F.col(f"`{vec_id}`").alias("id"), v.alias("v"), F.col(f"`{label}`").alias("label")).where(v.isNotNull() & (F.size(v) > 0) & finite)
    first = kept.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    dimensions = len(first[0]["v"]) if first else 1
    kept = kept.where(F.size("v") == dimensions)
    edges = edges_of(dimensions, parts)
    start = np.array([r["v"] for r in kept.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()], np.float64)
    if np.abs(start).max(initial=0) * 256 > LARGEST:
        raise ValueError(_TOO_LARGE)
    start = np.floor(start * 256).astype(np.int64).reshape(-1, dimensions)
    books = [start[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
    kinds = [kept.schema[c].dataType.simpleString() for c in ("id", "label")]
    blocks = cut_lineage(map_arrow(kept, _blocks(dimensions, parts, block), f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, parts array<array<binary>>"))
    for _ in range(rounds if len(start) else 0):
        books = _learned(blocks, books, edges)
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, which, points, _, tree in _opened(batch.column("parts")[i].as_py(), edges):
                    if tree is not None:
                        owner = nearest(tree, points, shared.value[p])
                        code[:, p] = owner[which]
                        error += ((points - shared.value[p][owner]) ** 2).sum(axis=1)[which]
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[2 * parts * r:2 * parts * (r + 1)] for r in range(len(ids))], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    rows = cut_lineage(map_arrow(blocks, coded, f"id {kinds[0]}, label {kinds[1]}, code string, error bigint"))
    release(blocks)
    by_label = cut_lineage(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
