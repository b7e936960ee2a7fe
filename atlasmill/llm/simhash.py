"""Near duplicates by SimHash, found through bit counts of fingerprint segments.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two count
vectors never exceeds the Hamming distance of the fingerprints, so pairs within r bits lie within r in the count
space. That space is cut into ``r + 3`` groups of coordinates: a pair within r differs in at most r groups, so it
shares the grid cell of at least three. Cells are searched in tasks, by blocks: Manhattan bound first, exact
distance on what is left; only a spanning forest of each block's links leaves the task, never all pairs. A count
is kept in unary (00, 01, 11), which makes the Manhattan distance the bit count of an exclusive or.

Equal fingerprints are one node. Fingerprints of crowded cells are first linked over single-bit steps (a key per
cleared bit has two members at most); cells that lie within one component then need no search, the others are
searched in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow, task_width
from .common import arrow_task, packed, raw, texts, unpacked, words_of
from .components import components

#: Words of a shingle, bits by which linked fingerprints may differ, and rows of a cell searched at once.
SHINGLE, DISTANCE, TILE = 4, 4, 2048
_LOW = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles (XXH64, seed 42); no words give zero."""
    words = words_of(text)
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:at + (1 << 15)], stops[at:at + (1 << 15)], strict=True)], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums of 255 rows fit a byte, which keeps the additions narrow
        full = len(bits) // 255 * 255
        ones += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if full else 0
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, version, fp): fingerprint of every row as a signed long; ``version`` is the hash of the text."""

    def rows(batch: pa.RecordBatch) -> list:
        values = np.fromiter((fingerprint(t, shingle) for t in texts(batch.column("t"))), np.uint64, batch.num_rows)
        return [batch.column("doc"), batch.column("version"), values.view(np.int64)]

    frame = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"), raw(text).alias("t"))
    return arrow_task(frame, f"doc {frame.schema['doc'].dataType.simpleString()}, version bigint, fp bigint", rows)


def counts(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each in unary within its two bits."""
    first, second = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(first.bitwiseAND(second), 1).bitwiseOR(first.bitwiseOR(second))


def _masks(groups: int, shared: int) -> list[int]:
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    part = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(part[i] for i in chosen)) for chosen in combinations(range(groups), shared)]


def _cells(nodes: DataFrame, distance: int) -> DataFrame:
    """(cell, at, fp): the grid cells of each fingerprint."""
    groups = distance + 3
    c = counts(F.col("fp"))
    keys = F.array(*[F.struct(F.lit(i).alias("cell"), c.bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(_masks(groups, 3))])
    return nodes.select("fp", F.explode(keys).alias("k")).select("k.cell", "k.at", "fp")


def _unary(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(_LOW)
    first, second = fp & low, (fp >> np.uint64(1)) & low
    return ((first & second) << np.uint64(1)) | first | second


class _Forest:
    """Links that join something new, within one group of rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _search(fp: np.ndarray, label: np.ndarray, block: np.ndarray, crossing: bool, distance: int) -> Iterator[tuple[int, int]]:
    """Spanning links among rows of one tile; rows of one label are linked already, a crossing tile pairs two blocks."""
    order = np.argsort(label, kind="stable")
    fp, label, block = fp[order], label[order], block[order]
    unary, forest = _unary(fp), _Forest(len(fp))
    for at in range(0, len(fp), 256):
        rest = np.searchsorted(label, label[at], side="right") if label[at] == label[min(at + 255, len(fp) - 1)] else at
        near = np.bitwise_count(unary[at:at + 256, None] ^ unary[None, rest:]) <= distance
        x, y = np.nonzero(near)
        x, y = x + at, y + rest
        keep = (x < y) & (label[x] != label[y]) & ((block[x] != block[y]) | (not crossing))
        x, y = x[keep], y[keep]
        true = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        for i, j in zip(x[true].tolist(), y[true].tolist(), strict=True):
            if forest.join(i, j):
                yield int(fp[i]), int(fp[j])


def _small(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within small groups of neighbouring rows, all groups at once."""
    unary, left, right = _unary(fp), [], []
    for step in range(1, len(fp)):
        i = np.nonzero(group[step:] == group[:-step])[0]
        if not len(i):
            break
        i = i[np.bitwise_count(unary[i] ^ unary[i + step]) <= distance]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
        left.append(fp[i])
        right.append(fp[i + step])
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


_KEY = ("cell", "at", "i", "j")


def _links(distance: int):
    """Task over rows sorted by cell and tile: streams them and keeps one tile in memory."""

    def out(pairs: tuple) -> pa.RecordBatch:
        a, b = (np.asarray(x, dtype=np.uint64).view(np.int64) for x in pairs)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def tiles(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(rows["fp"])
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in _KEY], axis=0)
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        fp, tight = rows["fp"].view(np.uint64), (size <= 64) & (size > 1)
        pick = tight[group]
        yield out(_small(fp[pick], group[pick], distance))
        first = np.nonzero(new)[0]
        for g in np.nonzero(size > 64)[0].tolist():
            part = slice(first[g], first[g] + size[g])
            crossing = bool(rows["i"][first[g]] != rows["j"][first[g]])
            found = list(_search(fp[part], rows["label"][part], rows["block"][part], crossing, distance))
            if found:
                yield out(tuple(zip(*found, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {k: batch.column(k).to_numpy() for k in (*_KEY, "block", "label", "fp")}
            if open_ is not None:
                now = {k: np.concatenate((open_[k], v)) for k, v in now.items()}
            same = np.all([now[k] == now[k][-1] for k in _KEY], axis=0)
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from tiles({k: v[:cut] for k, v in now.items()})
            open_ = {k: v[cut:] for k, v in now.items()}
        if open_ is not None:
            yield from tiles(open_)

    return run


def _searched(cells: DataFrame, distance: int) -> DataFrame:
    parts = task_width(cells.sparkSession)
    frame = cells.select(*_KEY, "block", "label", "fp").repartition(parts, *_KEY).sortWithinPartitions(*_KEY)
    return map_arrow(frame, _links(distance), "a bigint, b bigint")


def links(nodes: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that join all within ``distance`` bits of another."""
    cells = _cells(nodes, distance)
    crowded = cut_lineage(cells.groupBy("cell", "at").agg(F.count("*").alias("n")).where(F.col("n") > tile))
    lone = cells.withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(0), "label": F.xxhash64("fp")})
    if crowded.isEmpty():
        return _searched(lone, distance)
    sparse = _searched(lone.join(crowded, ["cell", "at"], "left_anti"), distance)
    full = cut_lineage(cells.join(crowded, ["cell", "at"]))
    members = cut_lineage(full.select("fp").distinct())
    cleared = [F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(~(1 << b) if b < 63 else (1 << 63) - 1)).alias("rest")) for b in range(64)]
    steps = cut_lineage(
        members.select("fp", F.explode(F.array(*cleared)).alias("k")).groupBy("k")
        .agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("a", "b"))
    label = cut_lineage(components(steps).withColumnsRenamed({"node": "fp", "root": "label"}))
    marked = cut_lineage(full.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    mixed = cut_lineage(marked.groupBy("cell", "at").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("cell", "at"))
    blocks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    tiled = (
        marked.join(mixed, ["cell", "at"], "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    )
    return sparse.unionByName(_searched(tiled, distance)).unionByName(steps)


def groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint of ``prints``, named by one of its fingerprints."""
    nodes = cut_lineage(prints.select("fp").distinct())
    roots = components(links(nodes, distance))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    component_id is the smallest id reachable over fingerprints that differ in at most ``distance`` bits. Null and
    empty texts have fingerprint zero and are linked like others. Rows without an id take part; a component in
    which no row has an id gets a null. Repeated rows are returned as often as they come.
    """
    prints = cut_lineage(fingerprints(docs, doc_id, text))
    roots = cut_lineage(groups(prints, distance))
    least = prints.groupBy("fp").agg(F.min("doc").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(roots.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of every near-duplicate group: the one with the smallest id (rows without one come last, ties by text hash)."""
    prints = cut_lineage(fingerprints(docs, doc_id, text))
    roots = cut_lineage(groups(prints, distance))
    best = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version"))
    first = prints.groupBy("fp").agg(best.alias("best")).join(roots, "fp").groupBy("root").agg(F.min("best").alias("best"))
    winners = cut_lineage(first.select("best.doc", "best.version", "root"))
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{doc_id}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("v"))
    kept = rows.join(winners, F.col("k").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")))
    return unpacked(kept.dropDuplicates(["root"]), docs)
