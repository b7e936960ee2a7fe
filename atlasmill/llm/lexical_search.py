"""Ranked lexical search with per-term geometric blocks of postings and exact bounds.

The queries' terms are sent to the tasks in blocks of bounded size. One scan turns every text into a sparse row of those
terms (the forward table, written once); counts over it give document frequencies and lengths. Tasks then take the
forward rows in shards. In a shard the posting list of a term is cut into geometric blocks: members are put to the most similar of
some members of the list (cosine of a random projection), and a block stores the coordinatewise maximum of its rows. A
query opens its lists from the highest possible contribution down, skips a block only if the block's summary, weighted by
the query, stays below the score that the last of the top k has, scores the rows of the others exactly, and stops when
all lists left together cannot reach that score. So nothing is lost, whatever the clustering is like.

A first pass over a random part of the rows gives every query a score that the last of its top k has at least; only rows
that reach it leave a task, and never more than k a query and task. Summaries are kept in the memory of the task that
cut the list (a list is cut when a query first opens it): written out for all lists they would be several times the input.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow, release, task_width
from .common import arrow_task, raw, texts
from .decontaminate import words_of

#: Results of a query; terms of queries sent out at once; rows of a geometric block; cells of a shard; dimensions of the projection.
TOP, QUERY_TERMS, BLOCK, CELLS, PROJECTED = 20, 16_384, 64, 1 << 24, 32
#: Rows of the first pass at least, and its share of larger tables.
FIRST_ROWS, FIRST_SHARE = 8192, 1 / 64


def _queries(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, terms, times): the distinct terms of every row that has one."""

    def rows(batch: pa.RecordBatch) -> list:
        found = [Counter(words_of(t)) for t in texts(batch.column("t"))]
        keep = pa.array([bool(c) for c in found], pa.bool_())
        found = [c for c in found if c]
        return [batch.column("item").filter(keep), pa.array([list(c) for c in found], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]

    frame = items.select(F.col(f"`{item_id}`").alias("item"), raw(text).alias("t"))
    return arrow_task(frame, f"item {frame.schema['item'].dataType.simpleString()}, terms array<binary>, times array<bigint>", rows)


def _forward(docs: DataFrame, number: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc, n, terms, tf): number of terms of every row, and those of the queries with their occurrences, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def rows(batch: pa.RecordBatch) -> list:
        known, n, terms, tf = shared.value, [], [], []
        for t in texts(batch.column("t")):
            words = words_of(t)
            ids, many = np.unique(np.fromiter((i for i in map(known.get, words) if i is not None), np.int32), return_counts=True)
            n.append(len(words))
            terms.append(ids.tobytes())
            tf.append(many.astype(np.int32).tobytes())
        return [batch.column("doc"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())]

    frame = docs.select(F.col(f"`{doc_id}`").alias("doc"), raw(text).alias("t"))
    return arrow_task(frame, f"doc {frame.schema['doc'].dataType.simpleString()}, n bigint, terms binary, tf binary", rows)


def _frequencies(forward: DataFrame, width: int) -> np.ndarray:
    """In how many rows each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=width)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["term", "df"])

    out = np.zeros(width, np.int64)
    for r in map_arrow(forward.select("terms"), run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]  # at most QUERY_TERMS rows, and the terms of one item
    return out


class Shard:
    """Forward rows of one shard, their posting lists and the geometric blocks of those lists that were opened."""

    def __init__(self, width: int, size: np.ndarray, terms: np.ndarray, impact: np.ndarray, weight: np.ndarray):
        self.width, self.terms, self.impact, self.small = width, terms, impact, impact.astype(np.int32)  # an impact is below 10^6
        self.start = np.concatenate(([0], np.cumsum(size)))
        row = np.repeat(np.arange(len(size)), size)
        order = np.argsort(terms, kind="stable")
        self.posting, self.ends = row[order], np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=width))))
        self.most = np.zeros(width, np.int64)
        np.maximum.at(self.most, terms, impact)
        rng = np.random.Generator(np.random.PCG64(3))
        planes = rng.standard_normal((width, PROJECTED)).astype(np.float32)
        self.place = np.zeros((len(size), PROJECTED), np.float32)
        for at in range(0, len(size), 512):  # a bounded number of rows of the projection at once
            a, b = self.start[at], self.start[min(at + 512, len(size))]
            full = np.flatnonzero(size[at:at + 512])
            if len(full):
                strength = (impact[a:b] * weight[terms[a:b]]).astype(np.float32)[:, None]
                self.place[at + full] = np.add.reduceat(planes[terms[a:b]] * strength, self.start[at + full] - a, axis=0)
        self.place /= np.maximum(np.linalg.norm(self.place, axis=1, keepdims=True), 1e-9)
        self.cut: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (among ``rows``) and place of all entries of the rows."""
        size = self.start[rows + 1] - self.start[rows]
        which = np.repeat(np.arange(len(rows)), size)
        return which, np.arange(len(which)) + np.repeat(self.start[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, block of each row, summaries) of a term's list."""
        if term not in self.cut:
            rows = self.posting[self.ends[term]:self.ends[term + 1]]
            k = -(-len(rows) // BLOCK)
            centers = self.place[rows[np.linspace(0, len(rows) - 1, k).astype(np.int64)]]
            block = (self.place[rows] @ centers.T).argmax(axis=1) if k > 1 else np.zeros(len(rows), np.int64)
            which, at = self.entries(rows)
            summary = np.zeros((k, self.width), np.int32)
            np.maximum.at(summary.reshape(-1), block[which] * self.width + self.terms[at], self.small[at])
            self.cut[term] = rows, block, summary
        return self.cut[term]

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        _, at = self.entries(rows)  # rows of a list have an entry at least
        size = self.start[rows + 1] - self.start[rows]
        return np.add.reduceat(dense[self.terms[at]] * self.impact[at], np.concatenate(([0], np.cumsum(size)[:-1])))

    def search(self, terms: np.ndarray, value: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and their scores, that can be among the ``top`` of a query: those that reach ``floor`` and the top-th score found here.

        Ties with the last score are all returned, so that the caller can order them by identifier.
        """
        dense = np.zeros(self.width, np.int64)
        dense[terms] = value
        reach = value * self.most[terms]
        order = np.argsort(-reach, kind="stable")
        left = np.cumsum(reach[order][::-1])[::-1]  # what a row first met in this list can score at most
        seen = np.zeros(len(self.start) - 1, bool)
        rows, score = [np.zeros(0, np.int64)], np.zeros(0, np.int64)
        for bound, term in zip(left.tolist(), terms[order].tolist(), strict=True):
            if bound < floor:
                break
            members, block, summary = self.blocks(term)
            able = summary[:, terms].astype(np.int64) @ value
            for b in np.argsort(-able, kind="stable").tolist():
                if able[b] < floor:
                    break
                new = members[block == b]
                new = new[~seen[new]]
                if not len(new):
                    continue
                seen[new] = True
                found = self.scores(new, dense)
                good = found >= floor
                if good.any():
                    rows.append(new[good])
                    score = np.concatenate((score, found[good]))
                    if len(score) >= top:
                        floor = max(floor, int(np.partition(score, len(score) - top)[len(score) - top]))
        keep = score >= floor
        return np.concatenate(rows)[keep], score[keep]


def _impacts(n: np.ndarray, tf: np.ndarray, rows: int, length: int) -> np.ndarray:
    m = 75 + 25 * n * rows // length
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _search(forward: DataFrame, queries: list, weight: np.ndarray, floors: list[int], rows: int, length: int, top: int, kinds: tuple[str, str]) -> DataFrame:
    """(query, item, doc, score): per task the rows that can be among a query's best."""
    width = len(weight)
    shared = forward.sparkSession.sparkContext.broadcast((queries, weight, floors))
    shard_rows = max(256, min(4096, CELLS // max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, floors = shared.value
        best: list[list[tuple]] = [[] for _ in queries]
        floors = list(floors)

        def search(part: pa.Table) -> None:
            part = part.combine_chunks().to_batches()[0]
            terms = [np.frombuffer(v, np.int32) for v in part.column("terms").to_pylist()]
            size = np.array([len(t) for t in terms])
            tf = np.frombuffer(b"".join(part.column("tf").to_pylist()), np.int32).astype(np.int64)
            impact = _impacts(np.repeat(part.column("n").to_numpy(), size), tf, rows, length)
            shard = Shard(width, size, np.concatenate(terms).astype(np.int64), impact, weight)
            doc = part.column("doc")
            for q, (_, ids, times) in enumerate(queries):
                found, score = shard.search(ids, times * weight[ids], floors[q], top)
                if len(found) > top:  # ties with the last score: smallest ids first
                    place = np.empty(len(found), np.int64)
                    place[pc.sort_indices(doc.take(pa.array(found)), null_placement="at_end").to_numpy()] = np.arange(len(found))
                    pick = np.lexsort((place, -score))[:top]
                    found, score = found[pick], score[pick]
                if len(found):
                    both = best[q] + [(-s, d is None, d) for s, d in zip(score.tolist(), doc.take(pa.array(found)).to_pylist(), strict=True)]
                    best[q] = sorted(both, key=lambda r: r if r[2] is not None else (r[0], True, 0))[:top]
                    if len(best[q]) == top:
                        floors[q] = max(floors[q], -best[q][-1][0])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                held.append(batch.slice(at, shard_rows))
                n += held[-1].num_rows
                if n >= shard_rows:
                    search(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            search(pa.Table.from_batches(held))
        flat = [(q, queries[q][0], d, -s) for q, b in enumerate(best) for s, _, d in b]
        columns = [[r[i] for r in flat] for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], _arrow(kinds[0])), pa.array(columns[2], _arrow(kinds[1])), pa.array(columns[3], pa.int64())],
                                         ["query", "item", "doc", "score"])

    return map_arrow(forward, run, f"query int, item {kinds[0]}, doc {kinds[1]}, score bigint")


def _arrow(kind: str) -> pa.DataType | None:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each query with their rank, in two steps: groups first, so that no task gets all tasks' rows of a query."""
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    groups = max(2, math.isqrt(task_width(found.sparkSession)))
    first = found.withColumn("g", F.pmod(F.xxhash64("doc", "score"), F.lit(groups)))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("query", "g").orderBy(*order))).where(F.col("r") <= top).drop("g", "r")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best rows of ``docs`` for every row of ``items``, best first.

    Only rows with a score above 0 are ranked; equal scores are ordered by identifier, rows without one last. Null texts
    and texts without a term count as no document and find nothing; items without a term give no row, items that share
    an id are ranked each for itself, and an item without an id gives rows without one. Repeated rows are documents of
    their own. With more than ``query_terms`` terms in all items, the documents are scanned once per block of items.
    """
    asked = cut_lineage(_queries(items, item_id, item_text))
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-total // query_terms))
    kinds = (asked.schema["item"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString())
    done = []
    for k in range(n_blocks):
        part = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(n_blocks)) == k)
        got = [(r["item"], [bytes(t) for t in r["terms"]], r["times"]) for r in part.collect()]
        number = {t: i for i, t in enumerate(sorted({t for _, terms, _ in got for t in terms}))}
        queries = [(item, np.array([number[t] for t in terms]), np.array(times, np.int64)) for item, terms, times in got]
        forward = cut_lineage(_forward(docs, number, doc_id, text))
        rows, length = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = _frequencies(forward, len(number))
        weight = np.array([math.floor(1000 * math.log((2 * rows + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        floors, used = [1] * len(queries), forward.where(F.length("terms") > 0)
        args = (queries, weight), (rows, length or 1, top, kinds)
        if rows > FIRST_ROWS:
            sample = used.sample(max(FIRST_ROWS / rows, FIRST_SHARE), seed=11)
            last = _best(_search(sample, *args[0], floors, *args[1]), top).where(F.col("rank") == top).select("query", "score").collect()
            for r in last:  # one row a query
                floors[r["query"]] = max(1, r["score"])
        done.append(cut_lineage(_best(_search(used, *args[0], floors, *args[1]), top)))
        release(forward)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
