"""Removal of benchmark passages: a broadcast set of normalised word windows, scanned over every document.

Windows are made in Spark and sent out in blocks of a fixed number of windows; the benchmark usually fits one.
A larger benchmark is scanned block by block, with the same result. A window is looked up by a hash of its word
numbers at those places only where all its words belong to the block's vocabulary, and every hit is compared word
for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, map_arrow
from .common import arrow_task, packed, raw, texts, unpacked, with_text

#: Words of a window; windows sent to the tasks at once; share of hit words from which a document goes as a whole.
WINDOW, BLOCK, DROP_SHARE = 10, 200_000, 0.5
#: Bytes to lower case; all but digits, letters and non-ASCII bytes to blanks.
_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, win, item): each window of each item, words joined by a blank, with a number (hash) and the item's id as text; written.

    Items without an id have windows like others; their ``item`` is null.
    """

    def rows(batch: pa.RecordBatch) -> list:
        out = []
        for item, value in zip(batch.column("item").to_pylist(), texts(batch.column("t")), strict=True):
            words = words_of(value)
            out += [(item, b" ".join(words[i:i + window])) for i in range(max(1, len(words) - window + 1))] if words else []
        return [pa.array([i for i, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary())]

    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), raw(text).alias("t"))
    return cut_lineage(arrow_task(items, "item string, words binary", rows).distinct().withColumn("win", F.xxhash64("words")))


class Scanner:
    """Finds the windows of one block."""

    def __init__(self, block: list[tuple[bytes, int]]):
        vocabulary = sorted({w for words, _ in block for w in words.split()})
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.known: dict[int, dict[tuple, int]] = {}
        for words, win in block:
            key = tuple(self.number[w] for w in words.split())
            self.known.setdefault(len(key), {})[key] = win
        self.hashes = {n: np.unique(self._hash(np.array(list(keys), np.uint64))) for n, keys in self.known.items()}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            h = h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
        return h

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches of words (first, behind the last) in order, not overlapping, and the windows' numbers."""
        numbers = np.fromiter(map(self.number.get, words, repeat(0)), np.uint64, len(words))
        total = np.concatenate(([0], np.cumsum(numbers > 0)))
        hit, wins = np.zeros(len(words) + 1, np.int64), set()
        for n, known in self.known.items():
            if len(words) < n:
                continue
            at = np.nonzero(total[n:] - total[:-n] == n)[0]
            for part in np.array_split(at, len(at) // 65_536 + 1):
                rows = numbers[part[:, None] + np.arange(n)]
                for i in np.nonzero(np.isin(self._hash(rows), self.hashes[n]))[0].tolist():
                    found = known.get(tuple(rows[i].tolist()))
                    if found is not None:
                        wins.add(found)
                        hit[part[i]] += 1
                        hit[part[i] + n] -= 1
        inside = np.concatenate(([False], np.cumsum(hit)[:-1] > 0, [False]))
        edges = np.nonzero(inside[1:] != inside[:-1])[0]
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), wins


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scan(docs: DataFrame, block: list) -> DataFrame:
    """(doc, version, n_words, spans, wins) of every row, for one block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            count, spans, wins = [], [], []
            for text in texts(batch.column("t")):
                words = words_of(text)
                found, ids = scanner.scan(words)
                count.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in found])
                wins.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("version"), pa.array(count, pa.int64()), pa.array(spans, _SPANS), pa.array(wins, pa.list_(pa.int64()))],
                ["doc", "version", "n_words", "spans", "wins"])

    return map_arrow(docs, run, f"doc {kind}, version bigint, n_words bigint, spans array<struct<a:bigint,b:bigint>>, wins array<bigint>")


def _blocks(found: DataFrame, size: int) -> Iterator[list]:
    """The distinct windows, without items: what goes to the tasks does not depend on how many items share one."""
    distinct = found.select("words", "win").distinct()
    n = max(1, -(-distinct.count() // size))
    for i in range(n):
        part = distinct if n == 1 else distinct.where(F.pmod("win", F.lit(n)) == i)
        yield [(bytes(r["words"]), r["win"]) for r in part.collect()]


def _found(docs: DataFrame, known: DataFrame, doc_id: str, text: str, block: int) -> DataFrame:
    """(doc, version, n_words, spans, wins) per row of ``docs``, over all blocks."""
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"), raw(text).alias("t"))
    scans = [cut_lineage(_scan(frame, part)) for part in _blocks(known, block)]
    if len(scans) == 1:
        return scans[0]
    # rows alike in id and text have equal findings: one of them stands for all
    hit = reduce(DataFrame.unionByName, [s.where(F.size("wins") > 0).dropDuplicates(["doc", "version"]) for s in scans[1:]])
    more = hit.groupBy("doc", "version").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("wins")).alias("also"))
    first = scans[0].alias("f")
    both = first.join(more.alias("m"), F.col("f.doc").eqNullSafe(F.col("m.doc")) & (F.col("f.version") == F.col("m.version")), "left")
    spans = F.coalesce("m.more", F.array().cast(scans[0].schema["spans"].dataType))
    return cut_lineage(both.select("f.doc", "f.version", "n_words", _union(F.concat("spans", spans)).alias("spans"),
                                   F.array_union("wins", F.coalesce("also", F.array().cast("array<bigint>"))).alias("wins")))


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc, version, n_words, spans, items) per row of ``docs``: word positions inside benchmark windows, and the items.

    Null and empty texts have no words; items without a word hold no window. Windows of items without an id are found
    like others, but such items are not listed. Several items may share an id. With more windows than ``block`` the
    documents are scanned once per block and the findings joined. Windows meet their items in a join.
    """
    known = windows(benchmark, item_id, item_text, window)
    found = _found(docs, known, doc_id, text, block)
    pairs = found.select("doc", "version", F.explode("wins").alias("win")).distinct()
    named = pairs.join(known.where("item is not null").select("win", "item"), "win").select("doc", "version", "item").distinct()
    listed = named.groupBy(F.col("doc").alias("d"), F.col("version").alias("v")).agg(F.sort_array(F.collect_list("item")).alias("listed"))
    joined = found.join(listed, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return joined.select("doc", "version", "n_words", "spans", F.coalesce("listed", F.array().cast("array<string>")).alias("items"))


@F.udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])), useArrow=True)
def _merged(spans):
    out = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _union(spans):
    return F.when(F.size(spans) < 2, spans).otherwise(_merged(spans))


def report(found: DataFrame) -> DataFrame:
    """Counts per row of :func:`hits`: words, hit words, items, digest of the item ids."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["b"] - s["a"])
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the stretches from the first to the last byte of the hit words."""
    places = [m.span() for m in _WORD.finditer(text.translate(_TABLE).translate(bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_share: float = DROP_SHARE,
                  window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` without benchmark passages: hit stretches are cut out of the texts, and a document goes if more than
    ``drop_share`` of its words are hit. Rows that are not hit come back as they are (null and empty texts too)."""
    found = _found(docs, windows(benchmark, window=window), doc_id, text, block)
    found = cut_lineage(found.where(F.size("spans") > 0).select("doc", "version", "n_words", "spans").dropDuplicates(["doc", "version"]))
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{doc_id}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("v"))
    joined = rows.join(found, F.col("k").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["b"] - s["a"])
    left = joined.where(F.col("spans").isNull() | (n_hit <= F.lit(drop_share) * F.col("n_words")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [value if not spans or value is None else _cut(value.encode(), [(s["a"], s["b"]) for s in spans]).decode(errors="replace")
                   for value, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("t"), "t", pa.array(out, pa.string()))

    slim = left.select("row", F.when(F.col("spans").isNotNull(), F.col("row").getField(text)).alias("t"), "spans")
    done = map_arrow(slim, cut, slim.schema)
    return unpacked(done, docs, **with_text(docs, text, F.coalesce("t", F.col("row").getField(text))))
