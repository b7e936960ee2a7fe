"""Shards of near-equal size by sampled splitters.

Rows are ordered by the hash of their text, then of their id. A sample in which each row's chance is its share of
all bytes gives quantile boundaries of many small ranges; boundaries lie between different texts unless one text
outweighs a range. The exact bytes of every range are then counted, overfull ranges are sampled again and
subdivided, and neighbouring ranges are joined to shards at the multiples of the mean. The driver sees the bounded
sample and one row per range; both sizes depend on the parameters, not on the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, map_arrow
from .common import arrow_task

#: Shards, ranges per shard, sampled keys per range, and rounds of subdivision.
SHARDS, RANGES, SAMPLE, ROUNDS = 24, 128, 32, 4
#: A range is overfull beyond this multiple of its share.
OVERFULL = 2.0


#: Low bits of the second key that tell rows of one id and text apart.
SALT = (1 << 24) - 1


def _keys(doc_id: str, text: str) -> dict[str, Column]:
    """Size, checksum and the two sort keys of a row: hash of the text; hash of the id, with low bits drawn per row.

    The drawn bits depend on the row's place in its file, so keys are read from a written table wherever they are used twice.
    """
    own = F.xxhash64(F.monotonically_increasing_id(), F.lit("row")).bitwiseAND(F.lit(SALT))
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return {"size": (F.octet_length(t) + 8).cast("bigint"), "text_crc32": F.crc32(t.cast("binary")), "h1": F.xxhash64(t), "h2": F.xxhash64(F.col(f"`{doc_id}`")).bitwiseAND(F.lit(~SALT)).bitwiseOR(own)}


@dataclass(frozen=True)
class Ranges:
    """Splitters (sorted pairs of hashes); a row's range is the number of splitters not above its pair."""

    h1: np.ndarray
    h2: np.ndarray

    def place(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.h1, h1, "left"), np.searchsorted(self.h1, h1, "right")
        inside = np.nonzero(high > low)[0]
        out = low.copy()  # rows of one hash may end where the splitters of the next begin
        for at in np.unique(low[inside]).tolist():
            rows = inside[low[inside] == at]
            out[rows] = at + np.searchsorted(self.h2[at:high[rows[0]]], h2[rows], "right")
        return out

    def with_more(self, pairs: list[tuple[int, int]]) -> Ranges:
        every = sorted(set(zip(self.h1.tolist(), self.h2.tolist(), strict=True)) | set(pairs))
        return Ranges(np.array([a for a, _ in every], np.int64), np.array([b for _, b in every], np.int64))


def _sample(keys: DataFrame, rows: int, total: int) -> np.ndarray:
    """(h1, h2, weight) of rows taken with a chance in proportion to their size, sorted."""
    chance = F.least(F.lit(1.0), F.col("size") * (rows / max(1, total)))
    draw = F.shiftrightunsigned(F.xxhash64("h1", "h2", F.lit("sample")), 11) / float(1 << 53)
    drawn = keys.where(draw < chance).select("h1", "h2", (F.col("size") / chance).alias("w")).toArrow()
    h1, h2, w = (drawn.column(c).to_numpy() for c in ("h1", "h2", "w"))
    order = np.lexsort((h2, h1))
    return h1[order], h2[order], w[order]


def _splitters(sample: tuple, ranges: int) -> list[tuple[int, int]]:
    """Quantiles of the sample; within a text only if it weighs more than a range."""
    h1, h2, w = sample
    if not len(h1):
        return []
    total, ends, out = w.sum(), np.cumsum(w), []
    for k in range(1, ranges):
        at = min(int(np.searchsorted(ends, total * k / ranges)), len(h1) - 1)
        first, behind = np.searchsorted(h1, h1[at], "left"), np.searchsorted(h1, h1[at], "right")
        whole = w[first:behind].sum() <= total / ranges
        out.append((int(h1[at]), -(1 << 63) if whole else int(h2[at])))
    return out


@dataclass(frozen=True)
class Plan:
    """Ranges with their shard and the rows before each in its shard."""

    ranges: Ranges
    shard: np.ndarray
    before: np.ndarray


def _placed(keys: DataFrame, ranges: Ranges) -> DataFrame:
    """``keys`` with the range of each row."""

    def run(batches):
        for batch in batches:
            at = ranges.place(batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
            yield batch.append_column("range", pa.array(at, pa.int32()))

    return map_arrow(keys, run, T.StructType([*keys.schema.fields, T.StructField("range", T.IntegerType())]))


def plan_shards(keys: DataFrame, shards: int = SHARDS, ranges: int = RANGES, sample: int = SAMPLE) -> Plan:
    """Splitters and their shards for rows with ``size``, ``h1`` and ``h2``."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    wanted = shards * ranges
    found = Ranges(np.empty(0, np.int64), np.empty(0, np.int64)).with_more(_splitters(_sample(keys, wanted * sample, total), wanted))
    for left in reversed(range(ROUNDS)):
        counted = _placed(keys, found).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        count = {r["range"]: (r["bytes"], r["rows"]) for r in counted}
        full = {k: b for k, (b, n) in count.items() if b > OVERFULL * total / wanted and n > 1}
        if not full or not left:
            break
        inside = _placed(keys, found).where(F.col("range").isin(list(full)))
        h1, h2, w = _sample(inside, min(wanted, ceil(sum(full.values()) * wanted / total)) * sample, sum(full.values()))
        place, more = found.place(h1, h2), []
        for k, size in full.items():
            mine = place == k
            more += _splitters((h1[mine], h2[mine], w[mine]), ceil(size * wanted / total))
        wider = found.with_more(more)
        if len(wider.h1) == len(found.h1):
            break  # single rows
        found = wider
    sizes = np.array([count.get(k, (0, 0)) for k in range(len(found.h1) + 1)], np.int64)
    middle = np.cumsum(sizes[:, 0]) - sizes[:, 0] / 2
    shard = np.minimum((middle * shards / max(1, total)).astype(np.int32), shards - 1)
    rows_before = np.cumsum(sizes[:, 1]) - sizes[:, 1]
    start = rows_before[np.searchsorted(shard, shard, "left")]
    return Plan(found, shard, rows_before - start)


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of ``docs``.

    ``size`` is the UTF-8 length of the text (null: none) plus 8. Slots count from 0 within a shard without gaps. Equal texts
    share a shard unless a boundary has to divide them, which it can at any row, even between rows alike in text and id. A row larger
    than a shard's share fills one alone, and with fewer rows than shards some stay empty.
    """
    keys = cut_lineage(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[v.alias(k) for k, v in _keys(doc_id, text).items()]))
    plan = plan_shards(keys, shards)
    from pyspark.sql import Window

    order = Window.partitionBy("range").orderBy("h1", "h2", F.col("doc_id").asc_nulls_first())
    numbered = _placed(keys, plan.ranges).select("doc_id", "size", "text_crc32", "range", F.row_number().over(order).alias("n"))

    def rows(batch: pa.RecordBatch) -> list:
        at = batch.column("range").to_numpy()
        slot = plan.before[at] + batch.column("n").to_numpy() - 1
        return [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), plan.shard[at], slot]

    kind = keys.schema["doc_id"].dataType.simpleString()
    done = arrow_task(numbered, f"doc_id {kind}, size bigint, text_crc32 bigint, shard int, slot bigint", rows)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write the rows of ``docs`` as Parquet, one folder ``_shard=k`` per shard; a range of a shard is one task's work."""
    keys = docs.select(*[v.alias(k) for k, v in _keys(doc_id, text).items()])
    plan = plan_shards(cut_lineage(keys), shards)
    names = [f"`{c}`" for c in docs.columns]

    @F.pandas_udf("int")
    def place(h1, h2):
        import pandas as pd

        return pd.Series(plan.ranges.place(h1.to_numpy(), h2.to_numpy()).astype(np.int32))

    k = _keys(doc_id, text)
    ranged = docs.select(*names, place(k["h1"], k["h2"]).alias("_range"))
    table = F.array(*[F.lit(int(s)) for s in plan.shard])
    ranged.repartition("_range").withColumn("_shard", F.element_at(table, F.col("_range") + 1)).drop("_range").write.partitionBy("_shard").parquet(path)
