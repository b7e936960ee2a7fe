"""Repeated passages by content-defined chunking.

A gear hash over the last 32 bytes decides where a text is cut, so the cuts move with the content and an insertion
changes the chunks around it alone. Chunks are grouped by digest; the first occurrence (smallest id, then place)
stays. A passage counts as repeated if consecutive chunks that occurred before hold at least ``inner`` words and,
with the two partly shared chunks around them, ``outer`` words: common phrases and single lines stay untouched.
Words are what stands between ASCII white space, so repeated passages in scripts without blanks are out of reach,
however long they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow
from .common import arrow_task, packed, raw, texts, unpacked, with_text

#: A cut falls on one byte in 2**BITS, but no chunk is shorter than LEAST or longer than MOST bytes.
BITS, LEAST, MOST = 5, 12, 256
#: Words that wholly repeated chunks hold at least, and those with the chunks at both ends. A passage of 50 words may lose a
#: few word beginnings to the chunk before until the cuts agree, hence 46: of shared passages of 51 words 99 in 100 are found,
#: of 20 words one.
INNER, OUTER = 10, 46
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash (32 bits, hence 32 bytes of memory) after each byte: h = (h << 1) + gear[byte]."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # sums over 2k bytes from sums over k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text."""
    n, out, last = len(data), [], 0
    for at in [*(np.nonzero(gear(data) >> np.uint32(32 - bits) == 0)[0] + 1).tolist(), n]:
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least or (at == n and at > last):
            out.append(at)
            last = at
    return out


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, seq, start, stop, words, left, right, d1, d2): chunks with their digests.

    Offsets are bytes; ``words`` counts word beginnings inside, ``left`` and ``right`` those of the neighbours. A digest
    has 96 bits: one chance in 40,000 of any two alike among the chunks of 100 TB.
    """

    def rows(batch: pa.RecordBatch) -> list:
        owner, parts, digests = [], [], []
        for i, text_ in enumerate(texts(batch.column("t"))):
            if not text_:
                continue
            data = np.frombuffer(text_, np.uint8)
            ends = cuts(data)
            starts = [0, *ends[:-1]]
            blank = _SPACE[data]
            begins = np.concatenate(([0], np.cumsum(~blank & np.concatenate(([True], blank[:-1])))))
            words = np.diff(begins[[0, *ends]])
            owner.append(np.full(len(ends), i))
            parts.append(np.stack([np.arange(len(ends)), starts, ends, words, np.concatenate(([0], words[:-1])), np.concatenate((words[1:], [0]))]))
            digests += [xxhash.xxh3_128_digest(text_[a:b]) for a, b in zip(starts, ends, strict=True)]
        if not owner:
            return None
        pick = pa.array(np.concatenate(owner))
        both = np.frombuffer(b"".join(digests), np.dtype([("d1", "<i8"), ("d2", "<i4"), ("rest", "<i4")]))
        numbers = np.concatenate(parts, axis=1).astype(np.int32)
        return [batch.column("doc").take(pick), batch.column("version").take(pick), *numbers, both["d1"].copy(), both["d2"].copy()]

    frame = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"), raw(text).alias("t"))
    kind = frame.schema["doc"].dataType.simpleString()
    return arrow_task(frame, f"doc {kind}, version bigint, seq int, start int, stop int, words int, left int, right int, d1 bigint, d2 int", rows)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", inner: int = INNER, outer: int = OUTER) -> DataFrame:
    """(doc_id, version, start, stop, n_chunks, n_words, first_doc_id, first_start): one row per repeated passage.

    Offsets are bytes of the text. ``first_...`` is the earliest occurrence of the passage's first chunk. Rows alike in id and
    text are one document; documents without an id come last; null and empty texts have no chunk.
    """
    size = (F.col("stop") - F.col("start") - 1).alias("size")  # a byte, as the words are
    found = cut_lineage(chunks(docs, doc_id, text).select("doc", "version", "start", size, "words", "left", "right", "d1", "d2"))
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version", "start")
    shared = cut_lineage(
        found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") > 1)
        .select("d1", "d2", F.struct("first.doc", "first.version", "first.start").alias("first")))
    # every chunk is shuffled, so its numbers travel as one long
    chunk = F.col("start").cast("bigint")
    for column in ("size", "words", "left", "right"):
        chunk = F.shiftleft(chunk, 8).bitwiseOR(F.col(column).cast("bigint"))
    byte = lambda k: F.shiftright("chunk", k).bitwiseAND(F.lit(255))
    start = F.shiftright("chunk", 32).cast("int")
    stop = start + byte(24).cast("int") + 1
    again = found.select("doc", "version", chunk.alias("chunk"), "d1", "d2").join(shared, ["d1", "d2"]).where(
        ~F.struct("doc", "version", start).eqNullSafe(F.col("first")))
    by_doc = Window.partitionBy("doc", "version").orderBy("chunk")
    once = again.select("doc", "version", "chunk", "first", F.lag("chunk").over(by_doc).alias("before")).where(
        ~F.col("before").eqNullSafe(F.col("chunk")))  # without the chunks of repeated rows
    behind = once.withColumn("torn", F.coalesce(F.lag(stop).over(by_doc) != start, F.lit(True)).cast("int"))
    runs = behind.withColumn("run", F.sum("torn").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy("doc", "version", "run").agg(
        F.min(start).alias("start"), F.max(stop).alias("stop"), F.count("*").alias("n_chunks"), F.sum(byte(16)).alias("n_words"),
        F.min(F.struct("chunk", byte(8).alias("left"), "first")).alias("a"), F.max(F.struct("chunk", byte(0).alias("right"))).alias("b"))
    whole = F.col("n_words") + F.col("a.left") + F.col("b.right")
    return spans.where((F.col("n_words") >= inner) & (whole >= outer)).select(
        F.col("doc").alias("doc_id"), "version", "start", "stop", "n_chunks", "n_words",
        F.col("a.first.doc").alias("first_doc_id"), F.col("a.first.start").alias("first_start"))


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", inner: int = INNER, outer: int = OUTER) -> DataFrame:
    """All rows of ``docs``, later occurrences of repeated passages cut out of the texts (which may become empty)."""
    spans = repeated_spans(docs, doc_id, text, inner, outer).groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{doc_id}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("v"))
    spans = spans.withColumnRenamed("doc_id", "doc")
    joined = rows.join(spans, F.col("k").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, places in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if places and value is not None:
                    keep, at = [], 0
                    for p in places:
                        keep.append(value[at:p["start"]])
                        at = p["stop"]
                    value = b"".join([*keep, value[at:]])
                out.append(None if value is None else value.decode(errors="ignore"))
            yield batch.set_column(batch.schema.get_field_index("t"), "t", pa.array(out, pa.string()))

    slim = joined.select("row", F.when(F.col("spans").isNotNull(), F.col("row").getField(text).cast("binary")).alias("t"), "spans")
    done = map_arrow(slim, cut, f"row {slim.schema['row'].dataType.simpleString()}, t string, spans array<struct<start:int,stop:int>>")
    return unpacked(done, docs, **with_text(docs, text, F.coalesce("t", F.col("row").getField(text))))
