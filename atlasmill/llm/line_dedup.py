"""Removal of boilerplate lines by the number of distinct sites that carry them.

One HyperLogLog sketch of the sites per line hash is built by an aggregate (partial sketches are merged
map-side, so a line that a third of all rows hold sends one sketch per task). The estimate decides where it is
clearly above or below the threshold; lines inside the error band get their sites counted exactly. What is
removed is every later occurrence of a line that enough sites carry: the first one (smallest document, then
smallest position) stays, so no content leaves the corpus altogether.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow
from .common import packed, unpacked, with_text

#: Sites from which a line counts as boilerplate, and log2 of the sketch's registers.
MIN_SITES, LG_REGISTERS = 10, 11


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """(doc, version, site, pos, line): one row per line that is not blank, without blanks at its ends."""
    return (
        docs.select(
            F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"),
            F.col(f"`{site}`").cast("string").alias("site"), F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("pos", "line"),
        )
        .withColumn("line", F.btrim("line", F.lit(" \t\r")))
        .where(F.col("line") != "")
        .select("doc", "version", "site", "pos", F.xxhash64("line").alias("line"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(line, first): hashes of lines on at least ``min_sites`` distinct sites, and where each comes first."""
    error = 3 * 1.04 / math.sqrt(1 << lg_registers)
    low, high = math.floor(min_sites * (1 - error)) - 1, math.ceil(min_sites * (1 + error)) + 1
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version", "pos")
    spread = cut_lineage(
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(lg_registers)).alias("sketch"), F.min(place).alias("first"))
        .select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= low)
    )
    unsure = spread.where(F.col("sites") <= high).select("line")
    exact = (
        lines.join(unsure, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
        .groupBy("line").agg(F.count("site").alias("exact")).where(F.col("exact") >= min_sites)
    )
    sure = spread.where(F.col("sites") > high).select("line", "first")
    return sure.unionByName(spread.where(F.col("sites") <= high).join(exact, "line", "left_semi").select("line", "first"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines at the listed positions."""
    for batch in batches:
        out = []
        for text, bad in zip(batch.column("text").to_pylist(), batch.column("bad").to_pylist(), strict=True):
            if text is not None and bad:
                drop = set(bad)
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
            out.append(text)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array(out, pa.string()))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
             min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(doc, version, bad): positions of the lines to remove; ``version`` is the hash of the text."""
    lines = _lines(docs, doc_id, text, site)
    found = cut_lineage(boilerplate(lines, min_sites, lg_registers))
    here = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version", "pos")
    return (
        lines.join(found, "line").where(~here.eqNullSafe(F.col("first")))
        .groupBy("doc", "version").agg(F.collect_set("pos").alias("bad"))
    )


def clean_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
                min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS, extra: dict[str, Column] | None = None) -> DataFrame:
    """All rows of ``docs`` with boilerplate lines taken out of their texts (and ``n_chars`` adjusted).

    A document may end up with an empty text; it is kept. Null texts stay null, blank lines never count, a null
    site adds nothing to a line's spread, rows alike in id and text are one document, and a document without an
    id comes after all others. ``extra`` adds columns made of ``row`` (the old row), ``text`` (new) and ``bad``.
    """
    bad = removals(docs, doc_id, text, site, min_sites, lg_registers)
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{doc_id}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("v"),
                       F.col(f"`{text}`").alias("text"))
    joined = rows.join(bad, F.col("k").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")), "left")
    # the old text need not travel twice
    slim = joined.select(F.col("row").dropFields(f"`{text}`").alias("row"), "text", "bad") if len(docs.columns) > 1 else joined.select("row", "text", "bad")
    done = map_arrow(slim, _without, slim.schema)
    replaced = with_text(docs, text, F.col("text"))
    keep = [replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*keep, *[v.alias(k) for k, v in (extra or {}).items()])
