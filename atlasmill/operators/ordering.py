"""Positions in a total order without numbering the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct usable inside any expression (a scalar subquery)."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


def with_position(df: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the given (total) order.

    A range sort spreads the rows over many tasks even when one key repeats;
    positions are local positions plus the sizes of the preceding partitions.
    """
    marked = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    sizes = sorted((r["p"], r["n"]) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    first, table = 0, []
    for p, n in sizes:
        table.append((p, first))
        first += n
    offsets = df.sparkSession.createDataFrame(table or [(0, 0)], "_p bigint, _first bigint")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(
        name, F.col("_first") + local
    ).drop("_p", "_first", "_m")


def position_in_group(df: DataFrame, group: list[str], order: list[Column | str], name: str = "pos") -> DataFrame:
    """0-based position within the group; a group may hold any share of the rows."""
    placed = with_position(df, [*group, *order], "_at")
    starts = placed.groupBy(*group).agg(F.min("_at").alias("_start"))
    return placed.join(starts, group).withColumn(name, F.col("_at") - F.col("_start")).drop("_at", "_start")


def dense_index(df: DataFrame, id_col: str) -> DataFrame:
    """(id, key) with keys 0..n-1 in identifier order."""
    return with_position(df.select(id_col), [id_col], "key")
