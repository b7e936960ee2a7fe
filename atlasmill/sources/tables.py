"""Annotation tables, JSON result pages and size reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.align import last_wins, overlay_outer
from ..operators.ordering import one_row


def read_custom_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV by suffix; the first column is the identifier, its last row wins."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    raw = spark.read.csv(path, sep=sep, header=True, multiLine=False, quote='"', escape='"')
    raw = raw.withColumnRenamed(raw.columns[0], "identifier")
    marked = raw.withColumn("_row", F.monotonically_increasing_id())
    return last_wins(marked, "identifier", ["_row"]).drop("_row")


def read_custom_tables(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    out = None
    for path in paths:
        table = read_custom_table(spark, path)
        out = table if out is None else overlay_outer(out, table)
    return out


def read_result_pages(spark: SparkSession, path: str, element_schema: str) -> DataFrame:
    """Paged JSON results (``{"results": [...]}`` per file) as one row per result."""
    pages = spark.read.option("multiLine", True).schema(f"results array<{element_schema}>").json(path)
    return pages.select(F.explode("results").alias("result"))


def write_annotations(df: DataFrame, path: str) -> None:
    """CSV when the path says so, else Parquet; an empty table keeps its header."""
    if path.lower().endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)


def append_absent(spark: SparkSession, path: str, new: DataFrame, key: str = "identifier") -> None:
    """Insert rows whose key the stored table lacks."""
    try:
        done = spark.read.parquet(path).select(key)
        new = new.join(done, key, "left_anti")
    except Exception as err:  # noqa: BLE001 - the path may not exist yet
        if "PATH_NOT_FOUND" not in str(err):
            raise
    new.write.mode("append").parquet(path)


def wide_from_maps(df: DataFrame, names: list[str], id_col: str = "identifier", map_col: str = "annotations") -> DataFrame:
    """Open key maps -> the requested columns ('' where a key is absent)."""
    return df.select(id_col, *[F.coalesce(F.try_element_at(map_col, F.lit(n)), F.lit("")).alias(n) for n in names])


def maps_from_wide(df: DataFrame, id_col: str = "identifier") -> DataFrame:
    pairs = [x for c in df.columns if c != id_col for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(id_col, F.create_map(*pairs).alias("annotations"))


def length_report(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """Count, shortest, upper median and longest sequence.

    The median is the element at position n // 2 of the ascending lengths,
    found on the (small) histogram of lengths.
    """
    hist = df.groupBy(F.length(seq_col).alias("len")).agg(F.count("*").alias("n"))
    total = hist.agg(F.sum("n").alias("total"), F.min("len").alias("min_len"), F.max("len").alias("max_len"))
    fact = one_row(total)
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    mid = hist.withColumn("upto", upto).filter(F.col("upto") > F.floor(fact["total"] / 2)).agg(F.min("len").alias("median_len"))
    return total.select(F.col("total").alias("n"), "min_len", one_row(mid)["median_len"].alias("median_len"), "max_len")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables as one result."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("entries")).select(F.lit(name).alias("dataset"), "entries")
        out = one if out is None else out.unionByName(one)
    return out
