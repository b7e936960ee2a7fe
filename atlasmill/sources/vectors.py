"""Vector tables.

HDF5 has no Spark reader, so vector sets are Parquet (or any Spark format)
with one row per identifier; a set's name is given, stored in a ``model_name``
column, or refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.align import clean_vectors

VECTOR_SUFFIXES = (".parquet", ".pq")


def scan_vectors(spark: SparkSession, paths: list[str], id_col: str = "identifier", vec_col: str = "vec") -> DataFrame:
    """(identifier, vec, file_idx, row_idx) of all files in the given order.

    A (1, D) vector is squeezed; other nested shapes are refused because they
    are per-residue data.
    """
    frames = []
    for n, path in enumerate(paths):
        raw = spark.read.parquet(path)
        kind = raw.schema[vec_col].dataType
        vec = F.col(vec_col)
        if isinstance(kind.elementType, T.ArrayType):
            vec = F.when(F.size(vec) == 1, vec[0]).otherwise(
                F.raise_error(F.concat(F.lit("per-residue vectors for "), F.col(id_col).cast("string"))).cast(
                    kind.elementType
                )
            )
        frames.append(
            raw.select(
                F.col(id_col).cast("string").alias("identifier"),
                vec.cast("array<float>").alias("vec"),
                F.lit(n).alias("file_idx"),
                F.struct("_metadata.file_path", "_metadata.row_index").alias("row_idx"),
            )
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def load_vectors(spark: SparkSession, paths: list[str], name: str | None = None, id_col: str = "identifier", vec_col: str = "vec") -> DataFrame:
    """Cleaned embedding set: (embedding_set, identifier, vec)."""
    scanned = scan_vectors(spark, paths, id_col, vec_col)
    cleaned = clean_vectors(scanned)
    if cleaned.isEmpty():
        raise ValueError("No valid embeddings found.")
    return cleaned.select(F.lit(name or model_name(spark, paths)).alias("embedding_set"), "identifier", "vec")


def model_name(spark: SparkSession, paths: list[str]) -> str:
    """Name stored in the files' ``model_name`` column (first on conflict)."""
    for path in paths:
        raw = spark.read.parquet(path)
        if "model_name" in raw.columns:
            row = raw.select("model_name").filter("model_name is not null").first()
            if row:
                return row[0]
    raise ValueError(f"no model_name in {', '.join(paths)}; name the set with path:name")


def inspect_vectors(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Entries, dimension range and value range of a vector table."""
    return df.agg(
        F.count("*").alias("entries"),
        F.min(F.size(vec_col)).alias("dim_min"),
        F.max(F.size(vec_col)).alias("dim_max"),
        F.min(F.array_min(vec_col)).alias("value_min"),
        F.max(F.array_max(vec_col)).alias("value_max"),
    )


def similarity_edges(hits: DataFrame, headers: DataFrame) -> DataFrame:
    """Search hits ``(query, target, fident)`` -> symmetric edges ``(i, j, sim)``.

    Hits of unknown identifiers are dropped; the last reported value of a pair
    in either direction wins (by ``hit_idx`` if present, else the larger one).
    """
    from ..functions.scalars import parse_identifier

    order = F.col("hit_idx") if "hit_idx" in hits.columns else F.col("fident")
    known = headers.select("identifier").distinct()
    q = hits.select(parse_identifier("query").alias("i"), parse_identifier("target").alias("j"), F.col("fident").alias("sim"), order.alias("_o"))
    kept = q.join(known.withColumnRenamed("identifier", "i"), "i", "left_semi").join(
        known.withColumnRenamed("identifier", "j"), "j", "left_semi"
    )
    pair = kept.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "sim", "_o").groupBy("a", "b").agg(
        F.max_by("sim", "_o").alias("sim")
    )
    one = pair.select(F.col("a").alias("i"), F.col("b").alias("j"), "sim")
    return one.unionByName(pair.filter("a <> b").select(F.col("b").alias("i"), F.col("a").alias("j"), "sim"))


def subset_limit(total: int, share: float, maximum: int) -> int:
    """``min(maximum, ceil(share * total))``, at least 1."""
    import math

    return max(1, min(maximum, math.ceil(share * total)))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)

