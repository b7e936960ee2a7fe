"""Aligning embedding sets and overlaying keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_identifier
from .ordering import dense_index, one_row


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate rather than a sorted window: rows of a key are reduced on the
    map side, so a key holding a third of the table is no hot spot.
    """
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*").select(df.columns)


def first_row(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the first in the order in which the table is read."""
    return first_wins(df.withColumn("_read", F.monotonically_increasing_id()), key, ["_read"]).drop("_read")


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*").select(df.columns)


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).agg(
        F.count("*").alias("n_unique"),
        F.sum("copies").alias("n_rows"),
        F.sum(F.col("copies") - 1).alias("n_duplicates"),
    )


def has_nan(vec: Column | str) -> Column:
    return F.exists(F.col(vec) if isinstance(vec, str) else vec, lambda v: v.isNull() | F.isnan(v))


def clean_vectors(df: DataFrame, key: str = "identifier", vec: str = "vec", order: list[str] = ("file_idx", "row_idx")) -> DataFrame:
    """Loader rules: first key wins, the first vector fixes the length, others are
    skipped, vectors with NaN are dropped."""
    order = list(order)
    dim = df.agg(F.min_by(F.size(vec), F.struct(*order)).alias("_dim"))
    sized = df.filter(F.size(vec) == one_row(dim)["_dim"])
    return first_wins(sized, key, order).filter(~has_nan(vec))


def union_same_name(sets: DataFrame, key: str = "identifier", vec: str = "vec", order: list[str] = ("set_idx", "row_idx")) -> DataFrame:
    """Union of sets that share a name; equal copies collapse, conflicting ones fail.

    Every copy is compared with the first one: ``|a - b| <= 1e-6 + 1e-5 |b|``.
    """
    order = list(order)
    dims = sets.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi"))
    firsts = first_wins(sets, key, order).withColumnRenamed(vec, "_first")
    others = sets.select(key, F.col(vec).alias("_copy"))
    close = lambda a, b: F.abs(a - b) <= F.lit(1e-6) + F.lit(1e-5) * F.abs(b)
    verdict = (
        others.join(firsts.select(key, "_first"), key)
        .withColumn("_ok", F.forall(F.zip_with("_first", "_copy", close), lambda x: x))
        .groupBy(key)
        .agg(F.min("_ok").alias("_ok"))
    )
    checked, dim = firsts.join(verdict, key), one_row(dims)
    guard = (
        F.when(dim["lo"] != dim["hi"], F.raise_error(F.lit("embedding sets differ in dimension")))
        .when(~F.col("_ok"), F.raise_error(F.concat(F.lit("conflicting embeddings for "), F.col(key).cast("string"))))
        .otherwise(F.col("_first"))
    )
    return checked.withColumn(vec, guard).select(sets.columns)


def intersect_ids(sets: list[DataFrame], key: str = "identifier") -> DataFrame:
    """Rows of the first set whose key occurs in all the others."""
    out = sets[0]
    for other in sets[1:]:
        out = out.join(other.select(key).distinct(), key, "left_semi")
    return out


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def missing_ids(wanted: DataFrame, present: DataFrame, key: str = "identifier") -> DataFrame:
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def overlay_left(base: DataFrame, extra: DataFrame, key: str = "identifier", order: list[str] | None = None) -> DataFrame:
    """Left join in which ``extra`` replaces columns of the same name.

    A replaced column takes the extra value even when that is NULL, so rows
    without a match lose the base value. One row per key of ``extra`` is used
    (the first in ``order``, or else the first read).
    """
    one = first_wins(extra, key, order) if order else first_row(extra, key)
    clash = [c for c in one.columns if c != key and c in base.columns]
    return base.drop(*clash).join(one, key, "left")


def overlay_outer(earlier: DataFrame, later: DataFrame, key: str = "identifier") -> DataFrame:
    """Full outer join in which columns of the later table replace earlier ones."""
    clash = [c for c in later.columns if c != key and c in earlier.columns]
    return earlier.drop(*clash).join(later, key, "outer")


def attach_to_headers(headers: DataFrame, metadata: DataFrame, key: str = "identifier") -> DataFrame:
    """One output row per header; text columns, '' where nothing is known. Of several metadata rows the first read counts."""
    meta = first_row(metadata, key)
    cols = [c for c in meta.columns if c != key]
    joined = headers.join(meta, key, "left")
    return joined.select(*headers.columns, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])


def spread_nulls(key: Column | str, by: Column | str, prefix: str = "\u0000") -> Column:
    """A join key whose NULLs are spread over many values that match nothing.

    Rows without a key would otherwise all meet in one task of an outer join.
    """
    key = F.col(key) if isinstance(key, str) else key
    by = F.col(by) if isinstance(by, str) else by
    return F.coalesce(key, F.concat(F.lit(prefix), F.pmod(F.xxhash64(by), F.lit(4096)).cast("string")))


def replace_column(base: DataFrame, values: DataFrame, column: str, key: str = "identifier") -> DataFrame:
    """Replace a column by a keyed lookup; a row without a value is an error."""
    found = values.select(key, F.col(column).alias("_new"))
    value = F.when(F.col("_new").isNull(), F.raise_error(
        F.concat(F.lit(f"no {column} for "), F.col(key).cast("string"))
    ).cast(values.schema[column].dataType)).otherwise(F.col("_new"))
    joined = base.join(found, key, "left").withColumn(column, value).drop("_new")
    return joined.select(*base.columns, *([] if column in base.columns else [column]))


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def unique_sequences(df: DataFrame, id_col: str = "identifier", seq_col: str = "sequence") -> DataFrame:
    """Distinct sequences with one representative id, for work that is paid per sequence."""
    return df.groupBy(seq_col).agg(F.min(id_col).alias("representative"), F.count("*").alias("copies"))


def fan_out(results: DataFrame, df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """Per-sequence results back to every row that has the sequence.

    Joined on a digest instead of the (long) text; rows with one hot sequence
    are split by adaptive skew handling because the other side has one row each.
    """
    digest = F.sha2(F.col(seq_col).cast("binary"), 256).alias("_digest")
    return df.withColumn("_digest", digest).join(
        results.withColumn("_digest", digest).drop(seq_col), "_digest"
    ).drop("_digest")


def batch_ids(df: DataFrame, order: str, size: int) -> DataFrame:
    """Positional batches of ``size`` rows in the given order.

    Positions come from a range sort plus per-partition offsets, so no single
    task numbers the whole table.
    """
    index = dense_index(df, order).withColumnRenamed("key", "_pos")
    return df.join(index, order).withColumn("batch", F.floor(F.col("_pos") / F.lit(size)).cast("long")).drop("_pos")


def remaining(requested: DataFrame, done: DataFrame, key: str = "identifier") -> DataFrame:
    """What an interrupted job still has to process."""
    return requested.join(done.select(key), key, "left_anti")


def normalized_ids(df: DataFrame, key: str = "identifier") -> DataFrame:
    return df.withColumn(key, parse_identifier(key))


def mean_pool(df: DataFrame, residues: str = "residues", out: str = "vec") -> DataFrame:
    """Mean over a list of per-residue vectors held in one row."""
    zero = F.transform(F.col(residues)[0], lambda v: F.lit(0.0))
    total = F.aggregate(
        F.col(residues),
        zero,
        lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b.cast("double")),
        lambda acc: F.transform(acc, lambda v: v / F.size(residues)),
    )
    return df.withColumn(out, total).drop(residues)


def mean_pool_rows(df: DataFrame, id_col: str = "identifier", vec_col: str = "vec") -> DataFrame:
    """Mean vector per identifier when every residue is a row.

    Averages are taken per position with map-side combine, so an identifier may
    have any number of residues.
    """
    cells = df.select(id_col, F.posexplode(vec_col).alias("pos", "v"))
    means = cells.groupBy(id_col, "pos").agg(F.avg("v").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(id_col).agg(F.transform(ordered, lambda e: e["m"]).alias(vec_col))
