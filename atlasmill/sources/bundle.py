"""Output tables as Parquet folders, and the packed single-file exchange format.

The tables are written by Spark. The exchange file is only made on request for
results small enough to be opened by a viewer, which is checked.
"""

from __future__ import annotations

import io
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Separator and part names of the exchange format.
DELIMITER = b"---PARQUET_DELIMITER---"
PART_NAMES = ["selected_annotations.parquet", "projections_metadata.parquet", "projections_data.parquet"]
SETTINGS_NAME = "settings.parquet"
MAX_PACK_ROWS = 5_000_000
INTERNAL_COLUMNS = ("organism_id", "sequence")


def annotations_output(metadata: DataFrame, id_col: str = "identifier") -> DataFrame:
    """Text columns, identifier as ``protein_id``, internal columns dropped, NULL as ''."""
    kept = [c for c in metadata.columns if c != id_col and c not in INTERNAL_COLUMNS]
    return metadata.select(
        F.col(id_col).alias("protein_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kept]
    )


def projection_rows(coords: DataFrame, name: str, dims: int, id_col: str = "identifier") -> DataFrame:
    """(projection_name, identifier, x, y, z) of one projection."""
    z = F.col("coords")[2].cast("float") if dims == 3 else F.lit(None).cast("float")
    return coords.select(
        F.lit(name).alias("projection_name"), F.col(id_col).cast("string").alias("identifier"),
        F.col("coords")[0].cast("float").alias("x"), F.col("coords")[1].cast("float").alias("y"), z.alias("z"),
    )


def metadata_rows(spark: SparkSession, entries: list[tuple[str, int, dict]]) -> DataFrame:
    rows = [(n, d, json.dumps(info, default=str)) for n, d, info in entries]
    return spark.createDataFrame(rows, "projection_name string, dimensions int, info_json string")


def write_tables(folder: str, annotations: DataFrame, metadata: DataFrame, data: DataFrame, settings: dict | None = None) -> None:
    for name, df in zip(PART_NAMES, (annotations, metadata, data)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if settings is not None:
        settings_frame(annotations.sparkSession, settings).write.mode("overwrite").parquet(f"{folder}/{SETTINGS_NAME}")


def settings_frame(spark: SparkSession, settings: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(settings),)], "settings_json string")


def read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, dict | None]:
    parts = [spark.read.parquet(f"{folder}/{n}") for n in PART_NAMES]
    try:
        settings = json.loads(spark.read.parquet(f"{folder}/{SETTINGS_NAME}").first()[0])
    except Exception as err:  # noqa: BLE001 - settings are optional
        if "PATH_NOT_FOUND" not in str(err):
            raise
        settings = None
    return (*parts, settings)


def bundle_path(path: str) -> str:
    """A suffix is coerced; a folder gets the default file name."""
    stem, ext = os.path.splitext(path)
    if ext == ".parquetbundle":
        return path
    return f"{stem}.parquetbundle" if ext else os.path.join(path, "data.parquetbundle")


def _parquet_bytes(table: pa.Table) -> bytes:
    buffer = io.BytesIO()
    pq.write_table(table, buffer)
    return buffer.getvalue()


def pack(path: str, annotations: DataFrame, metadata: DataFrame, data: DataFrame, settings: dict | None = None) -> str:
    """Write the exchange file; refused beyond ``MAX_PACK_ROWS`` rows."""
    rows = annotations.count() + data.count()
    if rows > MAX_PACK_ROWS:
        raise ValueError(f"{rows} rows are too many for one exchange file; use write_tables")
    parts = [_parquet_bytes(df.toArrow()) for df in (annotations, metadata, data)]
    if settings is not None:
        parts.append(_settings_bytes(settings))
    target = bundle_path(path)
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    with open(target, "wb") as handle:
        handle.write(DELIMITER.join(parts))
    return target


def _settings_bytes(settings: dict) -> bytes:
    return _parquet_bytes(pa.table({"settings_json": [json.dumps(settings)]}))


def split_parts(content: bytes) -> list[bytes]:
    parts = content.split(DELIMITER)
    if len(parts) not in (3, 4):
        raise ValueError(f"Expected 3 or 4 parts in a bundle, found {len(parts)}")
    return parts


def read_parts(path: str) -> tuple[list[bytes], dict | None]:
    with open(path, "rb") as handle:
        parts = split_parts(handle.read())
    settings = json.loads(pq.read_table(io.BytesIO(parts[3]))["settings_json"][0].as_py()) if len(parts) == 4 and parts[3] else None
    return parts[:3], settings


def unpack(path: str, folder: str) -> str:
    """Exchange file -> one Parquet file per part."""
    parts, settings = read_parts(path)
    os.makedirs(folder, exist_ok=True)
    for name, blob in zip(PART_NAMES, parts):
        with open(os.path.join(folder, name), "wb") as handle:
            handle.write(blob)
    if settings is not None:
        with open(os.path.join(folder, SETTINGS_NAME), "wb") as handle:
            handle.write(_settings_bytes(settings))
    return folder


def replace_settings(source: str, target: str, settings: dict) -> None:
    """Append or replace the settings part; the core parts stay byte for byte."""
    with open(source, "rb") as handle:
        parts = handle.read().split(DELIMITER)
    if len(parts) < 3:
        raise ValueError(f"Expected at least 3 parts in a bundle, found {len(parts)}")
    with open(target, "wb") as handle:
        handle.write(DELIMITER.join([*parts[:3], _settings_bytes(settings)]))


def count_entries(path: str) -> int:
    """Rows of the first part, from its footer."""
    with open(path, "rb") as handle:
        head = handle.read().split(DELIMITER, 1)[0]
    return pq.ParquetFile(io.BytesIO(head)).metadata.num_rows


def inspect(spark: SparkSession, folder: str, head: int = 5) -> dict:
    out = {}
    for name, df in zip(PART_NAMES, read_tables(spark, folder)[:3]):
        out[name] = {"schema": df.schema.simpleString(), "rows": df.count(), "head": df.limit(head).collect()}
    return out
