"""Structure files for a viewer: folders or ZIP archives of .pdb / .cif files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow

PATTERN = r"(?i)([^/]+)\.(pdb|cif)$"


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, kind, content) with base64 content; dots in the stem become underscores."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("path").rlike(PATTERN))
    return files.select(
        F.replace(F.regexp_extract("path", PATTERN, 1), F.lit("."), F.lit("_")).alias("identifier"),
        F.lower(F.regexp_extract("path", PATTERN, 2)).alias("kind"),
        F.base64("content").alias("content"),
    )


def read_structure_archives(spark: SparkSession, path: str) -> DataFrame:
    """The same from ZIP archives, one archive per task row."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(blob.as_py())) as archive:
                    for name in archive.namelist():
                        if name.lower().endswith((".pdb", ".cif")):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([name]), pa.array([archive.read(name)], pa.binary())], names=["path", "content"]
                            )

    files = map_arrow(archives, unpack, "path string, content binary")
    return files.select(
        F.replace(F.regexp_extract("path", PATTERN, 1), F.lit("."), F.lit("_")).alias("identifier"),
        F.lower(F.regexp_extract("path", PATTERN, 2)).alias("kind"),
        F.base64("content").alias("content"),
    )
