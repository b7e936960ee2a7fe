"""What the text operators share: reading, packing rows, Arrow tasks and word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow

#: Bytes of A-Z to a-z, nothing else (bytes.lower does the same; the table serves translate()).
LOWER = bytes(range(256)).lower()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no working column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(df: DataFrame, docs: DataFrame, row: str = "row", **replaced: Column) -> DataFrame:
    """The columns of ``docs`` out of the struct, some of them replaced."""
    field = F.col(row)
    return df.select(*[replaced.get(c, field.getField(c)).alias(c) for c in docs.columns])


def with_text(docs: DataFrame, text_col: str, text: Column) -> dict[str, Column]:
    """Replacements that put a new text into a row and keep ``n_chars``, where there is one, true."""
    out = {text_col: text}
    if "n_chars" in docs.columns and text_col != "n_chars":
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out


def raw(column: str) -> Column:
    """A text as its UTF-8 bytes: tasks that work on bytes are spared the decoding."""
    return F.col(f"`{column}`").cast("binary")


def arrow_task(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], Iterable[list] | None]) -> DataFrame:
    """``mapInArrow`` for a function that turns a batch into the columns of the result."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = rows(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return map_arrow(df, run, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column one by one, null as empty."""
    for value in column:
        yield value.as_py() or b""


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.lower().split()


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Rows of a table of keys (a few numbers each) that is broadcast at most.
BROADCAST_ROWS = 4_000_000


def bounded(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of keys for a join: broadcast if it has no more than ``rows`` rows, so that the other side need not be
    shuffled; larger ones are joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def sample_of(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the key: the same ones in every run."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 11) < int(rows / n * (1 << 53)))


def floats(values: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as binary values."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values, dtype=np.float32)], pa.binary())
