"""Resumable incremental jobs.

New rows arrive as files; every micro-batch drops identifiers already stored,
does the expensive step only for the rest and appends. An interrupted run picks
up where its checkpoint and the stored table say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.align import first_wins
from ..operators.embed import Model, embed
from ..sources.tables import append_absent


def run_incremental(
    spark: SparkSession,
    source: str,
    schema: str | T.StructType,
    target: str,
    checkpoint: str,
    work: Callable[[DataFrame], DataFrame],
    key: str = "identifier",
    order: list[str] | None = None,
    files_per_batch: int = 1000,
) -> None:
    """Process all files that are new since the last run, then stop.

    Within a batch the first row of a key wins; across batches stored keys win.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def step(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != key]
        fresh = first_wins(batch, key, order or rest)
        try:
            fresh = fresh.join(batch.sparkSession.read.parquet(target).select(key), key, "left_anti")
        except Exception as err:  # noqa: BLE001 - nothing stored yet
            if "PATH_NOT_FOUND" not in str(err):
                raise
        append_absent(batch.sparkSession, target, work(fresh), key)

    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def embed_incremental(spark: SparkSession, source: str, target: str, checkpoint: str, model: Model) -> None:
    """Embed sequences as they arrive, each identifier once."""
    run_incremental(
        spark, source, "identifier STRING, sequence STRING", target, checkpoint, lambda df: embed(df, model)
    )
