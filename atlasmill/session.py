"""Session construction and the few runtime helpers every job shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: set[str] = set()


def build_session(app_name: str = "atlasmill", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer.

    Shuffle partitions are left to the cluster's own setting (AQE coalesces
    them); pass ``**{"spark.sql.shuffle.partitions": n}`` to pin them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per context).

    Code that runs in tasks is imported there by name; the workers need not
    share the driver's working directory or search path.
    """
    context = spark.sparkContext
    if getattr(context, "_atlasmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="atlasmill-package-")) / "atlasmill.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._atlasmill_shipped = True


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with the package available to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only where the session names none and runs on one machine (unit tests) a
    scratch folder is used; a cluster without one is refused, since executors
    would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "atlasmill-checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    The result survives the loss of any executor, later plans start from a file
    scan, and their size estimates are the real file sizes (a checkpointed RDD
    would carry the estimates of its whole history along).
    """
    path = f"{shared_folder(df.sparkSession)}/atlasmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._atlasmill_path = path
    _WRITTEN.add(path)
    return out


def release(df: DataFrame) -> None:
    """Delete a table of :func:`cut_lineage` that a newer one has replaced."""
    path = getattr(df, "_atlasmill_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> int:
    """Delete every table this process has put into the shared folder.

    For the end of a job: frames built on those tables cannot be read afterwards.
    """
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.discard(path)


def task_width(spark: SparkSession) -> int:
    """How many tasks a hand-partitioned stage should be split into at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
