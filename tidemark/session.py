"""Session helpers: stage tables in the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession, folder: str | None = None) -> str:
    """Folder for stage tables: the given one, the cluster's ``spark.checkpoint.dir``, or the context's.

    Only a local session, whose one process is driver and executor, may use a scratch
    folder of its own; on a cluster a missing setting is an error at once.
    """
    named = folder or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
        return context.getCheckpointDir()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path in the shared folder."""
    path = f"{checkpoint_dir(spark, folder)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, folder: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, so that several jobs can read it.

    The lineage ends there: a lost executor costs a read, not the whole plan. The
    table knows its size and columns, so later joins can broadcast it when it is
    small and read only what they need. Rows are filed by the values of ``by``, which
    are few: a filter on them reads its own folders only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage", folder)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


_shared: dict[tuple, tuple] = {}


def shared_stage(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of this application read: built and written by the first of them.

    ``key`` names all that the table depends on, the folder of its inputs included; ``release_stages`` forgets it.
    """
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _shared:
        path = scratch_path(spark, "shared")
        df = build()
        df.write.parquet(path)
        _shared[whole] = (path, df.schema)
    path, schema = _shared[whole]
    return spark.read.schema(schema).parquet(path)


def release_stages(spark: SparkSession) -> int:
    """Delete the stage tables of this application; call it when the results built on them are written. Returns how many."""
    application = spark.sparkContext.applicationId
    paths = _written.pop(application, [])
    for key in [key for key in _shared if key[0] == application]:
        del _shared[key]
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
