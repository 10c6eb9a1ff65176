"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a local session (tests) gets a temporary folder of its
    own; on a cluster that is an error, as other machines could not see it.
    """
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tilewright-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return "file://" + _local_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tilewright/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders of the columns
    ``by``, and read it back: cuts lineage, so a lost executor costs no more than
    the tasks it was running.  The step's shuffle files go when it is done;
    nothing reads them again."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for p in paths:
        hp = spark._jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that operators left in the shared folder.  Results that still
    read from it (numberings, token stores, media shards, states) must be done with."""
    drop_path(spark, f"{shared_dir(spark)}/tilewright")
