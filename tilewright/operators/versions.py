"""Versions of a tile set behind one pointer.

``<root>/versions/<name>`` are published sets, ``<root>/CURRENT`` names the one in
use.  The pointer is replaced by one rename, so a reader sees the old version or
the new one and never neither; who has read it keeps the files of its version
until they are retired.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: beside its place, then renamed over what stands there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    target, own = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, tmp))
    system = target.getFileSystem(conf)
    target, own = system.makeQualified(target), system.makeQualified(own)
    out = system.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(own, target, options)
    except BaseException:
        system.delete(own, False)
        raise


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current(spark: SparkSession, root: str) -> str | None:
    """Name of the version in use."""
    name = f"{root}/CURRENT"
    return spark.read.text(name, wholetext=True).first()[0].strip() if _exists(spark, name) else None


def swap(spark: SparkSession, root: str, version: str) -> str | None:
    """Put a published version in use; the one that was.  A version that is not
    whole is an error and changes nothing."""
    if not _exists(spark, f"{root}/versions/{version}/COMPLETE"):
        raise ValueError(f"{version} was not published whole")
    before = current(spark, root)
    replace_text(spark, f"{root}/CURRENT", version)
    return before


def publish_version(tiles: DataFrame, metadata: DataFrame, root: str, source: str = "") -> tuple[str, str | None]:
    """Publish a set as a new version and put it in use: (its name, the one before)."""
    from tilewright.operators.tileset import publish

    spark = tiles.sparkSession
    version = uuid.uuid4().hex[:12]
    publish(tiles, metadata, f"{root}/versions/{version}", source=source)
    return version, swap(spark, root, version)


def current_tiles(spark: SparkSession, root: str) -> DataFrame:
    """Tiles of the version in use now; the result stays with that version."""
    from tilewright.operators.tileset import read_tiles

    version = current(spark, root)
    if version is None:
        raise ValueError(f"{root} has no version in use")
    return read_tiles(spark, f"{root}/versions/{version}")


def retire(spark: SparkSession, root: str) -> int:
    """Delete the versions that are not in use; how many went."""
    keep = current(spark, root)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in system.listStatus(p) if s.getPath().getName() != keep]
    for path in gone:
        system.delete(path, True)
    return len(gone)
