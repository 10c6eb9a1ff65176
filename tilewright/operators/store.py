"""A store of tile subsets by dataset and revision, and whole synchronisations.

``<path>/tiles`` is Parquet by dataset key, revision key and zoom;
``<path>/manifests`` has one JSON file for each dataset, replaced by one rename
when a revision is complete, so readers see the old revision until then.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import sync
from tilewright.operators.versions import replace_text

TILES = "z int, x long, y long, data binary, checksum string, dkey string, rkey string"


#: Seconds between two reports of a running download.
EVERY_S = 2.0


def _key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    dataset: str
    revision: str
    tile_url_template: str
    format_version: int = 1
    coordinate_system: str = "TMS"
    content_type: str = ""
    content_encoding: str = ""
    created_at: str = ""

    def check(self, spark: SparkSession) -> None:
        row = spark.createDataFrame([asdict(self)])
        problem = row.select(sync.manifest_problem().alias("p")).first().p
        if problem:
            raise ValueError(f"the manifest's {problem} is not valid")


@dataclass(frozen=True)
class SyncResult:
    revision: str
    total: int
    reused: int
    downloaded: int
    changed: bool
    pruned: bool


@dataclass(frozen=True)
class SyncProgress:
    """``phase``: manifest, tile or published."""

    phase: str
    total: int
    completed: int
    downloaded: int
    reused: int


class TileStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self, dataset: str) -> Manifest | None:
        """The active manifest of a dataset."""
        name = f"{self.path}/manifests/{_key(dataset)}.json"
        system, p = self._file(name)
        if not system.exists(p):
            return None
        return Manifest(**json.loads(self.spark.read.text(name, wholetext=True).first()[0]))

    def publish(self, manifest: Manifest) -> bool:
        """Make a revision the active one; False if it is already."""
        if self.manifest(manifest.dataset) == manifest:
            return False
        name = f"{self.path}/manifests/{_key(manifest.dataset)}.json"
        replace_text(self.spark, name, json.dumps(asdict(manifest), sort_keys=True))
        return True

    def tiles(self, dataset: str, revision: str) -> DataFrame:
        """(dataset, revision, z, x, y, data, checksum), each tile once; keys prune the folders."""
        return self._rows(dataset, revision).dropDuplicates(["z", "x", "y"])

    def _rows(self, dataset: str, revision: str) -> DataFrame:
        """All stored rows; two runs at once may have stored a tile twice."""
        system, p = self._file(f"{self.path}/tiles")
        if not system.exists(p):
            rows = self.spark.createDataFrame([], TILES)
        else:
            rows = self.spark.read.schema(TILES).parquet(f"{self.path}/tiles")
        own = rows.filter((F.col("dkey") == _key(dataset)) & (F.col("rkey") == _key(revision)))
        return own.select(F.lit(dataset).alias("dataset"), F.lit(revision).alias("revision"), "z", "x", "y", "data", "checksum")

    def put(self, rows: DataFrame) -> None:
        """Append tiles (dataset, revision, z, x, y, data, checksum)."""
        keyed = rows.withColumn("dkey", F.sha2(F.col("dataset").cast("binary"), 256)).withColumn("rkey", F.sha2(F.col("revision").cast("binary"), 256))
        keyed.select("z", "x", "y", "data", "checksum", "dkey", "rkey").write.mode("append").partitionBy("dkey", "rkey").parquet(f"{self.path}/tiles")

    def revisions(self, dataset: str) -> list[str]:
        """Keys of the revisions held of a dataset."""
        system, p = self._file(f"{self.path}/tiles/dkey={_key(dataset)}")
        if not system.exists(p):
            return []
        return sorted(s.getPath().getName().removeprefix("rkey=") for s in system.listStatus(p))

    def prune(self, dataset: str) -> int:
        """Drop all revisions but the active one; how many went."""
        active = self.manifest(dataset)
        gone = [r for r in self.revisions(dataset) if active is None or r != _key(active.revision)]
        for r in gone:
            system, p = self._file(f"{self.path}/tiles/dkey={_key(dataset)}/rkey={r}")
            system.delete(p, True)
        return len(gone)

    def synchronise(self, manifest: Manifest, keys: DataFrame, ranges: DataFrame, fetch: Callable[[int, int, int], bytes], prune: bool = False, progress: Callable[[SyncProgress], None] | None = None) -> SyncResult:
        """Bring the requested tiles of a revision into the store and publish it.

        The manifest changes only when all tiles are present and sound.  What an
        earlier, failed attempt stored is reused.  A conflicting request or a
        stored tile with a wrong checksum, or an invalid range, is an error.
        ``progress`` gets the counts after each step and, while tiles are
        fetched, every ``EVERY_S`` seconds.
        """

        def tell(phase: str, total: int = 0, downloaded: int = 0, reused: int = 0) -> None:
            if progress:
                progress(SyncProgress(phase, total, downloaded + reused, downloaded, reused))

        manifest.check(self.spark)
        tell("manifest")
        wrong = ranges.withColumn("problem", sync.range_problem()).filter("problem is not null").first()
        if wrong is not None:
            raise ValueError(f"a range is not valid: {wrong.problem}")
        conflict = sync.request_conflicts(keys, ranges).first()
        if conflict is not None:
            raise ValueError(f"{conflict.kind} at {conflict.z}/{conflict.x}/{conflict.y}")
        wanted = sync.requested(keys, ranges)
        planned = sync.plan(wanted, self._rows(manifest.dataset, manifest.revision), manifest.dataset, manifest.revision)
        counts = sync.result(planned).first()
        if counts.corrupt:
            raise ValueError(f"{counts.corrupt} stored tiles have a wrong checksum")
        tell("tile", counts.total, 0, counts.reused)
        if counts.downloaded:
            done, over = self.spark.sparkContext.accumulator(0), threading.Event()

            def watch() -> None:
                while not over.wait(EVERY_S):
                    tell("tile", counts.total, min(done.value, counts.downloaded), counts.reused)

            watcher = threading.Thread(target=watch, daemon=True)
            watcher.start()
            try:
                self.put(sync.download(planned, fetch, manifest.dataset, manifest.revision, done))
            finally:
                over.set()
                watcher.join()
            again = sync.result(sync.plan(wanted, self._rows(manifest.dataset, manifest.revision), manifest.dataset, manifest.revision)).first()
            if again.downloaded or again.corrupt:
                raise ValueError("not all tiles arrived whole")
            tell("tile", counts.total, counts.downloaded, counts.reused)
        changed = self.publish(manifest)
        tell("published", counts.total, counts.downloaded, counts.reused)
        pruned = prune and self.prune(manifest.dataset) > 0
        return SyncResult(manifest.revision, counts.total, counts.reused, counts.downloaded, changed, bool(pruned))
