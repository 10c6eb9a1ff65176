"""Tile tables: layouts, content ids, digests, lookups, parity and publication.

A flat table has a row (z, x, y, data) for each tile; a normalized one has
(z, x, y, tile_id) and, apart, (tile_id, data).  Rows are TMS.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import digests
from tilewright.functions import tiles as T
from tilewright.operators.ranks import cumulated, ranked
from tilewright.shared import drop_path, saved, scratch
from tilewright.shipping import ship

#: Fixed values of the import batch rules.
DEFAULT_BATCH, MOST_BATCH = 1000, 8192
SAMPLE_ROWS, HEADROOM, LEAST_TILE = 1024, 8, 16 << 10
FIXED_MEMORY, ROW_OVERHEAD = 2 << 20, 768


#: Sets up to this size get the sequential digest too.
SEQUENTIAL_BYTES = 1 << 30
#: Bytes of tiles that a task of the sequential digest sorts and hashes.
PART_BYTES = 128 << 20

#: What tells payloads apart before their bytes are compared: two hashes and the length.
SIGNATURE = ["sha", "hash", "size"]


def _signed(tiles: DataFrame) -> DataFrame:
    """Tiles with their payload's signature; a missing payload is one of its own."""
    sha, size = F.coalesce(F.unhex(F.sha2("data", 256)), F.lit(b"")), F.coalesce(F.octet_length("data"), F.lit(-1))
    return tiles.select("*", sha.alias("sha"), F.xxhash64("data").alias("hash"), size.cast("long").alias("size"))


def content_ids(tiles: DataFrame, signed: Callable[[DataFrame], DataFrame] = _signed) -> tuple[DataFrame, DataFrame]:
    """(images, map): payloads numbered in base 36 by first place (z, x, y), and
    tiles with their payload's id.

    Payloads are grouped by signature and then by their bytes, so that two that
    share a signature stay apart; each task sends a payload once.  Of the groups
    only signatures and places go on: they are numbered, tiles find their id by
    signature, and an image is the payload of the tile at its first place.  Where
    payloads share a signature, or tiles a place, bytes are carried along.
    Tiles without data have an id too.
    """
    spark, own = tiles.sparkSession, signed(tiles)
    payloads = own.groupBy(*SIGNATURE, "data").agg(F.min(F.struct("z", "x", "y")).alias("at"))
    by = payloads.groupBy(*SIGNATURE).agg(F.count("*").alias("payloads"), F.min("at").alias("at"))
    repeated = tiles.groupBy("z", "x", "y").agg(F.count("*").alias("n")).filter("n > 1")
    path = scratch(spark, "payloads")
    try:
        firsts = saved(by, path)
        if not firsts.filter("payloads > 1").isEmpty() or not repeated.isEmpty():
            return _ids_by_bytes(own, payloads)
        ids = numbered(firsts.drop("payloads"), "at").select(*SIGNATURE, "at", _base36("n").alias("tile_id"))
    finally:
        drop_path(spark, path)
    keyed = own.select("z", "x", "y", *SIGNATURE).join(ids.drop("at"), SIGNATURE).select("z", "x", "y", "tile_id")
    images = tiles.select(F.struct("z", "x", "y").alias("at"), "data").join(ids.select("at", "tile_id"), "at")
    return images.select("tile_id", "data"), keyed


def _base36(n: str) -> Column:
    return F.lower(F.conv(F.col(n).cast("string"), 10, 36))


def _ids_by_bytes(own: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``content_ids`` where signatures or places do not tell payloads apart.
    Tiles find their id by signature alone, but for those few whose signature
    several payloads share: these compare bytes."""
    ids = numbered(payloads, "at").select(*SIGNATURE, "data", _base36("n").alias("tile_id"))
    keys = ids.groupBy(*SIGNATURE).agg(F.count("*").alias("payloads"), F.min("tile_id").alias("tile_id"))
    alone = own.select("z", "x", "y", *SIGNATURE).join(keys.filter("payloads = 1"), SIGNATURE).select("z", "x", "y", "tile_id")
    shared = keys.filter("payloads > 1").select(*SIGNATURE)
    twins = ids.join(shared, SIGNATURE, "left_semi").withColumnRenamed("data", "twin")
    apart = own.join(shared, SIGNATURE, "left_semi").join(twins, SIGNATURE).filter(F.col("data").eqNullSafe(F.col("twin")))
    return ids.select("tile_id", "data"), alone.unionByName(apart.select("z", "x", "y", "tile_id"))


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Rows numbered from 0 in the order of a column whose values differ."""
    return ranked(df, [], [order], name)


def dedup_stats(tiles: DataFrame) -> DataFrame:
    """tiles, unique_tiles, reused_tiles, payload_bytes, unique_bytes, duplicate_bytes."""
    by = _signed(tiles).groupBy(*SIGNATURE).agg(F.count("*").alias("n"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tiles"),
        F.count("*").alias("unique_tiles"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("reused_tiles"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("payload_bytes"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"),
        F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("duplicate_bytes"),
    )


def layout_choice(keyed: DataFrame) -> DataFrame:
    """n_map, n_unique and the layout: flat if no payload is used twice."""
    by = keyed.groupBy("tile_id").agg(F.count("*").alias("n"))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_map"), F.count("tile_id").alias("n_unique"))
    return out.withColumn("layout", F.when(F.col("n_map") == F.col("n_unique"), "flat").otherwise("normalized"))


def flat(keyed: DataFrame, images: DataFrame) -> DataFrame:
    """The flat form of a normalized table."""
    return keyed.join(images, "tile_id").select("z", "x", "y", "data")


def dangling(keyed: DataFrame, images: DataFrame) -> DataFrame:
    """Tiles whose payload is missing."""
    return keyed.join(images.select("tile_id"), "tile_id", "left_anti").select("z", "x", "y", "tile_id")


def tile_digest(tiles: DataFrame) -> DataFrame:
    """SHA-256 over the tiles in key order: BE64(z, x, y, length), then the data.

    The digest is sequential by definition, its tasks are not large: tiles are
    dealt in key order to parts of ``PART_BYTES``, and a task for each part takes
    up the hash where the one before left it.  The driver passes that state on, a
    hundred bytes.  The time is that of one hasher; ``tree_digest`` is the one
    that runs in parallel.
    """
    ship(tiles.sparkSession)
    rows = tiles.select("z", "x", "y", "data")
    size = rows.agg(F.coalesce(F.sum(_hashed_bytes()), F.lit(0))).first()[0]
    done = _chained(rows) if size > PART_BYTES else None
    if done is None:
        return _hashed(rows.repartition(1)).select("n_tiles", "sha256")
    return tiles.sparkSession.createDataFrame([done], "n_tiles long, sha256 string")


def _hashed_bytes() -> Column:
    return F.octet_length("data").cast("long") + 32


def _hashed(part: DataFrame, start: bytes | None = None, stop: bool = True) -> DataFrame:
    """n_tiles, sha256 and state after one partition, sorted on disk where it does
    not fit its task's memory.  ``start`` is the state before; with ``stop``
    nothing follows, and hashlib does where no state is asked for.  Without the
    functions for states on that worker, sha256 and state are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stop:
            h = hashlib.sha256()
        else:
            h = digests.Sha256(start) if digests.resumable() else None
        n = 0
        for b in batches if h else ():
            for head, data in zip(b.column(0).to_pylist(), b.column(1)):
                h.update(bytes.fromhex(head))
                h.update(data.as_py())
                n += 1
        state = None if stop or not h else h.state()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([h and h.hexdigest()], pa.string()), pa.array([state], pa.binary())], ["n_tiles", "sha256", "state"])

    head = F.concat(T.be64(F.col("z")), T.be64(F.col("x")), T.be64(F.col("y")), T.be64(F.octet_length("data")))
    one = part.sortWithinPartitions("z", "x", "y")
    return one.select(head.alias("head"), "data").mapInArrow(run, "n_tiles long, sha256 string, state binary")


def _chained(tiles: DataFrame) -> tuple[int, str] | None:
    """(n_tiles, sha256) by a task for each part; None where workers cannot take
    up a hash.  Parts are cut by bytes, so only a tile that is larger makes a
    larger part."""
    spark = tiles.sparkSession
    keys = ["z", "x", "y"]
    counts = tiles.groupBy(F.struct(*keys).alias("at")).agg(F.sum(_hashed_bytes()).alias("n"))
    cuts = cumulated(counts, [], "at").groupBy(F.expr(f"before div {PART_BYTES}").alias("part")).agg(F.min("at").alias("at"))
    firsts = [r["at"] for r in cuts.orderBy("part").collect()]  # a row a part
    bound = lambda at: F.struct(*(F.lit(at[k]).cast(tiles.schema[k].dataType).alias(k) for k in keys))
    part = F.size(F.filter(F.array(*map(bound, firsts)), lambda b: b <= F.struct(*keys))) - 1
    dealt = tiles.withColumn("__part", part).repartitionById(len(firsts), F.col("__part")).sortWithinPartitions("__part", *keys)
    path = scratch(spark, "digest")
    try:
        stored = saved(dealt, path, by=["__part"])
        n, sha, state = 0, None, None
        for k in range(len(firsts)):
            own = _hashed(stored.filter(F.col("__part") == k).coalesce(1), state, stop=False).first()
            if own.state is None:
                return None
            n, sha, state = n + own.n_tiles, own.sha256, bytes(own.state)
        return n, sha
    finally:
        drop_path(spark, path)


def tree_digest(tiles: DataFrame, rows_per_node: int = 4096) -> DataFrame:
    """A digest for sets of any size: hashes of key blocks, then of the blocks'
    hashes.  Blocks are squares of tiles, hashed in parallel, and only hashes
    are shuffled: SHA-256 over BE64(z, x, y) and the data's SHA-256 for a tile,
    over the hexadecimal digests in order for each level above."""
    side = int(rows_per_node**0.5)
    leaf = F.sha2(F.concat(F.unhex(F.concat(T.be64(F.col("z")), T.be64(F.col("x")), T.be64(F.col("y")))), F.unhex(F.sha2("data", 256))), 256)
    block = [F.col("z"), F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by")]
    nodes = tiles.withColumn("leaf", leaf).groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("x", "y", "leaf"))).alias("rows"))
    nodes = nodes.select("z", "bx", "by", F.sha2(F.array_join(F.transform("rows", lambda r: r["leaf"]), "").cast("binary"), 256).alias("node"))
    columns = nodes.groupBy("z", "bx").agg(F.array_sort(F.collect_list(F.struct("by", "node"))).alias("rows"))
    columns = columns.select("z", "bx", F.sha2(F.array_join(F.transform("rows", lambda r: r["node"]), "").cast("binary"), 256).alias("node"))
    top = columns.groupBy("z").agg(F.array_sort(F.collect_list(F.struct("bx", "node"))).alias("rows"))
    return top.select("z", F.sha2(F.array_join(F.transform("rows", lambda r: r["node"]), "").cast("binary"), 256).alias("sha256"))


def set_digest(tiles: DataFrame) -> str:
    """The tree digest of a whole set: SHA-256 over the zooms' digests in order."""
    zooms = sorted((r.z, r.sha256) for r in tree_digest(tiles).collect())  # a row a zoom
    return hashlib.sha256("".join(f"{z}:{d};" for z, d in zooms).encode()).hexdigest()


def metadata_digest(metadata: DataFrame) -> DataFrame:
    """SHA-256 over (name, value) by name: BE32 of the byte length before each.
    Metadata is a handful of rows, so one group is bounded."""
    part = lambda c: F.concat(T.be32(F.octet_length(c)), F.hex(F.col(c).cast("binary")))
    rows = metadata.agg(F.array_sort(F.collect_list(F.struct("name", F.concat(part("name"), part("value")).alias("h")))).alias("r"))
    return rows.select(F.sha2(F.unhex(F.array_join(F.transform("r", lambda r: r["h"]), "")), 256).alias("sha256"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys that differ between two tables, and how: missing, extra, changed."""
    a = left.select("z", "x", "y", F.sha2("data", 256).alias("a"))
    b = right.select("z", "x", "y", F.sha2("data", 256).alias("b"))
    both = a.join(b, ["z", "x", "y"], "full_outer")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return both.withColumn("kind", kind).filter("kind is not null").select("z", "x", "y", "kind")


def lookup(tiles: DataFrame, keys: DataFrame) -> DataFrame:
    """Each asked key with its tile's data; null where absent.  The table's
    partitioning by z and its order within files prune what is read."""
    return keys.join(tiles, ["z", "x", "y"], "left")


def in_range(tiles: DataFrame, z: int, x_min: int, x_max: int, y_min: int, y_max: int) -> DataFrame:
    """Tiles of an inclusive rectangle in key order."""
    where = (F.col("z") == z) & F.col("x").between(x_min, x_max) & F.col("y").between(y_min, y_max)
    return tiles.filter(where).orderBy("z", "x", "y")


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """One row for each tile of (z, x_min, x_max, y_min, y_max), x before y."""
    xs = ranges.withColumn("x", F.explode(F.sequence("x_min", "x_max")))
    return xs.withColumn("y", F.explode(F.sequence("y_min", "y_max"))).drop("x_min", "x_max", "y_min", "y_max")


def stream_stats(tiles: DataFrame) -> DataFrame:
    n = F.octet_length("data").cast("long")
    return tiles.agg(F.count("*").alias("tiles"), F.coalesce(F.sum(n), F.lit(0)).alias("bytes"), F.coalesce(F.max(n), F.lit(0)).alias("largest"))


def sampled_largest(tiles: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The largest payload of the first rows in key order: a bounded sample."""
    return tiles.orderBy("z", "x", "y").limit(rows).agg(F.coalesce(F.max(F.octet_length("data").cast("long")), F.lit(0)).alias("largest"))


def auto_batch(largest: Column, memory: Column) -> Column:
    """Rows of an import batch for the largest sampled payload and a memory budget."""
    per_tile = F.greatest(largest * HEADROOM, F.lit(LEAST_TILE)) + ROW_OVERHEAD
    rows = F.floor((memory - FIXED_MEMORY) / per_tile)
    return F.when((memory <= FIXED_MEMORY) | (rows < 1), DEFAULT_BATCH).otherwise(F.least(rows, F.lit(MOST_BATCH))).cast("long")


def stream_batch(requested: Column, largest: Column, memory: Column) -> Column:
    """As above for a stream whose largest payload is known; it only lowers a request."""
    rows = F.greatest(F.lit(1), F.least(F.floor((memory - FIXED_MEMORY) / (largest + ROW_OVERHEAD)), F.lit(MOST_BATCH)))
    rows = F.when(memory <= FIXED_MEMORY, 1).otherwise(rows)
    return F.when(requested == 0, rows).otherwise(F.least(requested, rows)).cast("long")


def metadata_map(metadata: DataFrame) -> dict[str, str]:
    """A metadata table as a dict; a null value or a repeated name is an error."""
    rows = metadata.select("name", "value").collect()
    if any(r.value is None for r in rows):
        raise ValueError("metadata holds a null value")
    out = {r.name: r.value for r in rows}
    if len(out) != len(rows):
        raise ValueError("metadata repeats a name")
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def publish(tiles: DataFrame, metadata: DataFrame, path: str, source: str = "", replace: bool = False, provenance: dict | None = None) -> dict:
    """Write an immutable tile set: Parquet by zoom, sorted within files;
    metadata; manifest.json; COMPLETE last.

    Everything is written beside ``path``, checked, and then renamed.  Duplicate
    or invalid keys are an error.  With ``replace`` the old set is moved aside
    and comes back if the rename fails; between the two renames neither stands,
    so where readers must not see that, publish versions (``versions``).
    """
    spark = tiles.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target) and not replace:
        raise FileExistsError(path)
    tag = uuid.uuid4().hex[:8]
    tmp, aside = f"{path}.tmp-{tag}", jvm.org.apache.hadoop.fs.Path(f"{path}.old-{tag}")
    moved = False
    try:
        sorted_ = tiles.select("z", "x", "y", "data").repartitionByRange("z", "x", "y").sortWithinPartitions("z", "x", "y")
        sorted_.write.partitionBy("z").parquet(f"{tmp}/tiles")
        written = read_tiles(spark, tmp, check=False)
        bad = written.filter(~T.valid_key(F.col("z"), F.col("x"), F.col("y")) | F.col("data").isNull()).limit(1).count()
        twice = written.groupBy("z", "x", "y").count().filter("count > 1").limit(1).count()
        if bad or twice:
            raise ValueError("the tiles have an invalid or repeated key")
        metadata.select("name", "value").coalesce(1).write.parquet(f"{tmp}/metadata")
        stats = stream_stats(written).first()
        manifest = {
            "format_version": 1,
            "source": source,
            "tables": [{"name": "tiles", "rows": stats.tiles}, {"name": "metadata", "rows": metadata.count()}],
            "payload_bytes": stats.bytes,
            "largest_tile": stats.largest,
            "tile_tree_sha256": set_digest(written),
            "tile_digest_sha256": tile_digest(written).first().sha256 if stats.bytes <= SEQUENTIAL_BYTES else None,
            "metadata_digest_sha256": metadata_digest(metadata).first().sha256,
            "provenance": provenance or {},
        }
        for name, text in (("manifest.json", json.dumps(manifest, indent=1, sort_keys=True)), ("COMPLETE", "")):
            out = system.create(jvm.org.apache.hadoop.fs.Path(f"{tmp}/{name}"), True)
            out.write(bytearray(text.encode()))
            out.close()
        if replace and system.exists(target):
            moved = system.rename(target, aside)
        if not system.rename(jvm.org.apache.hadoop.fs.Path(tmp), target):
            raise OSError(f"could not rename to {path}")
    except BaseException:
        if moved and not system.exists(target):
            system.rename(aside, target)
        _delete(spark, tmp)
        raise
    if moved:
        system.delete(aside, True)
    return manifest


def _whole(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/COMPLETE")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise ValueError(f"{path} was not published whole")


def read_tiles(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A published set's tiles; an error where COMPLETE is missing."""
    if check:
        _whole(spark, path)
    return spark.read.schema("x long, y long, data binary, z int").parquet(f"{path}/tiles").select("z", "x", "y", "data")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, value string").parquet(f"{path}/metadata")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def table_rows(manifest: dict, name: str) -> int:
    """Rows of a table as the manifest has them; -1 where it lists none."""
    return next((t["rows"] for t in manifest["tables"] if t["name"] == name), -1)


def validate(spark: SparkSession, path: str) -> list[str]:
    """What a full audit finds wrong; an empty list if nothing."""
    _whole(spark, path)
    manifest = read_manifest(spark, path)
    tiles, metadata = read_tiles(spark, path), read_metadata(spark, path)
    found = []
    if tiles.count() != table_rows(manifest, "tiles"):
        found.append("the number of tiles differs")
    if set_digest(tiles) != manifest["tile_tree_sha256"]:
        found.append("the tiles' digest differs")
    if metadata_digest(metadata).first().sha256 != manifest["metadata_digest_sha256"]:
        found.append("the metadata's digest differs")
    return found


def inspect(spark: SparkSession, path: str) -> dict:
    """The manifest of a set that an audit finds whole; an error otherwise."""
    found = validate(spark, path)
    if found:
        raise ValueError("; ".join(found))
    return read_manifest(spark, path)


def tile(spark: SparkSession, path: str, z: int, x: int, y: int, out: str | None = None) -> bytes | None:
    """One tile of a published set, also written to the file ``out``; None, and
    no file, where the set has none."""
    row = read_tiles(spark, path).filter((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)).select("data").first()
    if row is None:
        return None
    if out:
        with open(out, "wb") as f:
            f.write(row.data)
    return bytes(row.data)


#: Exit codes of the verbs below: done, refused, wrong call, absent.
DONE, REFUSED, MISUSED, ABSENT = 0, 1, 2, 3


def run_verb(spark: SparkSession, verb: str, *args: str) -> tuple[int, object]:
    """``validate path``, ``inspect path`` and ``tile path z x y [file]`` as
    commands give them: (exit code, what was found)."""
    try:
        if verb == "validate" and len(args) == 1:
            found = validate(spark, args[0])
            return (REFUSED, found) if found else (DONE, read_manifest(spark, args[0]))
        if verb == "inspect" and len(args) == 1:
            return DONE, inspect(spark, args[0])
        if verb == "tile" and len(args) in (4, 5):
            try:
                key = [int(v) for v in args[1:4]]
            except ValueError:
                return MISUSED, "z, x and y must be whole numbers"
            data = tile(spark, args[0], *key, *args[4:])
            return (ABSENT, None) if data is None else (DONE, data)
    except (OSError, ValueError) as e:
        return REFUSED, str(e)
    return MISUSED, f"{verb} does not take {len(args)} arguments"
