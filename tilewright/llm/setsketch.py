"""Near duplicates by SetSketch registers.

A document's set is its distinct word shingles.  A register holds the exponent
of an exponentially spaced, truncated minimum: floor(1 - log_b(h)), h the least
of exponential variables of rate ``RATE`` that hashes of the elements stand
for.  Registers of a union are the maxima of the parts' registers, and equal
registers are as likely as the sets are alike.

1. Rows with equal sets form a class; its least doc_id stands for it.
2. Bands of registers are bucket keys.  In each bucket of two or more classes,
   every class is paired with the one that shares most buckets with others.
   The pairs that met in most buckets are verified by the joint likelihood of
   their sketches, then by the whole sets, and the components of the links are
   found.
3. Pairs of a bucket whose classes are still in different components are
   compared inside the join, by short digests of their registers and then by
   the whole sets, so that nothing but links leaves it.  A bucket of more than
   ``SMALL_BUCKET`` such classes (a template whose fillings are not alike enough)
   is dealt out as pairs of blocks of bounded rows and elements, each a task's
   group, where all intersections of two blocks are counted at once.  Together,
   no pair that shares a bucket is left out: it is either connected or was
   compared.

With 48 bands of 5 registers a pair of similarity 0.75 shares no bucket with
probability 2.3e-6, one of 0.8 with 5e-9.  The filters by digests and likelihood
reject a link of 0.75 only beyond five standard deviations (3e-7).

A text without words, a null text and a row without doc_id are linked with
nothing.  Rows that repeat a doc_id are one node: it has the links of all of
them, and each row its own set's size.  ``row`` is a hash of the row's text, by
which rows of one doc_id can be told apart.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import WordHashes, drop_path, free_caches, free_shuffles, mixed, prepare, saved, scratch, text_bytes, window_hashes
from tilewright.llm.components import components

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Bits of a register's digest; 16 of them make a 64-bit word.
DIGEST_BITS = 4
WORDS = -(-REGISTERS * DIGEST_BITS // 64)
SIGMAS = 5
STAR_LINKS = 3
#: Classes of a bucket beyond which it is compared in blocks, and what a block holds at most, nearly.
SMALL_BUCKET = 256
BLOCK_ROWS, BLOCK_ELEMENTS = 2048, 1 << 22


def multipliers(n: int = REGISTERS) -> np.ndarray:
    """Odd multipliers, one for each register."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(data: bytes | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words, A-Z in
    lower case; fewer words are one shingle."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = cache.of(words)
    n = min(size, len(words))
    return np.unique(mixed(window_hashes(h, n) + np.uint64(n)))


def registers(elements: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The sketch of a set, 16 bits a register; of an empty set all zero."""
    if not len(elements):
        return np.zeros(len(factors), "<u2")
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), 256):
        np.minimum(least, np.multiply.outer(elements[i : i + 256], factors).min(axis=0), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, LIMIT + 1).astype("<u2")


def digests(sketch: np.ndarray) -> np.ndarray:
    """``DIGEST_BITS`` pseudo-random bits of each register, packed into 64-bit words."""
    d = mixed(sketch.astype(np.uint64) * np.uint64(2 * REGISTERS) + np.arange(len(sketch), dtype=np.uint64)) & np.uint64((1 << DIGEST_BITS) - 1)
    d = np.pad(d, (0, 64 // DIGEST_BITS * WORDS - len(d))).reshape(WORDS, -1)
    return np.bitwise_or.reduce(d << np.arange(0, 64, DIGEST_BITS, dtype=np.uint64), axis=1).view(np.int64)


def likeliest(k_u: np.ndarray, k_v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sketches whose sets'
    sizes are known (rows of ``k_u`` and ``k_v`` are the registers)."""
    more, less = (k_u > k_v).sum(axis=1), (k_u < k_v).sum(axis=1)
    same = k_u.shape[1] - more - less
    u = n_u / (n_u + n_v)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(a, tiny)) + less * np.log(np.maximum(b, tiny)) + same * np.log(np.maximum(1 - a - b, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(40):  # golden section; the likelihood is concave in j
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        left = value(x) > value(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def _slack(share: float, n: int) -> float:
    return SIGMAS * math.sqrt(share * (1 - share) / n)


def sketched(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n, fp, sketch): hash of the text, set size, 128-bit digest of
    the set, registers."""
    factors = multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        cache = WordHashes()
        for b in batches:
            n, fp, sk = [], [], []
            for x in b.column(1):
                s = shingle_set(x.as_py(), shingle, cache)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sk.append(registers(s, factors).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sk, pa.binary())], names=["doc_id", "row", "n", "fp", "sketch"])

    b = text_bytes(docs, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), b.alias("b"), F.xxhash64(b).alias("row")).mapInArrow(run, "doc_id long, row long, n long, fp binary, sketch binary")


def _with_digests(classes: DataFrame) -> DataFrame:
    names = [f"w{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for b in batches:
            w = np.array([digests(np.frombuffer(x.as_py(), "<u2")) for x in b.column(2)], np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(w[:, i].copy()) for i in range(WORDS))], names=["rep", "n", *names])

    return classes.select("rep", "n", "sketch").mapInArrow(run, "rep long, n long, " + ", ".join(f"{x} long" for x in names))


def _agreeing() -> Column:
    """Number of registers of x and y whose digests are equal."""
    lowest = sum(1 << k for k in range(0, 60, DIGEST_BITS))  # the top digest apart: its bit is the sign
    unequal = F.lit(0)
    for i in range(WORDS):
        v = F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))
        any_ = v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseOR(F.shiftrightunsigned(v, 3))
        unequal = unequal + F.bit_count(any_.bitwiseAND(F.lit(lowest))) + F.when(F.shiftrightunsigned(v, 60) != 0, 1).otherwise(0)
    return F.lit(REGISTERS) - unequal


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets ``x`` with all sets ``y``.

    Elements that many pairs share are counted by products of 0/1 matrices,
    others pair by pair.
    """
    out = np.zeros((len(x), len(y)), np.float32)
    row_x, row_y = (np.repeat(np.arange(len(v)), [len(e) for e in v]) for v in (x, y))
    ids, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    at_x, at_y = at[: len(row_x)], at[len(row_x) :]
    pairs = np.bincount(at_x, minlength=len(ids)) * np.bincount(at_y, minlength=len(ids))
    heavy = np.flatnonzero(pairs > max(1, len(x) * len(y) // 100))
    column = np.full(len(ids), -1)
    column[heavy] = np.arange(len(heavy))
    for k in range(0, len(heavy), 1024):
        a, b = np.zeros((len(x), 1024), np.float32), np.zeros((len(y), 1024), np.float32)
        for m, ids_, rows in ((a, at_x, row_x), (b, at_y, row_y)):
            c = column[ids_] - k
            here = (c >= 0) & (c < 1024)
            m[rows[here], c[here]] = 1
        out += a @ b.T
    light_x, light_y = ((pairs[i] > 0) & (column[i] < 0) for i in (at_x, at_y))
    order = np.argsort(at_y[light_y], kind="stable")
    sorted_y, rows_y = at_y[light_y][order], row_y[light_y][order]
    ids_x, rows_x = at_x[light_x], row_x[light_x]
    for k in range(0, len(ids_x), 1 << 18):
        own, rows = ids_x[k : k + (1 << 18)], rows_x[k : k + (1 << 18)]
        start, end = np.searchsorted(sorted_y, own, "left"), np.searchsorted(sorted_y, own, "right")
        n = end - start
        there = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        np.add.at(out, (np.repeat(rows, n), rows_y[there]), 1)
    return out


def block_links(reps: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the classes of two blocks, or inside the one there is.  Of
    many links only a few that connect the same classes are given."""
    first = blocks == blocks.min()
    one = first.all()
    x, y = np.flatnonzero(first), np.arange(len(reps)) if one else np.flatnonzero(~first)
    sizes = np.array([len(s) for s in sets], np.float32)
    both = shared_counts([sets[i] for i in x], [sets[i] for i in y])
    linked = 100 * both >= similarity * (sizes[x][:, None] + sizes[y][None, :] - both)
    linked &= groups[x][:, None] != groups[y][None, :]
    a, b = np.nonzero(linked)
    if len(a) > 4 * len(reps):  # every class points to the least label that a round of links reaches
        label, none = np.arange(len(reps), dtype=np.int32), np.int32(len(reps))
        while True:
            low_y = np.where(linked, label[x][:, None], none).min(axis=0)
            label[y] = np.minimum(label[y], low_y)
            low_x = np.where(linked, label[y][None, :], none).min(axis=1)
            new = label.copy()
            new[x] = np.minimum(label[x], low_x)
            if (new == label).all():
                break
            label = new
        own = np.flatnonzero(label != np.arange(len(reps)))
        return reps[label[own]], reps[own]
    return reps[x[a]], reps[y[b]]


def _in_blocks(hot: DataFrame, classes: DataFrame, whole: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links of the buckets ``hot`` (key, rep, component), which are large."""
    sized = hot.join(classes.select("rep", "n"), "rep")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    dealt = sized.join(sized.groupBy("key").agg(blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component")
    rows = cells.join(whole, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        held: list[tuple] = []
        now = None

        def links() -> pa.RecordBatch:
            blocks_, reps, groups = (np.array(v) for v in list(zip(*held))[:3])
            a, b = block_links(reps, groups, [r[3] for r in held], blocks_, similarity)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for n, cell in enumerate(zip(*columns[:3])):
                if cell != now and held:
                    yield links()
                now = cell
                held.append((columns[3][n], columns[4][n], columns[5][n], batch.column(6)[n].values.to_numpy()))
        if held:
            yield links()

    return rows.select("key", "i", "j", "block", "rep", "component", "elements").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and row of every row;
    ``similarity`` in hundredths of intersection to union."""
    spark = docs.sparkSession
    prepare(spark)
    share = similarity / 100
    factors = multipliers()
    equal = share + (1 - share) / (1 << DIGEST_BITS)  # chance that two registers' digests are equal
    agree_at_least = math.floor(REGISTERS * (equal - _slack(equal, REGISTERS)))
    likely_at_least = share - _slack(share, REGISTERS)
    paths = {k: scratch(spark, f"near-{k}") for k in ("rows", "classes", "members", "sets", "links", "apart")}

    rows = saved(sketched(docs, shingle, id_col, text_col), paths["rows"])
    first = F.min(F.struct("doc_id", "n", "sketch")).alias("m")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("fp").agg(first)
    classes = saved(classes.select("fp", F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch")), paths["classes"])

    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)))
    banded = classes.select(F.posexplode(keys).alias("band", "key"), "rep")
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = saved(banded.join(buckets, "key"), paths["members"])

    ids = members.select("rep").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        cache = WordHashes()
        for b in batches:
            s = [shingle_set(x.as_py(), shingle, cache).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], names=["rep", "elements"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_bytes(docs, text_col).alias("b")).join(ids, "rep", "left_semi")
    whole = saved(texts.mapInArrow(sets, "rep long, elements array<long>"), paths["sets"])
    free_shuffles(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free_caches()
            for b in batches:
                if not b.num_rows:
                    continue
                x = [v.values.to_numpy().view(np.uint64) for v in b.column(2)]
                y = [v.values.to_numpy().view(np.uint64) for v in b.column(3)]
                k_x, k_y = (np.array([registers(s, factors) for s in z]) for z in (x, y))
                n_x, n_y = (np.array([len(s) for s in z], np.float64) for z in (x, y))
                likely = likeliest(k_x, k_y, n_x, n_y) >= likely_at_least
                ok = []
                for p, q, fair in zip(x, y, likely):
                    both = len(np.intersect1d(p, q, assume_unique=True)) if fair else 0
                    ok.append(fair and 100 * both >= similarity * (len(p) + len(q) - both))
                keep = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], names=["a", "b"])

        with_a = pairs.join(whole.select(F.col("rep").alias("a"), F.col("elements").alias("x")), "a")
        with_b = with_a.join(whole.select(F.col("rep").alias("b"), F.col("elements").alias("y")), "b")
        return with_b.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    # Stars: each class with the class of its buckets that meets most others.
    met = members.groupBy("rep").agg(F.sum("size").alias("met"))
    lead = members.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("minus"))).alias("top"))
    star = members.join(lead, "key").select((-F.col("top.minus")).alias("a"), F.col("rep").alias("b")).filter("a != b")
    star = star.groupBy("a", "b").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    star = star.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= STAR_LINKS).select("a", "b")
    links = saved(verified(star), paths["links"])
    joined = components(links)

    # The rest: pairs of a bucket that are still apart.
    apart = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    unlike = apart.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low != high").select("key", "size")
    every = saved(apart.join(unlike, "key"), paths["apart"])
    hot, apart = every.filter(F.col("size") > SMALL_BUCKET).select("key", "rep", "component"), every.filter(F.col("size") <= SMALL_BUCKET).drop("size")
    asked = apart.select("rep").distinct()
    own = classes.join(asked, "rep", "left_semi")
    known = _with_digests(own).join(own.select("rep", keys.alias("keys")), "rep").join(whole, "rep")
    apart = apart.join(known, "rep")
    x, y = apart.alias("x"), apart.alias("y")
    both = F.size(F.array_intersect("x.elements", "y.elements"))
    near = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * similarity)
        & (_agreeing() >= agree_at_least)
        & ~F.arrays_overlap(F.slice("x.keys", 1, F.col("x.band")), F.slice("y.keys", 1, F.col("y.band")))  # their first common bucket
        & (both * 100 >= (F.col("x.n") + F.col("y.n") - both) * similarity)
    )
    more = x.join(y, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).unionByName(_in_blocks(hot, classes, whole, similarity)).distinct()
    # A component found so far takes part as one link from each of its nodes to its least node,
    # a doc_id that stands on several texts as links to the classes of all of them.
    so_far = joined.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    several = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 and doc_id is not null").select("doc_id")
    several = rows.filter("n > 0").join(several, "doc_id", "left_semi").join(classes.select("fp", "rep"), "fp").filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(so_far.unionByName(more).unionByName(several))

    out = rows.select("doc_id", "row", "n", "fp").join(classes.select("fp", "rep"), "fp", "left")
    out = out.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    label = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id"))
    result = out.select("doc_id", F.col("n").alias("n_shingles"), label.cast("long").alias("component_id"), "row")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    result = saved(result.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row"), scratch(spark, "near-result"))
    drop_path(spark, *paths.values())
    free_shuffles(spark)
    return result
