"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model's units are UTF-8 bytes, so a window of ``ORDER`` units is one 64-bit
key, words need no vocabulary, and what is counted grows with the variety of
the text and not with its length.  Model and scores come from sharded tables:

1. All documents' windows are counted in each task and summed by key, and so
   are those of the trusted documents.  To find these, their ids are joined to
   the texts that a filter of fixed size lets through (``FILTER_BITS``, 8 MB);
   it spares shuffling the others and decides nothing.
2. Lower orders count distinct extensions; each order has its three discounts
   from its counts of counts.
3. Every window that occurs anywhere gets its probability by joins of its
   count, its context's sums and the next lower order's probability.
4. Documents look up the most frequent windows in a table of ``HOT`` rows
   (16 bytes each: a fixed bound); what it lacks is joined by key, one row for
   each document and window.

A trusted document is labelled quality 1.  Three quarters of them train; the
others give the limits of the mean negative log probability.  A band of lengths
(``BANDS``, in bytes) has one offset for all languages: the ``QUANTILE`` of how
far its documents lie above their language's median, as short ones spread more.
A language's limit is the same quantile of its own documents less their offsets,
whatever their number, and ``SLACK``; in a band the offset is added again.  A
language without any takes the quantile of all, a band without any no offset.
Quantiles are exact, over values rounded to ``DIGITS``: counts of rounded values
merge, so no order of rows or tasks shows in them.

A null or empty text has no perplexity and is rejected.  Rows that repeat a
doc_id are scored one by one, and ``row``, a hash of the text, tells them apart;
a null language is ``und``; without trusted rows nothing has a limit and every
text stays.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import drop_path, free_caches, free_shuffles, prepare, saved, scratch, small_batches, text_bytes

ORDER = 6
HOT = 1 << 19
SLOT_BITS = 21
#: Share of a language's held-out trusted documents within its limit, and what is added to it (nats a byte).
QUANTILE = 0.995
SLACK = 0.02
DIGITS = 4
BANDS = (64, 256, 1024, 4096)
HELD_OUT_OF = 4
FILTER_BITS = 26


def windows(data: bytes) -> np.ndarray:
    """One key for each byte: itself and the ``ORDER - 1`` before it (zero
    bytes stand before the text)."""
    a = np.frombuffer(bytes(ORDER - 1) + data, np.uint8).astype(np.int64)
    n = len(data)
    key = a[:n].copy()
    for i in range(1, ORDER):
        key <<= 8
        key |= a[i : i + n]
    return key


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def window_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) of a column ``b`` of bytes: counts of each task, not yet summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, inv = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return u, np.bincount(inv, np.concatenate([x[1] for x in held]), len(u)).astype(np.int64)

        def out() -> pa.RecordBatch:
            u, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["gram", "n"])

        for b in small_batches(batches, "b", 1 << 19):
            own = [windows(x) for x in b.column(0).to_pylist() if x]
            if own:
                held.append(np.unique(np.concatenate(own), return_counts=True))
            if len(held) > 12:
                held[:] = [merged()]
                if len(held[0][0]) > 700_000:
                    yield out()
        if held:
            yield out()

    return texts.select("b").mapInArrow(run, "gram long, n long")


def _places() -> list[Column]:
    size = F.lit(1 << FILTER_BITS)
    return [F.pmod(F.xxhash64("doc_id"), size), F.pmod(F.xxhash64("doc_id", F.lit(1)), size)]


def likely(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, b) of ``texts`` whose doc_id may be among ``ids``: all that
    are, and few others unless there are many millions of ids.

    The filter is ``1 << FILTER_BITS`` bits, whatever the number of ids.
    """
    places = ids.select(F.explode(F.array(*_places())).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.expr("1L"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    bits = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        t = bits.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i in (2, 3):
                at = b.column(i).to_numpy()
                keep &= (t[at >> 6] >> (at & 63)) & 1 == 1
            yield b.select([0, 1]).filter(pa.array(keep))

    return texts.select("doc_id", "b", *(c.alias(f"at{i}") for i, c in enumerate(_places()))).mapInArrow(run, "doc_id long, b binary")


def corpus_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, n_all, n_train) over all documents and those of ``trusted`` ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("b"))
    zero = F.expr("0L")
    everywhere = window_counts(texts).select("gram", F.col("n").alias("n_all"), zero.alias("n_train"))
    known = window_counts(likely(texts, trusted).join(trusted, "doc_id", "left_semi")).select("gram", zero.alias("n_all"), F.col("n").alias("n_train"))
    return everywhere.unionByName(known).groupBy("gram").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; where a
    count of counts is zero, half the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if a and y else i / 2
        out.append(min(max(d, 0.0), float(i)))
    return tuple(out)


def probabilities(counts: DataFrame, to: str) -> DataFrame:
    """(gram, nll, n_all): negative log probability of each window's last byte
    after the bytes before it.  ``counts``: as of ``corpus_counts``, stored; ``to``: where
    the result is stored."""
    spark = counts.sparkSession
    level = counts.filter("n_train > 0").select("gram", F.col("n_train").alias("c"))
    orders = [level.select(F.lit(ORDER).alias("m"), "gram", "c")]
    for m in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.col("gram").bitwiseAND(_mask(m)).alias("gram")).agg(F.count("*").alias("c"))
        orders.append(level.select(F.lit(m).alias("m"), "gram", "c"))
    both = orders[0]
    for x in orders[1:]:
        both = both.unionByName(x)
    path, half = scratch(spark, "kn-orders"), scratch(spark, "kn-half")
    stored = saved(both, path)
    of = {r.m: discounts(r.n1, r.n2, r.n3, r.n4) for r in stored.groupBy("m").agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()}
    p = None
    for m in range(1, ORDER + 1):
        d1, d2, d3 = of.get(m, (0.0, 0.0, 0.0))
        own = stored.filter(F.col("m") == m)
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own = own.select("gram", "c", off.alias("off"))
        context = own.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("total"), F.sum("off").alias("freed"))
        asked = counts.select("gram", "n_all") if m == ORDER else counts.select(F.col("gram").bitwiseAND(_mask(m)).alias("gram")).distinct()
        asked = asked.withColumn("context", F.shiftright("gram", 8)).join(own, "gram", "left").join(context, "context", "left")
        if p is None:
            asked = asked.withColumn("lower", F.lit(1 / 256))
        else:
            asked = asked.withColumn("suffix", F.col("gram").bitwiseAND(_mask(m - 1))).join(p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        value = F.when(F.col("total").isNull(), F.col("lower")).otherwise((F.coalesce(F.col("c") - F.col("off"), F.lit(0.0)) + F.col("freed") * F.col("lower")) / F.col("total"))
        p = asked.withColumn("p", value)
        if m == ORDER // 2:  # the plan of all orders at once is large for the driver
            p = saved(p.select("gram", "p"), half)
    out = saved(p.select("gram", (-F.log("p")).alias("nll"), "n_all"), to)
    drop_path(spark, path, half)
    return out


class HotTable:
    """Hash table of fixed size with ``PROBES`` places for each window; the few
    whose places are all taken by more frequent ones count as absent."""

    PROBES = 3

    def __init__(self, grams: np.ndarray, nll: np.ndarray):
        """``grams`` from the most frequent on."""
        self.keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self.values = np.zeros(1 << SLOT_BITS)
        rest = np.arange(len(grams))
        for probe in range(self.PROBES):
            at = self.slot(grams[rest], probe)
            free = self.keys[at] == -1
            rest_, at = rest[free][::-1], at[free][::-1]  # the most frequent is written last
            self.keys[at] = grams[rest_]
            self.values[at] = nll[rest_]
            rest = rest[self.keys[self.slot(grams[rest], probe)] != grams[rest]]

    @staticmethod
    def slot(grams: np.ndarray, probe: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[probe])
        return ((grams.view(np.uint64) * factor) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and the mask of those present."""
        at = self.slot(grams, 0)
        there = self.keys[at] == grams
        values = np.where(there, self.values[at], 0.0)
        for probe in range(1, self.PROBES):
            miss = np.flatnonzero(~there)
            if not len(miss):
                break
            at = self.slot(grams[miss], probe)
            hit = self.keys[at] == grams[miss]
            values[miss[hit]] = self.values[at[hit]]
            there[miss[hit]] = True
        return values, there


def document_scores(docs: DataFrame, nll: DataFrame, lang_col: str, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(number, row, doc_id, lang, n_bytes, total) and the paths of what it reads."""
    spark = docs.sparkSession
    hot = nll.orderBy(F.desc("n_all"), "gram").limit(HOT).select("gram", "nll").toArrow()
    table = spark.sparkContext.broadcast((hot.column("gram").to_numpy(), hot.column("nll").to_numpy()))
    schema = "number long, row long, doc_id long, lang string, gram long, n long, total double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        fast = HotTable(*table.value)
        for b in small_batches(batches, "b", 1 << 19):
            numbers = b.column(0).to_pylist()
            n, total, cold = [], [], []
            for i, x in enumerate(b.column(4)):
                g = windows(x.as_py() or b"")
                v, there = fast.look_up(g)
                n.append(len(g))
                total.append(float(v.sum()))
                if not there.all():
                    u, c = np.unique(g[~there], return_counts=True)
                    cold.append((np.full(len(u), numbers[i]), u, c))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=names)
            if cold:
                r, u, c = (np.concatenate(x) for x in zip(*cold))
                none = pa.nulls(len(r), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(r), none, none, pa.nulls(len(r), pa.string()), pa.array(u), pa.array(c), pa.nulls(len(r), pa.float64())], names=names)

    text = text_bytes(docs, text_col)
    src = docs.select(F.monotonically_increasing_id().alias("number"), F.xxhash64(text).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("b"))
    path = scratch(spark, "kn-scores")
    both = saved(src.mapInArrow(run, schema), path)
    table.unpersist()
    base = both.filter("gram is null").select("number", "row", "doc_id", "lang", F.col("n").alias("n_bytes"), "total")
    rest = both.filter("gram is not null").join(nll.select("gram", "nll"), "gram").groupBy("number").agg(F.sum(F.col("n") * F.col("nll")).alias("more"))
    return base.join(rest, "number", "left").select("number", "row", "doc_id", "lang", "n_bytes", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")), [path]


def _quantile(value: str, q: float) -> Column:
    """Exact quantile of SQL ``value`` rounded to ``DIGITS``: an element, no mean of two."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY round({value}, {DIGITS}))")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, row, lang, n_bytes, perplexity (of a byte), limit and kept of every row."""
    spark = docs.sparkSession
    prepare(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT_OF - 1
    trusted = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1 and doc_id is not null")
    trusted = trusted.select("doc_id", held.alias("held"))
    counts_path = scratch(spark, "kn-counts")
    counts = saved(corpus_counts(docs, trusted.filter("not held").select("doc_id"), id_col, text_col), counts_path)
    free_shuffles(spark)
    nll_path = scratch(spark, "kn-nll")
    nll = probabilities(counts, nll_path)
    scores, paths = document_scores(docs, nll, lang_col, id_col, text_col)
    band = sum((F.when(F.col("n_bytes") >= x, 1).otherwise(0) for x in BANDS), F.lit(0))
    mean = F.when(F.col("n_bytes") > 0, F.round(F.col("total") / F.col("n_bytes"), 9))
    scores_path = scratch(spark, "kn-means")
    scores = saved(scores.select("doc_id", "row", "lang", "n_bytes", band.alias("band"), mean.alias("mean")), scores_path)
    drop_path(spark, counts_path, nll_path, *paths)
    free_shuffles(spark)

    known = scores.join(trusted.filter("held"), "doc_id", "left_semi").filter("mean is not null")
    limit = _quantile("mean - `offset`", quantile) + SLACK
    # These tables have a row for each language and band at most.
    by_lang = F.broadcast(known.groupBy("lang").agg(_quantile("mean", 0.5).alias("usual")))
    offsets = F.broadcast(known.join(by_lang, "lang").groupBy("band").agg(_quantile("mean - usual", quantile).alias("offset")))
    known = known.join(offsets, "band")
    everywhere = known.agg(limit.alias("limit")).first().limit
    limits = F.broadcast(known.groupBy("lang").agg(limit.alias("own")))
    out = scores.join(offsets, "band", "left").join(limits, "lang", "left")
    out = out.withColumn("own", F.coalesce("own", F.lit(everywhere).cast("double")) + F.coalesce("offset", F.lit(0.0)))
    return out.select(
        "doc_id",
        "row",
        "lang",
        "n_bytes",
        F.round(F.exp("mean"), 9).alias("perplexity"),
        F.round(F.exp("own"), 9).alias("limit"),
        F.coalesce(F.col("mean") <= F.col("own"), F.col("mean").isNotNull()).alias("kept"),
    )
