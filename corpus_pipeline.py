"""The corpus pipeline: language ID, quality classifier, near-dedup, substring
dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet in the shared folder and reads it again as the next one's input.

Rows are told apart by doc_id and text, so a decision holds for its own row,
also where rows share a doc_id or have none; rows that repeat both are one
document for near-dedup, which keeps one of them.  Documents whose text a stage
empties go.  Columns beyond those of ``documents`` pass through, whatever their
names; null and empty texts leave at the first stage, and an empty table gives
empty results.  Texts are never cut short.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import kneser_ney, langid, packing, setsketch, substring
from tilewright.llm.common import drop_path, free_shuffles, saved, scratch

#: A text is in no learned language where it is less like its profile than all
#: but this share of the held-out documents of that language, less a margin.
LANGUAGE_QUANTILE, LANGUAGE_MARGIN = 0.001, 0.05
#: The limit of a language without held-out documents.
LEAST_SCORE = 0.3


def _aside(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but ``own`` under names that no operator uses, and those names."""
    names = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.withColumnsRenamed(names), list(names.values())


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in its order, from what ``_aside`` renamed."""
    here = set(df.columns)
    return df.select(*(F.col(f"__column_{i}").alias(c) if f"__column_{i}" in here else F.col(c) for i, c in enumerate(docs.columns)))


def _kept(docs: DataFrame, decisions: DataFrame, *also: str) -> DataFrame:
    """The rows of ``docs`` that were kept, by doc_id, text (``row``) and the columns ``also``."""
    keys = ["doc_id", "row", *also]
    ids = decisions.filter("kept").select(*(F.col(k).alias(f"__kept_{k}") for k in keys)).distinct()
    own = {"doc_id": docs["doc_id"], "row": F.xxhash64(docs["text"].cast("binary"))}
    same = [(own[k] if k in own else F.coalesce(docs[k], F.lit("und"))).eqNullSafe(ids[f"__kept_{k}"]) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return docs.join(ids, on, "left_semi")


def _limits(docs: DataFrame, profiles: dict) -> dict[str, float]:
    """Least score of each language, from held-out rows that are in it."""
    held = docs.filter((langid.fold() == 2) & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").alias("__lang"))
    scores = langid.identify(held, profiles, keep=("__lang",)).filter("__lang = lang_pred")
    low = F.expr(f"percentile_disc({LANGUAGE_QUANTILE}) WITHIN GROUP (ORDER BY round(score, 4))")
    found = {r.lang_pred: r.low for r in scores.groupBy("lang_pred").agg(low.alias("low")).collect()}  # a row a language
    return {lang: max(found[lang] - LANGUAGE_MARGIN, 0.0) if lang in found else LEAST_SCORE for lang in profiles}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; trained on three quarters of the labelled rows."""
    profiles = langid.train(docs.filter(langid.fold() != 2))
    limits = _limits(docs, profiles)
    own, rest = _aside(docs, "doc_id", "text")
    found = langid.identify(own, profiles, keep=("text", *rest))
    enough = F.lit(False)
    for lang, least in sorted(limits.items()):
        enough = enough | ((F.col("lang_pred") == lang) & (F.col("score") >= least))
    return _back(found.filter(enough), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's limit of perplexity."""
    return _kept(docs, kneser_ney.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _kept(docs, setsketch.near_duplicates(docs)).dropDuplicates(["doc_id", "text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; those with no word left go."""
    own, rest = _aside(docs, "doc_id", "text")
    out = substring.substring_dedup(own, keep=tuple(rest), with_text=True).filter("n_words > n_removed")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.trim("kept_text")).otherwise(F.col("kept_text")))
    if "n_chars" in docs.columns:
        at = f"__column_{docs.columns.index('n_chars')}"
        out = out.withColumn(at, F.length("text").cast(docs.schema["n_chars"].dataType))
    return _back(out, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]

#: SQL can express neither the language model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}")
        docs = saved(stage(spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
        free_shuffles(spark)
    return docs
