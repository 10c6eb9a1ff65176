"""The pipeline's stages against plain Python over small tables."""

import hashlib
import math
import random
import re
import zlib

import corpus_pipeline as C
import pytest
from test_dedup import near_truth, substring_truth

from tilewright.llm import kneser_ney, langid
from tilewright.llm.common import saved, scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def truth_language(rows):
    """Profiles by the operator's own model (held against brute force elsewhere), limits and verdicts by hand."""
    fold = lambda d: zlib.crc32(str(d).encode()) % 4 if d is not None else None
    by = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and fold(r["doc_id"]) not in (2, None):
            by.setdefault(r["lang"], []).append(r["text"])
    import numpy as np

    profiles = {}
    for lang, texts in by.items():
        keys, n = np.unique(np.concatenate([langid.grams(t) for t in texts]), return_counts=True)
        profiles[lang] = langid.ranked(keys, n, langid.PROFILE_SIZE).tolist()
    model = langid.Profiles(profiles)
    got = [model.predict(r["text"]) for r in rows]
    limits = {}
    for lang in profiles:
        s = sorted(round(score, 4) for r, (p, score) in zip(rows, got) if fold(r["doc_id"]) == 2 and r["lang"] == p == lang)
        limits[lang] = max(s[max(math.ceil(C.LANGUAGE_QUANTILE * len(s)) - 1, 0)] - C.LANGUAGE_MARGIN, 0) if s else C.LEAST_SCORE
    return [r for r, (p, score) in zip(rows, got) if p in limits and score >= limits[p]]


def truth_quality(rows, labels):
    """The model with dicts, limits by sorting."""
    from test_classifiers import slow_model

    low = {}
    for d, q in labels:
        low[d] = min(low.get(d, 9), q)
    trusted = {d for d, q in low.items() if q == 1}
    held = {d for d in trusted if zlib.crc32(str(d).encode()) % 4 == 3}
    mean, _ = slow_model([r["text"] for r in rows if r["doc_id"] in trusted - held and r["text"]])
    value = [round(mean(r["text"]), 9) if r["text"] else None for r in rows]
    band = [sum(len((r["text"] or "").encode()) >= x for x in kneser_ney.BANDS) for r in rows]
    own = [(r["lang"] or "und", b, v) for r, b, v in zip(rows, band, value) if r["doc_id"] in held and v is not None]
    at = lambda x, q: sorted(round(v, kneser_ney.DIGITS) for v in x)[max(math.ceil(q * len(x)) - 1, 0)]
    usual = {g: at([m for lang, _, m in own if lang == g], 0.5) for g, _, _ in own}
    offset = {k: at([m - usual[g] for g, b, m in own if b == k], kneser_ney.QUANTILE) for _, k, _ in own}
    less = [(g, m - offset[b]) for g, b, m in own]
    limit = {k: at([m for g, m in less if g == k], kneser_ney.QUANTILE) + kneser_ney.SLACK for k in usual}
    everywhere = at([m for _, m in less], kneser_ney.QUANTILE) + kneser_ney.SLACK if less else math.inf
    return [r for r, b, v in zip(rows, band, value) if v is not None and v <= limit.get(r["lang"] or "und", everywhere) + offset.get(b, 0) + 1e-9]


def truth_near(rows):
    kept = {d for d, _, _, keep in near_truth([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None]) if keep}
    out, seen = [], set()
    for r in rows:
        if (r["doc_id"] in kept or r["doc_id"] is None) and (r["doc_id"], r["text"]) not in seen:
            seen.add((r["doc_id"], r["text"]))
            out.append(r)
    return out


def truth_substring(rows):
    """doc_id, words kept of each document that keeps any."""
    got = substring_truth([(r["doc_id"], r["text"]) for r in rows])
    return sorted((d, n - gone, sha) for d, n, gone, sha in got if n > gone)


def key(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["lang"] or "") for r in rows)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """300 documents of three made-up languages with copies, near copies, shared passages and junk."""
    r = random.Random(11)
    vocab = {g: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)] for g, letters in {"aa": "abcdeio", "bb": "mnopqru", "cc": "stuvwxyé"}.items()}
    passage = [r.choice(vocab["aa"]) for _ in range(60)]
    rows = []
    for d in range(300):
        g = r.choice(["aa", "aa", "bb", "cc"])
        w = [r.choice(vocab[g]) for _ in range(r.randint(30, 120))]
        if r.random() < 0.1:
            w = w[:10] + passage + w[10:]
        if rows and r.random() < 0.15:
            w = r.choice(rows)["text"].split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "zz"
        if r.random() < 0.05:
            w = ["".join(r.choice("#%0123456789qz") for _ in range(9)) for _ in range(50)]
        rows.append({"doc_id": d, "text": " ".join(w), "lang": r.choice([g, g, g, None]), "source": "s", "n_chars": 0})
    folder = tmp_path_factory.mktemp("small")
    labels = [(d, 1 if "#" not in rows[d]["text"] and "%" not in rows[d]["text"] else 0) for d in range(0, 300, 2)]
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([tuple(x.values()) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows, labels


def test_each_stage_and_run(spark, small):
    folder, rows, labels = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kinds = docs.columns, docs.dtypes
    assert [n for n, _ in C.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "substring dedup", "packing"]
    truths = [truth_language, lambda x: truth_quality(x, labels), truth_near]
    lost = []
    for k, truth in enumerate(truths):
        want = truth(rows)
        docs = saved(C.STAGES[k][1](spark, docs, folder), scratch(spark, f"t{k}"))
        assert docs.columns == columns and docs.dtypes == kinds
        got = [x.asDict() for x in docs.collect()]
        assert key(got) == key(want)
        lost.append(len(rows) - len(want))
        rows = got
    assert lost[1] > 0 and lost[2] > 10
    want = truth_substring(rows)
    docs = saved(C.STAGES[3][1](spark, docs, folder), scratch(spark, "t3"))
    got = [x.asDict() for x in docs.collect()]
    words = [(x["doc_id"], WORD.findall(x["text"])) for x in got]
    assert docs.columns == columns and all(x["n_chars"] == len(x["text"]) for x in got)
    assert sorted((d, len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for d, w in words) == want and len(want) < len(rows) + 1
    pieces = C.STAGES[4][1](spark, docs, folder)
    again = C.run(spark, folder)
    total = ["doc_id", "doc_tokens"]
    assert sorted(map(tuple, pieces.select(*total).distinct().collect())) == sorted(map(tuple, again.select(*total).distinct().collect()))
    assert {x.doc_id for x in again.select("doc_id").collect()} == {d for d, _, _ in want}
    from test_tokens import check_packing

    check_packing(docs, again.collect())


def test_rows_of_one_id_and_clashing_columns(spark, small, tmp_path):
    """A decision holds for its own row; extra columns pass through."""
    folder, rows, labels = small
    clean = [r["text"] for r in rows if "#" not in r["text"] and "%" not in r["text"]]
    junk = "#%8q z0%#1 " * 30
    extra = [(900, clean[0] + " more", "aa"), (900, junk, "aa"), (None, clean[5] + " x y", "aa"), (None, junk + "1", "aa"), (901, None, None), (902, "", "bb"), (903, " ".join(clean[:40] * 20), "aa")]
    table = [(r["doc_id"], r["text"], r["lang"], "s", 0, 0.5, 7, True, "a", 1, "row", 2.0) for r in rows] + [(d, t, g, "s", 0, 0.5, 7, True, "a", 1, "row", 2.0) for d, t, g in extra]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, kept boolean, lang_pred string, number int, row string, n double")
    docs = saved(docs, str(tmp_path / "d"))
    columns, kinds = docs.columns, docs.dtypes
    for k in range(4):
        docs = saved(C.STAGES[k][1](spark, docs, folder), scratch(spark, f"x{k}"))
        assert docs.columns == columns and docs.dtypes == kinds
        assert docs.filter("score <> 0.5 or row <> 'row' or n <> 2.0").count() == 0
        if k == 1:
            left = {(r.doc_id, r.text == junk or r.text == junk + "1") for r in docs.filter("doc_id is null or doc_id >= 900").collect()}
            assert left == {(900, False), (None, False), (903, False)}
    assert C.STAGES[4][1](spark, docs, folder).count() > 0


def test_nothing(spark, small):
    folder, _, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(C.STAGES):
        docs = saved(stage(spark, docs, folder), scratch(spark, f"n{k}"))
        assert docs.count() == 0


def test_run_keeps_most(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = C.run(spark, SF).select("doc_id").distinct()
    assert got.count() > 0.5 * docs.count() and got.join(docs, "doc_id", "left_anti").count() == 0
