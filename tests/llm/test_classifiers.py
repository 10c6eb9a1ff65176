import collections
import math
import re

import numpy as np
import pytest

from tilewright.llm import kneser_ney as KN
from tilewright.llm import langid, repetition
from tilewright.llm.common import WordHashes

SF = "/root/testdata/sf0.01"


def test_language_of_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.fold() == 2)
    profiles = langid.train(docs.filter("not held_out"))
    got = langid.identify(docs, profiles, keep=("held_out", "lang")).filter("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_brute_force():
    texts = {"en": "the cat and the other cat", "de": "die Katze und der Hund"}
    profiles = {}
    for name, text in texts.items():
        keys, n = np.unique(langid.grams(text), return_counts=True)
        profiles[name] = langid.ranked(keys, n, 50).tolist()
    model = langid.Profiles(profiles, profile_size=50, doc_grams=30)

    def slow(text):
        c = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            p = "\1" + w + "\1"
            c.update(w)
            c.update(p[i : i + 3] for i in range(len(p) - 2))
            c.update(p[i : i + 2] for i in range(len(p) - 1))
        code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
        # the blank between two words is one blank, so it joins the pairs of both
        own = sorted(((code(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))[:30]
        return {n: sum(abs(i - p.index(g)) if g in p else 50 for i, (g, _) in enumerate(own)) for n, p in profiles.items()}

    for text in ("the dog and the cat", "der Hund und die Katze"):
        d = slow(text)
        assert model.predict(text)[0] == min(d, key=d.get)
    assert model.predict(None) == model.predict("12 ### !") == ("und", 0.0)


def test_training_brute_force(spark):
    """Profiles, predictions and scores of a table with dicts and strings alone."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()

    def counted(text):
        c = collections.Counter()
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", text.lower())]
        for w in words:
            c.update(w)
            c.update(w[i : i + 2] for i in range(len(w) - 1))
            p = " " + w + " "
            c.update(p[i : i + 3] for i in range(len(p) - 2))
        c.update(" " + w[0] for w in words)  # the blank before the first word, and between two
        c.update(w[-1] + " " for w in words)
        return c

    def order(c, size):
        key = lambda g: [1 if ch == " " else ord(ch) for ch in g]
        code = lambda g: sum(v << 21 * (len(g) - 1 - i) for i, v in enumerate(key(g)))
        return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:size]]

    import zlib

    by = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            by[r.lang].update(counted(r.text))
    slow = {lang: {g: i for i, g in enumerate(order(c, langid.PROFILE_SIZE))} for lang, c in by.items()}
    from tilewright.llm import queries

    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        own = order(counted(r.text or ""), langid.DOC_GRAMS)
        if not own:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        d = {lang: sum(abs(i - p[g]) if g in p else langid.PROFILE_SIZE for i, g in enumerate(own)) for lang, p in slow.items()}
        best = min(sorted(d), key=d.get)
        assert x.lang_pred == best and x.score == pytest.approx(1 - d[best] / (langid.PROFILE_SIZE * len(own)))


def test_held_out_without_id(spark, tmp_path):
    from tilewright.llm import queries

    rows = [(None, "the cat and the dog", "en"), (1, "der Hund und die Katze", "de"), (2, "the house and the cat", "en"), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.held_out for r in queries.op6_language_id(spark, str(tmp_path)).collect()}
    assert got[None] is False and all(v in (True, False) for v in got.values()) and len(got) == 4


def test_language_odd(spark, odd_docs, no_docs):
    profiles = langid.train(odd_docs)
    got = {r.doc_id: r for r in langid.identify(odd_docs, profiles, keep=("gram", "n")).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == got[7].lang_pred == "und" and got[1].lang_pred in ("en", "de")
    assert langid.train(no_docs) == {} and langid.identify(no_docs, {}).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}


def test_repetition_brute_force():
    rules, cache = repetition.RepetitionRules(), WordHashes()
    texts = ["", "one two", "a b c a b c a b c d", "x y\nx y\n\nx y\nz", "été été été été\n|été|", "# $ word\nword *", "p q r s t u v w p q r s t u v w " * 5]
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        own = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.strip()]
        got = repetition.measure(t.encode(), rules, cache)
        failed = len(w) < 50 or 100 * len(own) > 50 * len(w)
        assert got[:6] == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(own), failed)
        assert not (got[6] and failed)
        for (k, _), n in zip(rules.duplicated, got[9]):
            g = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            assert n == sum(len(w[j]) for j in {j for i in range(len(w) - k + 1) if g[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})


def test_repetition_odd(odd_docs, no_docs):
    got = repetition.repetition_quality(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[4].n_words == by[5].n_words == by[6].n_words == 0 and by[4].base_failed and by[1].kept
    assert repetition.repetition_quality(no_docs).count() == 0


def slow_model(texts):
    """Interpolated modified Kneser-Ney over bytes, with dicts."""
    n = KN.ORDER
    counts = [collections.Counter() for _ in range(n + 1)]
    for t in texts:
        b = bytes(n - 1) + t.encode()
        counts[n].update(b[i : i + n] for i in range(len(b) - n + 1))
    for m in range(n - 1, 0, -1):
        counts[m].update(g[1:] for g in counts[m + 1])
    off, total, freed = {}, {}, {}
    for m in range(1, n + 1):
        c = collections.Counter(counts[m].values())
        off[m] = KN.discounts(*(c[i] for i in (1, 2, 3, 4)))
        total[m], freed[m] = collections.Counter(), collections.Counter()
        for g, k in counts[m].items():
            total[m][g[:-1]] += k
            freed[m][g[:-1]] += off[m][min(k, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        m, lower = len(g), p(g[1:])
        if g[:-1] not in total[m]:
            return lower
        k = counts[m][g]
        return ((k - off[m][min(k, 3) - 1] if k else 0) + freed[m][g[:-1]] * lower) / total[m][g[:-1]]

    def mean(t):
        b = bytes(n - 1) + t.encode()
        s = [-math.log(p(b[i : i + n])) for i in range(len(b) - n + 1)]
        return sum(s) / len(s)

    return mean, p


def test_kneser_ney_brute_force(spark, monkeypatch):
    import zlib

    monkeypatch.setattr(KN, "HOT", 40)  # most windows then go the way of the joins
    texts = ["the cat sat on the mat and the cat ran", "a dog and the cat", "abracadabra abracadabra", "été où ça", "zzz qqq", ""]
    rows = [(i, texts[i % 5] + f" {i}", "en") for i in range(20)] + [(20, "", "en"), (21, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 if i % 5 < 3 else 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in KN.quality(docs, labels).collect()}
    train = [t for i, t, _ in rows[:20] if i % 5 < 3 and zlib.crc32(str(i).encode()) % 4 != 3]
    mean, p = slow_model(train)
    for i, t, _ in rows[:20]:
        assert got[i].perplexity == pytest.approx(math.exp(mean(t)), rel=1e-6)
        assert got[i].kept == (got[i].perplexity <= got[i].limit)
    assert not got[20].kept and not got[21].kept and got[21].lang == "und" and got[20].perplexity is None
    context = b"the "
    assert sum(p(context + bytes([b])) for b in range(256)) == pytest.approx(1.0)


def test_kneser_ney_keeps_clean(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = KN.quality(docs, labels).join(labels, "doc_id").collect()
    clean, junk = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.2


def test_limits_of_languages(spark):
    import zlib

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trusted = {r.doc_id for r in labels.filter("quality = 1").collect()} - {r.doc_id for r in labels.filter("quality = 0").collect()}
    rows = [(r, sum(r.n_bytes >= x for x in KN.BANDS)) for r in KN.quality(docs, labels).filter("perplexity is not null").collect()]
    held = [(r.lang, b, math.log(r.perplexity)) for r, b in rows if r.doc_id in trusted and zlib.crc32(str(r.doc_id).encode()) % 4 == 3]
    at = lambda x, q: sorted(round(v, KN.DIGITS) for v in x)[max(math.ceil(q * len(x)) - 1, 0)]
    usual = {g: at([m for lang, _, m in held if lang == g], 0.5) for g in {x[0] for x in held}}
    offset = {k: at([m - usual[g] for g, b, m in held if b == k], KN.QUANTILE) for k in {x[1] for x in held}}
    own = {k: at([m - offset[b] for g, b, m in held if g == k], KN.QUANTILE) + KN.SLACK for k in usual}
    assert len(own) == 4 and len(set(own.values())) == 4
    for r, b in rows:
        assert math.log(r.limit) == pytest.approx(own[r.lang] + offset.get(b, 0), abs=1e-6)


def test_two_languages_with_few_rows(spark):
    """Three held-out documents of each language are enough for a limit of its own."""
    import zlib

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 3]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 3]
    plain, odd = "the cat and the dog sat on the mat ", "qwfp arst zxcv neio luyj "
    rows = [(i, plain * 3, "en") for i in train[:60]] + [(i, plain * 3, "en") for i in held[:3]] + [(i, plain + odd * 2, "de") for i in held[3:6]]
    rows += [(1000, odd * 3, "en"), (1001, plain + odd * 2, "de"), (1002, plain * 3, "fr")]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] < 1000], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in KN.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert got[held[0]].limit < got[held[3]].limit
    assert not got[1000].kept and got[1001].kept and got[1002].kept and got[1002].limit > 0


def test_kneser_ney_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 1, 1), (8, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert KN.quality(odd_docs, labels).count() == odd_docs.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert KN.quality(no_docs, none).count() == 0
    assert all(r.kept for r in KN.quality(odd_docs, none).collect() if r.n_bytes)
