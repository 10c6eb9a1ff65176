import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tilewright.llm import setsketch, substring
from tilewright.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def near_truth(rows, similarity=75, k=5):
    """Components by comparing all pairs of sets."""
    sets, up = {}, {}
    for doc, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets.setdefault(doc, []).append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
        up[doc] = doc

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= similarity * len(x | y):
                        p, q = root(a), root(b)
                        up[max(p, q)] = min(p, q)
    return {(d, len(sets[d][0]), root(d), root(d) == d) for d in ids}


def variants(seed, groups=12, copies=7):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"v{r.randrange(3000)}" for _ in range(r.randint(3, 150))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = variants(seed)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r)[:4] for r in got.collect()} == near_truth(rows)


def template(seed, n=90, words=60):
    """Fillings of one template: most pairs share a bucket and few are alike enough."""
    r = random.Random(seed)
    base = [f"t{i}" for i in range(words)]
    rows = []
    for d in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 2, 3, 3])):
            w[r.randrange(words)] = f"f{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows_,elements", [(1 << 12, 1 << 22), (7, 1 << 22), (1 << 12, 700)])
def test_large_buckets(spark, monkeypatch, rows_, elements):
    monkeypatch.setattr(setsketch, "SMALL_BUCKET", 3)
    monkeypatch.setattr(setsketch, "STAR_LINKS", 0)  # nothing is joined before
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(setsketch, "BLOCK_ELEMENTS", elements)
    rows = template(rows_)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r)[:4] for r in got.collect()} == near_truth(rows)


def test_shared_counts():
    r = np.random.default_rng(2)
    x, y = ([np.unique(np.concatenate([np.arange(r.integers(0, 40)), r.integers(0, 900, r.integers(0, 60))])) for _ in range(n)] for n in (50, 70))
    assert (setsketch.shared_counts(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()
    reps, groups = np.arange(120) * 3, np.arange(120)
    sets = [np.arange(30) + k // 40 * 1000 for k in range(120)]
    for blocks in (np.zeros(120, int), np.arange(120) % 2):
        a, b = setsketch.block_links(reps, groups, sets, blocks, 75)
        up = {int(v): int(v) for v in reps}
        for p, q in zip(a.tolist(), b.tolist()):
            assert p // 120 == q // 120
            while up[p] != p:
                p = up[p]
            while up[q] != q:
                q = up[q]
            up[max(p, q)] = min(p, q)
        assert sum(k == v for k, v in up.items()) == 3 and len(a) < 400


def test_near_duplicates_of_repeated_ids(spark):
    text = lambda k: " ".join(f"r{k}_{i}" for i in range(40))
    rows = [(5, text(1)), (5, text(2)), (3, text(1)), (9, text(2) + " x"), (12, text(3)), (12, text(3)), (13, text(4)), (13, text(5)), (20, text(5))]
    got = {(r.doc_id, r.component_id) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (12, 12), (13, 13), (20, 13)}


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    got = sorted(setsketch.near_duplicates(odd_docs).collect(), key=str)
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[1].kept and not by[2].kept
    for d in (4, 5, 6):
        assert (by[d].n_shingles, by[d].component_id, by[d].kept) == (0, d, True)
    assert by[None].component_id is None and by[None].kept
    assert by[10].n_shingles == 1 and by[10].component_id == 10
    assert setsketch.near_duplicates(no_docs).count() == 0


def test_sketches():
    factors = setsketch.multipliers()
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**63, 600, dtype=np.uint64), r.integers(0, 2**63, 400, dtype=np.uint64)
    ka, kb = setsketch.registers(a, factors), setsketch.registers(b, factors)
    both = setsketch.registers(np.concatenate([a, b]), factors)
    assert (np.maximum(ka, kb) == both).all()
    for share in (0.3, 0.75, 0.95):
        same = int(600 * share)
        other = np.concatenate([a[:same], b[: 600 - same]])
        truth = same / (1200 - same)
        k = setsketch.registers(other, factors)
        n = np.array([600.0])
        assert abs(setsketch.likeliest(ka[None], k[None], n, n)[0] - truth) < 0.12
    w = setsketch.digests(ka)
    assert w.shape == (setsketch.WORDS,) and (setsketch.digests(ka) == w).all()


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, r.randrange(101, 160)) for _ in range(80)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    up = list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    got = {(x.node, x.component) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {(v, root(v)) for v in ends}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def substring_truth(rows, n=20):
    """Windows in order of (doc_id, hash of the text, start); rows that repeat
    doc_id and text are one document."""
    seen, out = {}, []
    for doc, h, text in sorted(((d, xxhash.xxh64_intdigest((t or "").encode(), 42), t) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] - (r[1] >> 63 << 64))):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            at = seen.setdefault(tuple(w[i : i + n]), (doc, h, i))
            if at != (doc, h, i):
                gone[i : i + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=40):
    r = random.Random(seed)
    shared = [[f"s{k}_{r.randrange(50)}" for _ in range(r.randint(15, 60))] for k in range(4)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(shared) if r.random() < 0.4 else [f"u{r.randrange(10**6)}" for _ in range(r.randint(1, 40))]
        if r.random() < 0.1:
            w += ["again"] * r.randint(5, 60)
        rows.append((d, r.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("first_words", [5, 10, 20])
def test_substring(spark, first_words):
    rows = passages(first_words)
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), first_words=first_words)
    assert sorted((tuple(r) for r in got.collect()), key=str) == substring_truth(rows)


def test_substring_of_repeated_ids(spark):
    """Ids that stand on two texts, copies of the second under other ids, rows without id."""
    r = random.Random(8)
    text = lambda k: " ".join(f"p{k}_{i}" for i in range(22 + k % 5))
    rows = []
    for i in range(300):
        rows += [(i, text(2 * i)), (i, text(2 * i + 1)), (1000 + i, text(2 * i + 1))]
    rows += [(None, text(5000 + i % 7)) for i in range(20)] + [(2000 + i, text(5000 + i)) for i in range(7)]
    rows += [(3000, text(6000)), (3000, text(6000)), (3000, text(6000) + " " + text(1))]
    r.shuffle(rows)
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = sorted((tuple(x) for x in got.collect()), key=str)
    assert got == substring_truth(rows)
    removed = {x[0]: x[2] for x in got}
    assert all(removed[1000 + i] == 22 + (2 * i + 1) % 5 for i in range(300)) and all(removed[2000 + i] for i in range(7))


def test_substring_odd(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = substring.substring_dedup(odd_docs, keep=("lang", "gram", "n", "row"), with_text=True)
    assert set(got.columns) == {"doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "lang", "gram", "n", "row"}
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == substring_truth(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].kept_text == "" and by[11].kept_text == rows[12][1].split("\n")[0] + "\n"
    assert substring.substring_dedup(no_docs).count() == 0


def test_levels():
    assert substring.levels_of(20, 10) == [10] and substring.levels_of(20, 5) == [5, 10] and substring.levels_of(20, 20) == []
