import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tilewright.llm import byte_bpe, packing, rans, token_store
from tilewright.llm.word_tokens import WordTokenizer

ALPHABET = [*"aAbZ .,;'s\n\t!?0123é́ΣςİßΩ中   x\0#&", "<|endoftext|>", "'re", "'S", ". ", "Ab,", "É."]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name,keep,dtype", [("byte_bpe_50k.json", True, "<u4"), ("word_bpe_49k.json", False, "<u2")])
def test_word_cache_equals_the_library(name, keep, dtype):
    own, lib = WordTokenizer(P.path(name), keep, dtype), Tokenizer.from_file(P.path(name))
    texts = random_texts(3000)
    for text, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, dtype).tolist() == lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 64), st.integers(1, 20), st.data())
def test_rans_round_trip(ids, lanes, steps, data):
    ids = np.array(ids, np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=301)), lanes, steps)
    block = coder.encode(ids)
    assert coder.decode(block).tolist() == ids.tolist()
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert coder.decode(block, a, b).tolist() == ids[a:b].tolist()


def test_added_tokens():
    for name, keep, dtype in (("byte_bpe_50k.json", True, "<u4"), ("word_bpe_49k.json", False, "<u2")):
        own, lib = WordTokenizer(P.path(name), keep, dtype), Tokenizer.from_file(P.path(name))
        added = [t.content for t in lib.get_added_tokens_decoder().values()]
        assert added
        texts = [f"a {t} b" for t in added] + [f"x{t.upper()}y {t}{t}" for t in added]
        for text, got in zip(texts, own.encode(texts)):
            assert np.frombuffer(got, dtype).tolist() == lib.encode(text, add_special_tokens=False).ids
        (special,) = {i for i, t in lib.get_added_tokens_decoder().items() if t.content == "<|endoftext|>"}
        assert special in np.frombuffer(own.encode(["a <|endoftext|> b"])[0], dtype)


def test_rans_size_and_damage():
    ids = np.random.default_rng(0).zipf(1.3, 200_000).clip(0, 5000).astype(np.uint32)
    counts = np.bincount(ids, minlength=5001)
    p = counts[counts > 0] / counts.sum()
    block = rans.Coder(rans.scaled(counts)).encode(ids)
    assert len(block) < 1.1 * (-(p * np.log2(p)).sum() * len(ids) / 8) + 20_000
    bad = bytearray(block)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.Coder(rans.scaled(counts)).decode(bytes(bad))
    assert rans.scaled(np.array([1] * 1000 + [10**12])).sum() == 1 << rans.SCALE_BITS


def expected_tokens(rows):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def key(r):
    return tuple((v is not None, v or 0) for v in r)


@pytest.mark.parametrize("shard_ids", [1 << 22, 3000])
def test_token_store(spark, odd_docs, shard_ids):
    path = P.path("word_bpe_49k.json")
    tokens = token_store.tokenized(odd_docs, path, 1).cache()
    where = token_store.scratch(spark, "t")
    manifest = token_store.write_store(tokens, where, token_store.id_counts(tokens, 49408), shard_ids=shard_ids, block_ids=1000)
    got = sorted((tuple(r) for r in token_store.read_store(manifest).collect()), key=key)
    assert got == sorted(expected_tokens([(r.doc_id, r.text) for r in odd_docs.collect()]), key=key)
    first = manifest.orderBy("shard").first()
    shard = token_store.Shard(first.path)
    ids = shard.read_range(0, first.n_ids, 1000)
    assert len(ids) == first.n_ids
    assert shard.read_range(37, min(2100, first.n_ids), 1000).tolist() == ids[37:2100].tolist()


def test_token_store_of_nothing(spark, no_docs):
    manifest = token_store.store_documents(no_docs, P.path("word_bpe_49k.json"), 1, 49408)
    assert token_store.read_store(manifest).count() == 0


RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (40, 12), (9, 4)])
def test_byte_bpe_chunks(spark, odd_docs, chunk, overlap):
    c = byte_bpe.codec(RANKS, P.PATTERN)
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate([*random_texts(150, 3), "x" * 300, " " * 200 + "y" * 100])], "doc_id long, text string")
    docs = odd_docs.filter("doc_id <> 8 or doc_id is null").select("doc_id", "text").unionByName(more) if chunk < 100 else odd_docs
    out = byte_bpe.round_trip(byte_bpe.encoded(docs, RANKS, P.PATTERN, chunk=chunk, overlap=overlap), RANKS, P.PATTERN)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(e.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_byte_bpe_of_nothing(no_docs):
    assert byte_bpe.round_trip(byte_bpe.encoded(no_docs, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def check_packing(docs, pieces, capacity=1024):
    """Every piece holds the library's ids, every id lies in one piece, and
    sequences are gapless; the padding and all ids."""
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, by_doc, by_seq = collections.Counter(), {}, {}
    all_ids = {}
    for r in docs.collect():
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
        all_ids.setdefault((r.doc_id, len(ids)), []).append(ids)
    for p in pieces:
        texts = all_ids[p.doc_id, p.doc_tokens]
        assert any(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for ids in texts)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == all_ids.keys()
    for k, own in by_doc.items():
        n = len(all_ids[k])  # repeated rows are packed once for each
        cover = np.zeros(k[1] + 1, int)
        for p in own:
            cover[p.start] += 1
            cover[p.start + p.length] -= 1
        assert (np.cumsum(cover)[:-1] == n).all()
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    sizes = [sum(p.length for p in s) for s in by_seq.values()]
    return sum(capacity - n for n in sizes if n & (n - 1)), sum(sizes)


def test_packing(spark, odd_docs):
    pieces = packing.pack(odd_docs, P.path("byte_bpe_50k.json"), 0).collect()
    padded, total = check_packing(odd_docs, pieces)
    assert padded <= 0.01 * total
    whole = [p for p in pieces if p.doc_id == 10]
    assert len(whole) == 2 and all(p.start == 0 and p.length == p.doc_tokens for p in whole)


def test_packing_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), 0).collect()
    padded, total = check_packing(docs, pieces)
    assert padded <= 0.01 * total
    assert len(pieces) < docs.count() * 1.5 + total / 1024


@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([1, 2, 64, 128]))
def test_bins(lengths, capacity):
    bins = packing.Bins(0, capacity)
    for doc, n in enumerate(lengths):
        bins.add(doc, np.full(n, doc, "<u4"))
        assert len(bins.waiting) <= 1
    bins.finish()
    got, fill = collections.Counter(), collections.Counter()
    for doc, start, n, _, total, seq, offset in bins.out:
        assert offset == fill[seq] and total == lengths[doc]
        got.update((doc, start + i) for i in range(n))
        fill[seq] += n
    assert got == collections.Counter((d, i) for d, n in enumerate(lengths) for i in range(n))
    assert all(n <= capacity and (capacity - n <= capacity / 128 or n & (n - 1) == 0) for n in fill.values())


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, P.path("byte_bpe_50k.json"), 0).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, P.path("byte_bpe_50k.json"), 0, capacity=1000)
