import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexlore.llm import tokens, wordbpe
from hexlore.llm.common import table
from hexlore.llm.hashing import slices
from hexlore.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def bpe():
    return wordbpe.load(vocabulary())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=3000):
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x300), 0x3A3, 0x130, 0x1E9E, 0x2028, 0x85, 0xA0, 0x3000, 0x200B, 0x558, 0x1C89, 0xFB01, 0x1100, 0x1161, 0xAC00, *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F610)]]
    pool += ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "'re", "aaaa", "haha", "   ", "\n", "''", "x'd"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 5000, "ab" * 9000, "ΑΣ ΣΑΣ", "x" * 50_000, "don't they'll", "<|endoftext|>" * 3]


def test_merges_build_on_earlier_ones(bpe):
    assert bpe.ordered


def test_ids_equal_the_library(bpe, library):
    texts = odd_texts()
    got = [i for _, part in slices(pa.array(texts), 3000) for i in bpe.token_ids(part.to_pylist())]
    assert [i.tolist() for i in got] == [ids(library, t) for t in texts]


def test_every_code_point(bpe, library):
    texts = [f"a{chr(c)}b1{chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert [i.tolist() for i in bpe.token_ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:n]


def test_regular_words_keep_their_own_ids(bpe, library):
    """Words of a pattern and its complement, on which weak hashes collide, also where a memo has met one before."""
    texts = [thue_morse(n, *ab) for n in (16, 32, 64, 1024, 2048, 8192) for pair in ("ab", "th", "qz", "zx", "éa") for ab in (pair, pair[::-1])]
    for part in (texts, texts[::-1], texts[1::2], texts[::2]):
        assert [i.tolist() for i in bpe.token_ids(part)] == [ids(library, t) for t in part]


def test_words_that_share_a_hash(library, monkeypatch):
    """With a hash that tells long words apart by their sizes alone, words are still told apart by their characters."""
    monkeypatch.setattr(wordbpe, "hash_runs", lambda octets, first, last, view: 100 * (last - first).astype(np.uint64) + np.where(last - first > 8, 0, octets[first]).astype(np.uint64))
    bpe = wordbpe.WordBpe(vocabulary())
    texts = ["internationalism counterexamples", "misunderstanding underestimating", "a b c, internationalist; 1 2 3", "counterexamples " * 3, "ééééééééééé èèèèèèèèèèè", "x" * 60 + " " + "y" * 60]
    for _ in range(2):
        assert [i.tolist() for i in bpe.token_ids(texts)] == [ids(library, t) for t in texts]


def test_long_words_merge_like_short_ones(bpe):
    rng = random.Random(3)
    for pool in ("ab", "etaoinshrdlu", "x", "ha"):
        word = "".join(rng.choice(pool) for _ in range(3000))
        octets = np.frombuffer(word.encode(), np.uint8)
        flat = np.r_[bpe.inner[octets[:-1]], bpe.last[octets[-1:]]]
        assert bpe.merge_long(flat).tolist() == bpe.merge(flat.copy(), np.array([len(flat)]))[0].tolist()


def test_code_points_beyond_the_tables(bpe, library):
    """Code points without a class here are classed as the library does, next to letters, numbers, signs and spaces."""
    unknown = np.flatnonzero(wordbpe.classes() == wordbpe.UNKNOWN)
    texts = [f"A{c}b 1{c}2 !{c}? {c}{c} {c}'s É{c}" for c in map(chr, [*unknown[::5000].tolist(), *unknown[:20].tolist()])]
    assert [i.tolist() for i in bpe.token_ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_slices_cover_the_column():
    column = pa.array(["a" * 5, None, "", "b" * 50, "c", "dd"] * 4)
    for most in (1, 6, 60, 10_000):
        found = list(slices(column, most))
        assert [v for _, part in found for v in part.to_pylist()] == column.to_pylist()
        assert [at for at, _ in found] == np.cumsum([0, *[len(p) for _, p in found]])[:-1].tolist()


def test_memo_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "MEMO_WORDS", 20)
    bpe = wordbpe.WordBpe(vocabulary())
    for k in range(5):
        texts = [f"word{k}x{j} other" for j in range(30)]
        assert bpe.token_counts(texts).tolist() == [len(ids(library, t)) for t in texts]


def test_merge_handles_overlaps(bpe):
    flat, size = np.array([bpe.inner[ord("a")]] * 5 + [bpe.inner[ord("b")]]), np.array([5, 1])
    _, rows = bpe.merge(flat.copy(), size)
    assert set(rows.tolist()) == {0, 1}


def test_query_counts(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: (len(r.text.encode()), len(ids(library, r.text))) for r in docs.collect()}
    got = tokens.count_tokens(docs, vocabulary()).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (None, "hello"), (3, "é" * 3000), (3, "é" * 3000), (4, "word " * 2048), (5, "word " * 2049)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "id": F.lit(1)})
    got = sorted(map(tuple, tokens.count_tokens(docs, vocabulary()).collect()), key=str)
    assert got == sorted(((k, len((t or "").encode()), n := len(ids(library, t)), n > 2048) for k, t in rows), key=str)
    assert tokens.count_tokens(docs.limit(0), vocabulary()).count() == 0
