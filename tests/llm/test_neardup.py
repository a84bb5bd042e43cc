import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlore.llm import neardup
from hexlore.llm.common import table
from hexlore.llm.components import connected_components


def word_set(text, width=2):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    run = min(width, len(w))
    return {tuple(w[k : k + run]) for k in range(len(w) - run + 1)} if w else set()


def brute(rows, percent=80):
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in index.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            index[x].append(i)
        for j, both in seen.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((doc, len(sets[i]), (c := least.get(top(i)) if sets[i] else doc), c == doc) for i, (doc, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def copies(n=150, words=60):
    """Copies of one text, some close to the limit, and other texts."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(words)] = f"x{rng.randrange(1000)}"
        out.append((k + 100, " ".join(own)))
    return out


@pytest.mark.parametrize("kind", ["table", "copies", "edges"])
def test_equals_brute_force(spark, kind, monkeypatch):
    if kind == "table":
        docs = table(spark, "/root/testdata/sf0.01", "documents")
    elif kind == "copies":
        monkeypatch.setattr(neardup, "BLOCK_BYTES", 25_000)
        docs = spark.createDataFrame(copies(), "doc_id long, text string")
    else:
        rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "Ä b"), (8, "ä b"), (9, "one"), (9, "one"), (None, "one"), (None, "q r s"), (11, "k " * 30_000), (12, "K " * 20_000), (13, "one\x85two"), (14, "one two three four")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit("x"), "fp": F.lit(1), "th": F.lit(None)})
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(neardup.near_duplicates(docs, width=2)) == brute(rows)


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:n]


def test_regular_words_stay_apart(spark):
    """Words on which polynomials modulo powers of two collide are different words."""
    rows = [(2 * k + j, thue_morse(n, *ab)) for k, (n, pair) in enumerate([(n, p) for n in (64, 1024, 2048, 4096) for p in ("ab", "th", "qz", "01")]) for j, ab in enumerate((pair, pair[::-1]))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert len(out) == len(rows) and all(r.kept and r.component_id == r.doc_id for r in out)


def test_hashes_tell_runs_apart():
    from hexlore.llm.hashing import hash_runs

    octets = np.frombuffer(bytes(range(256)) * 4 + bytes(300), np.uint8)
    first = np.r_[np.arange(600), np.zeros(200, np.int64), np.full(150, 1030)]
    last = np.r_[np.arange(600) + 9, np.arange(200) + 1, 1030 + np.arange(150) + 1]
    runs = {}
    for h, i, j in zip(hash_runs(octets, first, last).tolist(), first.tolist(), last.tolist(), strict=True):
        assert runs.setdefault(octets[i:j].tobytes(), h) == h
    assert len(set(runs.values())) == len(runs)


@pytest.mark.parametrize("n_words", [30, 300])
def test_groups_that_stay_apart(spark, n_words, monkeypatch):
    """A template that many texts share without being similar enough, with some real pairs among them, in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 60_000)
    rng = random.Random(9)
    base, rows = [f"t{k}" for k in range(n_words)], []
    for k in range(200):
        own = list(base)
        for at in rng.sample(range(n_words), n_words // 9):
            own[at] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join([*own[:-1], "end"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(docs, width=2)) == brute(rows)


def test_empty_table(spark):
    out = neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_estimates_follow_similarity(spark):
    rng = np.random.default_rng(1)
    rows = []
    for share in (0.5, 0.8, 0.9, 1.0):
        for _ in range(20):
            both = rng.integers(0, 2**63, int(1000 * share), np.int64).view(np.uint64)
            rest = (1000 - len(both)) // 2
            x, y = (np.unique(np.r_[both, rng.integers(0, 2**63, rest, np.int64).view(np.uint64)]) for _ in range(2))
            rows.append((share, *(neardup.odd_sketch(neardup.samples(v)).tolist() for v in (x, y))))
    df = spark.createDataFrame(rows, "share double, x array<long>, y array<long>")
    got = df.groupBy("share").agg(F.avg(neardup.estimate(F.col("x"), F.col("y"))).alias("e"), F.min(neardup.estimate(F.col("x"), F.col("y"))).alias("least")).collect()
    assert all(abs(r.e - r.share) < 0.05 for r in got)
    assert all(r.least >= 0.6 for r in got if r.share >= 0.8)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (None, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(found) == 301 + 50
    assert {found[k] for k in range(301)} == {found[0]} and {found[1000 + k] for k in range(50)} == {found[1000]}


def test_deduplicated_keeps_one_row_each(spark):
    rows = [*copies(40), (1, None), (2, ""), (1, None), (3, "lone text of some words"), (3, "lone text of some words"), (3, "another lone text of words"), (None, "lone text of some words"), (None, "no id here at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("i"), "rows": F.lit(1)})
    out = neardup.deduplicated(docs, width=2)
    assert out.columns == docs.columns
    want = brute([r for r in rows if r[0] is not None and r[0] >= 100])
    got = sorted((r.doc_id, r.text) for r in out.where("doc_id >= 100").collect())
    assert [k for k, _ in got] == [k for k, _, _, kept in want if kept]
    rest = sorted(((r.doc_id, r.text) for r in out.where("doc_id < 100 or doc_id is null").collect()), key=str)
    assert rest == sorted([(1, None), (1, None), (2, ""), (3, "another lone text of words"), (None, "lone text of some words"), (None, "no id here at all")], key=str)
