import hashlib

from pyspark.sql import functions as F

from hexlore.llm import mixing
from hexlore.llm.common import table


def fill(sizes, weights=(3, 1, 2), ratio=1.5, cap=2):
    """Targets by sharing what is over the caps again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), set(names), ratio * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            out[s] += left * w[s] / total
        left = sum(max(0, out[s] - cap * sizes[s]) for s in open_)
        full = {s for s in open_ if out[s] >= cap * sizes[s]}
        for s in full:
            out[s] = cap * sizes[s]
        open_ -= full
    return out


def check(rows):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = fill(sizes)
    taken, largest = {}, {}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    return taken


def test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    once = mixing.mix(docs).orderBy("doc_id").collect()
    assert len(once) == docs.count()
    check(once)
    assert once == mixing.mix(docs.repartition(5)).orderBy("doc_id").collect()


def test_edges(spark):
    rows = [(k, "w " * (k % 7), "ab"[k % 2]) for k in range(40)] + [(None, "a b", None), (50, None, None), (51, "", "z"), (52, "x y", "\U0001f600"), (53, "x", "￮"), (3, "w w w ", "b"), (3, "w w w ", "b"), (60, "long " * 50_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("s"), "u": F.lit(None), "bin": F.lit(3)})
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    check(out)


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def plain_probabilities(sizes, missing):
    """min(1, factor * class) with the factor found by halving."""
    m = [1 << (n.bit_length() - 1) if n else 0 for n in sizes]
    low, high = 0.0, 2.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1.0, mid * x) * n for x, n in zip(m, sizes, strict=True)) < missing else (low, mid)
    return [min(1.0, high * x) for x in m]


def plain_draw(rows, missing, seed):
    """The ids of a source's rows (id, text) that a plain Pareto draw takes."""
    sizes = [len(t.split()) for _, t in rows]
    ranks = []
    for (k, t), n, p in zip(rows, sizes, plain_probabilities(sizes, missing), strict=True):
        u = (int(hashlib.md5(f"{k}|{hashlib.md5(t.encode()).hexdigest()}|{seed}|0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        ranks.append((0.0 if p > 1 - 1e-9 else u / (1 - u) * (1 - p) / p if p else 1e300, u, k, n, p))
    ahead, out = 0, set()
    for odds, _, k, n, p in sorted(ranks, key=lambda r: r[0]):
        if p and (p > 1 - 1e-9 or ahead + n / 2 <= missing):
            out.add(k)
        ahead += n
    return out, ranks


def test_unequal_inclusion(spark):
    """One source drawn by unequal probabilities: the plain draw's rows, other ones than the random numbers alone would
    give, and over seeds the share of a size class is its inclusion probability."""
    rows = [(k, "w " * (3 + 2 ** (k % 8) + k % 3)) for k in range(400)] + [(900, "w " * 9000)]
    docs = spark.createDataFrame([(k, t, "a") for k, t in rows] + [(5000 + k, "x " * 50, "b") for k in range(3000)], "doc_id long, text string, source string")
    total = sum(len(t.split()) for _, t in rows)
    kw = {"weights": (1, 1), "ratio": 2 * 0.4 * total / (total + 150_000)}  # a's target is 0.4 of its words
    shares, want = {}, None
    for seed in range(1, 13):
        got = [r for r in mixing.mix(docs, seed=seed, **kw).collect() if r.source == "a"]
        missing = got[0].target
        assert abs(missing - 0.4 * total) < 1e-6 * total
        taken = {r.doc_id for r in got if r.copies}
        want, ranks = plain_draw(rows, missing, seed)
        assert taken == want and abs(sum(r.taken for r in got) - missing) <= max(r["size"] for r in got if r.doc_id != 900) / 2 + 1
        by_u, ahead = set(), 0
        for _, u, k, n, _ in sorted(ranks, key=lambda r: r[1]):
            if ahead + n / 2 <= missing:
                by_u.add(k)
            ahead += n
        assert taken != by_u and 900 in taken
        for _, _, k, n, p in ranks:
            shares.setdefault(round(p, 6), []).append(k in taken)
    assert len(shares) > 4 and min(shares) < 0.1
    assert all(abs(sum(hits) / len(hits) - p) < 0.08 for p, hits in shares.items())


def test_repeated_rows_are_drawn_apart(spark):
    """Equal rows have ranks of their own: targets are met within half a document, the outcome is the same every time."""
    rows = [(None, "w " * 10, "b") for _ in range(400)] + [(k, "w " * 10, "a") for k in range(600)] + [(7, "v " * 5, "c"), (7, "v " * 5, "c"), (7, "v " * 5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    check(out)
    outcome = lambda rows: sorted((str(r.doc_id), r.source, r["size"], r.copies) for r in rows)
    assert outcome(out) == outcome(mixing.mix(docs.repartition(3)).collect()) == outcome(mixing.mix(docs.coalesce(1)).collect())
    copies = mixing.mixed(docs.withColumn("twin", F.lit("x"))).groupBy("doc_id", "source", "text").count().collect()
    want = {}
    for r in out:
        want[r.doc_id, r.source, r["size"]] = want.get((r.doc_id, r.source, r["size"]), 0) + r.copies
    assert {(r.doc_id, r.source, len(r.text.split())): r["count"] for r in copies} == {k: n for k, n in want.items() if n}


def test_many_sources(spark, monkeypatch):
    """More sources than are broadcast: the same targets, in order of names over several ranges."""
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 10)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 300).cast("string")).alias("source"))
    check(mixing.mix(docs).collect())


def test_mixed_rows_are_the_copies(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumns({"copies": F.lit("c"), "u": F.lit(1)})
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    assert out.distinct().subtract(docs).count() == 0
