import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlore.llm import vectordup


def brute(rows, least=0.9):
    n = len(rows)
    link = np.zeros((n, n), bool)
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v in rows]
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= least
    top = list(range(n))
    for _ in range(n):
        new = [min([top[i], *[top[j] for j in np.flatnonzero(link[i])]]) for i in range(n)]
        if new == top:
            break
        top = new
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[top[i]] = min(low.get(top[i], k), k)
    return sorted(((k, int(link[i].sum()), c := low.get(top[i]) if good[i] else k, c == k) for i, (k, _) in enumerate(rows)), key=str)


def clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    x = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.25, 0.32], (n, 1))
    x[n // 2 : n // 2 + n // 8] = x[0]
    return [(int(k), [float(v) for v in row]) for k, row in zip(rng.permutation(n), x.astype(np.float32), strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, small, monkeypatch):
    if small:  # many blocks, deep recursion
        monkeypatch.setattr(vectordup, "BLOCK_BYTES", 40 * 8 * 8)
        monkeypatch.setattr(vectordup, "MOST_CUTS", 3)
        monkeypatch.setattr(vectordup, "LEAF", 7)
        monkeypatch.setattr(vectordup, "SAMPLE", 100)
    rows = clusters(400, 8, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vectordup.near_vectors(df).collect()), key=str) == brute(rows)


class Told:
    """A side whose products with the other side are the numbers given."""

    def __init__(self, x):
        self.x, self.short, self.copies = x, x.astype(np.float32), np.ones(len(x), np.int64)


def joined(links, n, m, leaves):
    """The labels after leaves over links (row, column) between n and m vectors."""
    dots = np.zeros((n, m))
    dots[tuple(np.array(links).T)] = 1.0
    join = vectordup.BlockJoin.__new__(vectordup.BlockJoin)
    join.a, join.b, join.least, join.within, join.shift = Told(np.eye(n)), Told(dots.T.copy()), 0.9, False, n
    join.links, join.top = np.zeros(n + m, np.int64), np.arange(n + m)
    for leaf in leaves:
        join.leaf(*leaf)
    return join.top.tolist()


def components(links, n, m):
    top = list(range(n + m))
    for r, c in links:
        a, b = sorted((top[r], top[n + c]))
        top = [a if t == b else t for t in top]
    return top


def test_a_leaf_keeps_the_links_of_earlier_ones():
    # Two trees, then a third that meets both in one leaf: rows 1 and 2 with columns 1 and 2, row 10 with columns 11 and 12.
    links = [(1, 1), (2, 2), (10, 11), (10, 12), (21, 1), (21, 11), (22, 2), (22, 12)]
    leaves = [(0, 8, 0, 8), (8, 16, 8, 16), (16, 24, 0, 16)]
    assert joined(links, 24, 16, leaves) == components(links, 24, 16)


@pytest.mark.parametrize("seed", range(10))
def test_sparse_chains_across_leaves(seed):
    rng = np.random.default_rng(seed)
    n, step = 60, 5
    links = sorted({(int(r), int(c)) for r, c in rng.integers(0, n, (n, 2))})
    leaves = [(i, i + step, k, k + step) for i in range(0, n, step) for k in range(0, n, step)]
    rng.shuffle(leaves)
    assert joined(links, n, n, leaves) == components(links, n, n)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted(map(tuple, vectordup.near_vectors(df).collect()), key=str) == brute(rows)


def test_wide_vectors(spark, monkeypatch):
    """Blocks follow bytes, so wide vectors make more of them; fewer vectors than dimensions still have axes."""
    monkeypatch.setattr(vectordup, "BLOCK_BYTES", 32 * 8 * 300)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(5, 300))
    rows = [(k, (base[k % 5] + rng.normal(size=300) * rng.choice([0.1, 0.3, 0.35])).tolist()) for k in range(200)]
    assert sorted(map(tuple, vectordup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str) == brute(rows)


def test_blocks_grow_with_the_table(spark, monkeypatch):
    """Every block is within bounds, and blocks are runs of the grid order, however many levels that takes."""
    monkeypatch.setattr(vectordup, "BLOCK_BYTES", 40 * 8 * 4)
    monkeypatch.setattr(vectordup, "MOST_CUTS", 4)
    rng = np.random.default_rng(1)
    rows = [(rng.bytes(16), 4, [int(c) for c in rng.integers(0, 3, 2)]) for _ in range(3000)]
    laid = vectordup.in_blocks(spark.createDataFrame(rows, "fp binary, dim int, cells array<long>")).collect()
    assert len(laid) == 3000
    blocks = {}
    for r in sorted(laid, key=lambda r: (r.cells, bytes(r.fp))):
        blocks.setdefault(r.block, []).append((r.cells, bytes(r.fp)))
    assert max(map(len, blocks.values())) <= 80
    ordered = [k for own in blocks.values() for k in own]
    assert ordered == sorted(ordered)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.1]), (9, [-1.0, 0.0]), (None, [1.0, 0.05]), (7, [1.0, 0.0]), (10, [1.0]), (11, [3.0]), (12, [1e300, 1e290]), (13, [1e-300, 0.0]), (None, [0.0, 1.0, 0.0]), (14, [-0.0, 1.0]), (15, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"fp": F.lit(1), "n_links": F.lit("x"), "block": F.lit(2)})
    assert sorted(map(tuple, vectordup.near_vectors(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    for rows in ([], [(1, None)]):
        out = vectordup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert [tuple(r) for r in out.collect()] == [(k, 0, k, True) for k, _ in rows]
