"""Embedding near-dedup (operator 10): an epsilon grid order join on leading principal axes.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so all links lie within one epsilon. Vectors are rotated onto leading
principal axes (fitted on a bounded sample; any axes give the same links, good ones skip more), laid in lexicographic
order of their epsilon cells, and cut into blocks of consecutive vectors of bounded bytes, level by level, as many as
the table needs. Block pairs whose boxes are further apart than epsilon are never made. A task joins two blocks recursively, halving the sequence intervals and dropping pairs of
intervals whose boxes are provably distant; what remains is compared by matrix products, close calls in double
precision. A task returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlore.llm.common import cut_lineage, join_hot
from hexlore.llm.components import connected_components

#: Vectors, and their bytes, on which the axes are fitted.
SAMPLE, SAMPLE_BYTES = 8192, 16_000_000
#: Bytes of the vectors of a block, the leading axes of the grid, and the interval below which the recursion multiplies.
BLOCK_BYTES, AXES, LEAF = 4_200_000, 6, 512
#: Dot products of unit vectors in single precision err by less.
CLOSE = 1e-4
#: Parts that one level cuts a block into, at most, and vectors looked at for each border.
MOST_CUTS, PER_BORDER = 1024, 16


def usable(values: np.ndarray) -> bool:
    return values.ndim == 1 and len(values) > 0 and bool(np.isfinite(values).all()) and bool(values.any())


def units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that squares neither overflow nor vanish."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, fp, dim, raw (packed doubles) for each row; fp, dim and raw are null where the vector can't link."""
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType([source.schema["id"], T.StructField("fp", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("raw", T.BinaryType())])

    def run(batches):
        for batch in batches:
            fps, dims, raws = [], [], []
            column = batch.column(1)
            flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                v = flat[begin:end] + 0.0  # no negative zeros
                good = usable(v)
                raw = v.tobytes() if good else None
                fps.append(xxhash.xxh3_128_digest(raw) if good else None)
                dims.append(len(v) if good else None)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


class Grid:
    """Axes by dimension and the epsilon of the cells."""

    def __init__(self, sample: list[tuple[int, bytes]], epsilon: float) -> None:
        self.epsilon, self.axes = epsilon, {}
        for dim in {d for d, _ in sample}:
            x = units(np.frombuffer(b"".join(r for d, r in sample if d == dim), np.float64).reshape(-1, dim))
            centred = x - x.mean(axis=0)
            if len(x) < dim:  # from products of the vectors, which are fewer than the dimensions
                scale, own = np.linalg.eigh(centred @ centred.T)
                own = own[:, ::-1][:, : min(AXES, int((scale > 1e-9).sum()) or 1)]
                axes = np.linalg.qr(centred.T @ own)[0]
            else:
                _, axes = np.linalg.eigh(centred.T @ centred)  # in order of rising variance
                axes = axes[:, ::-1][:, : min(AXES, dim)]
            self.axes[dim] = np.ascontiguousarray(axes)

    def place(self, dim: int, x: np.ndarray) -> np.ndarray:
        # Dimensions that the sample has not met get their own first axes.
        return x @ self.axes[dim] if dim in self.axes else x[:, :AXES]

    def cells(self, dim: int, x: np.ndarray) -> np.ndarray:
        return np.floor(self.place(dim, x) / self.epsilon).astype(np.int64)


def in_blocks(laid: DataFrame) -> DataFrame:
    """laid (dim, cells, fp, ...) with block: runs of the order by cells and fp that hold BLOCK_BYTES or so.

    Each level cuts the blocks that are too large at the quantiles of a few of their vectors (fingerprints are random,
    so those of a range of hashes are a sample), until none is.
    """
    out = cut_lineage(laid.withColumn("block", F.col("dim").cast("string")))
    room = F.greatest(F.lit(32), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    while True:
        sizes = out.groupBy("dim", "block").agg(F.count(F.lit(1)).alias("n"))
        large = cut_lineage(sizes.where(F.col("n") > 2 * room).select("block", "n", F.least(F.lit(MOST_CUTS), F.ceil(F.col("n") / room)).cast("int").alias("cuts")))
        if large.isEmpty():
            return out
        share = F.least(F.lit(1.0), F.lit(float(PER_BORDER)) * F.col("cuts") / F.col("n"))
        met = join_hot(out, large, "block", "n").where(F.col("cuts").isNotNull())
        # At least some of a block's vectors are looked at, those whose hashes are in the share.
        seen = met.where(F.pmod(F.xxhash64("fp", "block"), F.lit(1 << 20)) < F.greatest(share, F.lit(1e-6)) * (1 << 20))
        keys = seen.groupBy("block", "cuts").agg(F.sort_array(F.collect_list(F.struct("cells", "fp"))).alias("keys"))
        at = F.transform(F.sequence(F.lit(1), F.col("cuts") - 1), lambda k: F.get("keys", F.floor(F.size("keys") * k / F.col("cuts")).cast("int")))
        borders = cut_lineage(keys.select("block", F.array_distinct(at).alias("borders")).join(large.select("block", "n"), "block"))
        own = F.struct("cells", "fp")
        part = F.size(F.filter("borders", lambda b: b <= own))
        known = F.when(F.col("borders").isNotNull(), F.concat_ws(".", "block", part.cast("string"))).otherwise(F.col("block"))
        out = cut_lineage(join_hot(out, borders, "block", "n").withColumn("block", known).drop("borders"))


class Side:
    """One block's unit vectors in grid order, with their places on the axes."""

    def __init__(self, grid: Grid, dim: int, fps: bytes, raws: bytes, copies: bytes) -> None:
        x = units(np.frombuffer(raws, np.float64).reshape(-1, dim))
        order = np.lexsort(grid.cells(dim, x).T[::-1])
        self.fps = np.frombuffer(fps, "V16")[order]
        self.copies = np.frombuffer(copies, np.int64)[order]
        self.x = x[order]
        self.short = self.x.astype(np.float32)
        self.place = grid.place(dim, self.x)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in self.boxes:
            self.boxes[i, j] = self.place[i:j].min(axis=0), self.place[i:j].max(axis=0)
        return self.boxes[i, j]


def far(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, epsilon: float) -> bool:
    gap = np.maximum(0, np.maximum(low - high2, low2 - high))
    return float((gap * gap).sum()) > epsilon * epsilon + 1e-9


class BlockJoin:
    """Links between two blocks, or within one."""

    def __init__(self, a: Side, b: Side | None, least: float, epsilon: float) -> None:
        self.a, self.b, self.least, self.epsilon = a, b or a, least, epsilon
        self.within, self.shift = b is None, 0 if b is None else len(a.x)
        n = len(a.x) + (0 if b is None else len(b.x))
        self.links, self.top = np.zeros(n, np.int64), np.arange(n)
        self.join(0, len(a.x), 0, len(self.b.x))

    def join(self, i: int, j: int, k: int, m: int) -> None:
        if self.within and k < i or far(*self.a.box(i, j), *self.b.box(k, m), self.epsilon):
            return
        if j - i <= LEAF and m - k <= LEAF:
            self.leaf(i, j, k, m)
            return
        halves = lambda p, q: [(p, q)] if q - p <= LEAF else [(p, (p + q) // 2), ((p + q) // 2, q)]
        for i2, j2 in halves(i, j):
            for k2, m2 in halves(k, m):
                self.join(i2, j2, k2, m2)

    def leaf(self, i: int, j: int, k: int, m: int) -> None:
        dots = self.a.short[i:j] @ self.b.short[k:m].T
        hit = dots >= self.least + CLOSE
        r, c = np.nonzero((dots >= self.least - CLOSE) & ~hit)
        if len(r):
            exact = np.einsum("ij,ij->i", self.a.x[i + r], self.b.x[k + c]) >= self.least
            hit[r[exact], c[exact]] = True
        if self.within and i == k:
            hit = np.triu(hit, 1)
        if not hit.any():
            return
        self.links[i:j] += hit @ self.b.copies[k:m]
        self.links[self.shift + k : self.shift + m] += self.a.copies[i:j] @ hit
        r, c = np.nonzero(hit)
        r, c = r + i, c + k + self.shift
        # Only roots are hooked, each to a lower one, so nothing that earlier leaves joined comes apart.
        while True:
            a, b = self.top[r], self.top[c]
            apart = a != b
            if not apart.any():
                break
            r, c, a, b = r[apart], c[apart], a[apart], b[apart]
            np.minimum.at(self.top, np.maximum(a, b), np.minimum(a, b))
            while (self.top != (up := self.top[self.top])).any():
                self.top = up

    def result(self) -> pa.Table:
        fps = self.a.fps if self.within else np.concatenate([self.a.fps, self.b.fps])
        rows = np.flatnonzero((self.links > 0) | (self.top != np.arange(len(self.top))))
        names = lambda at: pa.array([v.tobytes() for v in fps[at]], pa.binary())
        return pa.table({"fp": names(rows), "other": names(self.top[rows]), "links": pa.array(self.links[rows])})


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors of one length link when their cosine in double precision is at least least; n_links counts the other rows
    linked directly, component_id is the least id that links reach, kept says that it is the row's own. Vectors that
    are null, empty, zero, or hold nulls or non-finite numbers link with nothing (0 links, their own id, kept true), as
    do vectors of different lengths. Rows of null or repeated ids are rows of their own, null ids never being the least
    of a component that has another. An empty table gives no rows; further columns are not read.
    """
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * least)))
    rows = cut_lineage(packed(vectors, id_col, vector_col))
    classes = rows.where("fp is not null").groupBy("fp").agg(
        F.min("id").alias("label"), F.count(F.lit(1)).alias("copies"), F.any_value("dim").alias("dim"), F.any_value("raw").alias("raw"),
    )
    classes = cut_lineage(classes)
    # Fingerprints are random, so the least ones are a sample.
    first = classes.select("fp", "dim").orderBy("fp").limit(SAMPLE).collect()
    held = np.cumsum([8 * r.dim for r in first])
    last = bytes(first[max(0, int(np.searchsorted(held, SAMPLE_BYTES, "right")) - 1)].fp) if first else b""
    sample = sorted((r.dim, bytes(r.raw)) for r in classes.where(F.col("fp") <= F.lit(last)).select("dim", "raw").collect())
    grid = Grid(sample, epsilon)

    def dealt(batches):
        for batch in batches:
            dims, raws = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cells = [None] * len(dims)
            for dim in set(dims):
                own = [k for k, d in enumerate(dims) if d == dim]
                found = grid.cells(dim, units(np.frombuffer(b"".join(raws[k] for k in own), np.float64).reshape(-1, dim)))
                for k, c in zip(own, found.tolist(), strict=True):
                    cells[k] = c
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int64()))], names=["fp", "dim", "cells"])

    # Blocks are found from cells and fingerprints alone.
    laid = in_blocks(classes.select("fp", "dim", "raw").mapInArrow(dealt, "fp binary, dim int, cells array<long>"))
    laid = laid.select("fp", "block").join(classes.select("fp", "dim", "raw", "copies"), "fp")

    def gather(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        fps, raws = (b"".join(group.column(c).to_pylist()) for c in ("fp", "raw"))
        copies = group.column("copies").to_numpy().astype(np.int64).tobytes()
        place = grid.place(dim, units(np.frombuffer(raws, np.float64).reshape(-1, dim)))
        return pa.table({"block": [key[1].as_py()], "dim": pa.array([dim], pa.int32()), "low": [place.min(axis=0).tolist()], "high": [place.max(axis=0).tolist()], "fps": pa.array([fps], pa.large_binary()), "raws": pa.array([raws], pa.large_binary()), "copies": pa.array([copies], pa.large_binary())}).cast(block_schema)

    block_schema = pa.schema([("block", pa.string()), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("fps", pa.binary()), ("raws", pa.binary()), ("copies", pa.binary())])
    blocks = laid.groupBy("dim", "block").applyInArrow(gather, "block string, dim int, low array<double>, high array<double>, fps binary, raws binary, copies binary")
    blocks = cut_lineage(blocks)

    # Blocks meet in the cells of the first axis that they reach; what is then further apart than epsilon is dropped.
    reach = lambda margin: F.explode(F.sequence(F.floor((F.col("low")[0] - margin) / epsilon), F.floor((F.col("high")[0] + margin) / epsilon)))
    box = lambda c: F.struct("low", "high").alias(c)
    x = blocks.select(F.col("block").alias("i"), "dim", box("p"), reach(epsilon + 1e-9).alias("cell"))
    y = blocks.select(F.col("block").alias("j"), "dim", box("q"), reach(0.0).alias("cell"))
    gaps = F.zip_with(F.zip_with("p.low", "q.high", lambda u, v: u - v), F.zip_with("q.low", "p.high", lambda u, v: u - v), lambda u, v: F.greatest(F.lit(0.0), u, v))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= epsilon * epsilon + 1e-9
    pairs = x.join(y, ["dim", "cell"]).where(F.col("i") <= F.col("j")).where(near).select("i", "j").distinct()
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).join(blocks.drop("low", "high"), "block")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("block").to_pylist()).tolist()
        parts = [{c: group.column(c)[k].as_py() for c in ("dim", "fps", "raws", "copies")} for k in order]
        made = [Side(grid, p["dim"], p["fps"], p["raws"], p["copies"]) for p in parts]
        return BlockJoin(made[0], made[1] if len(made) > 1 else None, least, epsilon).result()

    found = sides.groupBy("i", "j").applyInArrow(compare, "fp binary, other binary, links long")
    found = cut_lineage(found)
    counts = found.groupBy("fp").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    labels = classes.select("fp", "label", "copies").join(counts, "fp", "left").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    labels = labels.select("fp", "label", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "fp").alias("root"))
    labels = cut_lineage(labels)
    firsts = cut_lineage(labels.groupBy("root").agg(F.min("label").alias("component_id"), F.count(F.lit(1)).alias("members")))
    labels = cut_lineage(join_hot(labels, firsts, "root", "members").select("fp", "n_links", "component_id", "copies"))
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = join_hot(rows.select("id", "fp"), labels, "fp", "copies")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
