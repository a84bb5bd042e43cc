"""Clustering: scaling, k-means sweeps, exact distances in blocks, density and tree clusters, profiles and labels."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlore.functions.nulls import complete, quantiles
from hexlore.operators.shape import drop_sparse, in_order

#: Exact pairwise operations compare all rows with all rows, in blocks of vectors of so many bytes.
BLOCK_BYTES = 2_000_000
#: Clusters whose tree is built in one task; more are merged pair by pair over blocks until so many are left.
MOST_TREE_ROWS = 8000
#: The indicators that cells are clustered by.
INDICATORS = [
    "rent_change_total", "rent_change_recent", "rent_acceleration", "neighborhood_rent_pressure",
    "demo_density", "demo_recent", "demo_trend",
    "vulnerability_index", "rent_burden_proxy", "median_income", "poverty_rate", "pct_renter",
    "rent_change_total_lag", "demo_density_lag", "vulnerability_index_lag",
]


def inputs(cells: DataFrame, key: str, indicators: list[str] = INDICATORS, limit: float = 50.0) -> tuple[DataFrame, list[str]]:
    """key and indicators of the cells with enough data that miss none of those kept, and their names.

    An indicator of which limit percent or more are missing is left out.
    """
    rows = cells.where("sufficient_data").select(key, *indicators)
    rows, left = drop_sparse(rows, indicators, limit)
    return rows.where(complete(rows, left)), left


def standardise(df: DataFrame, vector: str, out: str):
    """df with a centred and scaled vector column, and the fitted scaler for new rows."""
    vectors = df.withColumn("v_", array_to_vector(F.col(vector).cast("array<double>")))
    model = StandardScaler(inputCol="v_", outputCol=out, withMean=True, withStd=True).fit(vectors)
    return model.transform(vectors).drop("v_"), model


@dataclass
class Fit:
    k: int
    cost: float
    model: object


def best_kmeans(df: DataFrame, features: str, k: int, restarts: int = 25, iterations: int = 100, seed: int = 42, jobs: int = 8) -> Fit:
    """The k-means of lowest cost among restarts from different seeds, jobs of them at a time; the first of equals."""
    with ThreadPoolExecutor(jobs) as pool:
        fits = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, maxIter=iterations, featuresCol=features, predictionCol="cluster").fit(df), range(restarts)))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return Fit(k, best.summary.trainingCost, best)


def sweep_kmeans(df: DataFrame, key: str, features: str, ks, restarts: int = 25, iterations: int = 100, seed: int = 42) -> list[tuple[int, float, float]]:
    """(k, cost, mean silhouette) of the best k-means of each k; all fits go through the rows together."""
    from hexlore.operators.sweep import sweep

    return sweep(df.select(F.col(key).alias("k"), vector_to_array(features).alias("v")), list(ks), restarts, iterations, seed)


def kmeans_labels(df: DataFrame, key: str, vector: str, k: int, restarts: int = 25, iterations: int = 100, seed: int = 42) -> DataFrame:
    """key, cluster (from 0) by the k-means of lowest cost among restarts, which go through the rows together.

    A pass of all restarts is one job of one stage, so the driver's load doesn't grow with them.
    """
    from hexlore.operators.sweep import fitted, labelled, spread

    rows = spread(df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")))
    _, centres = fitted(rows, [k], restarts, iterations, seed)[k]
    return labelled(rows, {k: centres}).select(F.col("k").alias(key), F.col(f"l{k}").alias("cluster"))


def choose_k(silhouettes: dict[int, float], least: int = 4) -> int:
    """The k of the best silhouette (the first of equals), least at least."""
    return max(max(sorted(silhouettes), key=lambda k: silhouettes[k]), least)


def over_blocks(
    df: DataFrame, key: str, vector: str, summarise, schema: str, *, block_bytes: int | None = None, least_blocks: int = 1,
    measures: tuple[int, int] | None = None, **extra: Column,
) -> DataFrame:
    """Runs summarise(a, b) for every pair of blocks of rows (a and b the same within one) and gathers what it returns.

    Blocks are of rows by hash of the key and hold block_bytes (BLOCK_BYTES) of vectors on average; each is one packed row that goes
    to the tasks of its pairs, two at a time. Rows compare with all rows because the operation asks for all distances;
    only summaries of a pair of blocks leave a task. a and b are dictionaries of arrays: k, v (a matrix) and extra.
    measures are the numbers of rows and of dimensions, where they are known.
    """
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), *[c.alias(name) for name, c in extra.items()])
    total, wide = measures or rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n = max(least_blocks, math.ceil(total * 8 * (wide or 1) / (block_bytes or BLOCK_BYTES)))
    packed = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).cast("int").alias("own")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    sides = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sides = sides.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rows")

    names = ["k", *extra]

    def unpacked(rows: pa.Scalar) -> dict[str, np.ndarray]:
        values = rows.values
        out = {c: values.field(c).to_numpy(zero_copy_only=False) for c in names}
        return out | {"v": values.field("v").flatten().to_numpy().reshape(len(out["k"]), -1)}

    def run(pair: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in pair)
        sides = {o.as_py(): unpacked(r) for o, r in zip(group.column("own"), group.column("rows"), strict=True)}
        found = summarise(sides[i], sides[j], i == j) if i in sides and j in sides else []
        return pa.table(dict(zip(arrow.names, found, strict=True))).cast(arrow) if found else arrow.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return sides.groupBy("i", "j").applyInArrow(run, schema)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences, so that small ones are exact."""
    return np.stack([np.sqrt(((y - row) ** 2).sum(axis=1)) for row in x])


def both_ways(d: np.ndarray, a: dict, b: dict, same: bool) -> list[tuple[np.ndarray, dict, dict]]:
    """The distances as seen from a, and from b if that is another block."""
    return [(d, a, b)] if same else [(d, a, b), (d.T, b, a)]


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label, silhouette (Euclidean, exact); 0 for members alone in their cluster or with no other cluster."""
    names = df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("l"))

    def sums(a, b, same):
        out = []
        for d, x, y in both_ways(distances(a["v"], b["v"]), a, b, same):
            kinds, at = np.unique(y["l"].astype(str), return_inverse=True)
            total = np.stack([d[:, at == c].sum(axis=1) for c in range(len(kinds))], axis=1)
            out.append((np.repeat(x["k"], len(kinds)), np.repeat(x["l"].astype(str), len(kinds)), np.tile(kinds, len(x["k"])), total.ravel(), np.tile(np.bincount(at), len(x["k"]))))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    tagged = F.coalesce(F.col(label).cast("string"), F.lit("NA"))
    parts = over_blocks(
        df, key, vector, sums, "k long, own string, c string, total double, n long", l=tagged,
    ).groupBy("k", "own", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    a = F.max(F.when((F.col("c") == F.col("own")) & (F.col("n") > 1), F.col("total") / (F.col("n") - 1)))
    b = F.min(F.when(F.col("c") != F.col("own"), F.col("total") / F.col("n")))
    both = parts.groupBy("k").agg(a.alias("a"), b.alias("b")).join(names, "k")
    return both.select(F.col("k").alias(key), F.col("l").alias(label), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def knn_distance(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, knn_dist: the distance to the k-th nearest other row."""
    def near(a, b, same):
        out = []
        for d, x, _ in both_ways(distances(a["v"], b["v"]), a, b, same):
            if same:
                np.fill_diagonal(d, np.inf)
            m = min(k, d.shape[1])
            out += zip(x["k"].tolist(), np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1).tolist(), strict=True)
        return [list(c) for c in zip(*out, strict=True)]

    parts = over_blocks(df, key, vector, near, "k long, best array<double>")
    merged = parts.groupBy("k").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.select(F.col("k").alias(key), F.get("best", F.lit(k - 1)).alias("knn_dist"))


def dbscan(df: DataFrame, key: str, vector: str, eps: float, least: int = 5, rounds: int = 50) -> DataFrame:
    """key, is_core, cluster: 0 is noise, clusters are numbered from 1 by their least core key.

    Core rows have least rows within eps, themselves included. Clusters are the components of core rows within eps of
    each other, found by contraction (an error if they don't settle in that many rounds, each of which leaves at most
    half the roots that have links); a border row joins its lowest-numbered one. Rows are compared twice, for counts
    and for links: pairs of blocks give a spanning forest of their core rows, and core neighbours of rows that are none
    (fewer than least each), never all pairs.
    """
    def counted(a, b, same):
        hit = distances(a["v"], b["v"]) <= eps
        seen = both_ways(hit, a, b, same)
        return [np.concatenate([x["k"] for _, x, _ in seen]), np.concatenate([h.sum(axis=1) for h, _, _ in seen])]

    near = over_blocks(df, key, vector, counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    cores = _settled(near.select("k", (F.col("n") >= least).alias("is_core")))
    core = cores.where("is_core").select("k")

    def linked(a, b, same):
        hit = distances(a["v"], b["v"]) <= eps
        if same:
            np.fill_diagonal(hit, False)
        top = np.arange(len(hit) + (0 if same else len(b["k"])))
        r, c = np.nonzero(hit & a["core"][:, None] & b["core"][None, :])
        keep = r < c if same else np.ones(len(r), bool)
        x, y = r[keep], c[keep] + (0 if same else len(hit))
        while len(x):
            low, high = np.minimum(top[x], top[y]), np.maximum(top[x], top[y])
            apart = low != high
            x, y, low, high = x[apart], y[apart], low[apart], high[apart]
            np.minimum.at(top, high, low)
            while (top != (up := top[top])).any():
                top = up
        keys = a["k"] if same else np.concatenate([a["k"], b["k"]])
        moved = np.flatnonzero(top != np.arange(len(top)))
        out = [(keys[moved], keys[top[moved]], np.ones(len(moved), bool))]
        for h, p, q in both_ways(hit, a, b, same):
            i, j = np.nonzero(h & ~p["core"][:, None] & q["core"][None, :])
            out.append((p["k"][i], q["k"][j], np.zeros(len(i), bool)))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    flagged = df.join(cores.withColumnRenamed("k", key), key)
    found = _settled(over_blocks(flagged, key, vector, linked, "src long, dst long, core boolean", core=F.col("is_core")))
    links = found.where("core").select("src", "dst")
    label = _components(core, links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), rounds)
    ids = in_order(label.select("root").distinct(), [F.col("root")], "id").withColumn("id", (F.col("id") + 1).cast("int"))
    named = label.join(ids, "root").select(F.col("k").alias("dst"), "id")
    border = found.where("not core").join(named, "dst").groupBy(F.col("src").alias("k")).agg(F.min("id").alias("border"))
    own = named.withColumnRenamed("dst", "k").withColumnRenamed("id", "own")
    out = cores.join(own, "k", "left").join(border, "k", "left")
    return out.select(F.col("k").alias(key), "is_core", F.coalesce("own", "border", F.lit(0)).cast("int").alias("cluster"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, n of all clusters, with the number of noise rows (cluster 0) and the largest cluster number beside."""
    n = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    told = n.agg(F.coalesce(F.sum(F.when(F.col("cluster") == 0, F.col("n"))), F.lit(0)).alias("n_noise"), F.max("cluster").alias("n_clusters"))
    return n.join(F.broadcast(told))


def _components(core: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """k, root: each core with the least core that links (src, dst, both ways) reach.

    Each round every root takes its least neighbour or itself as parent, parents are followed to the top by pointer
    doubling, and links are drawn anew between tops. Parents never exceed their children, so tops are least keys.
    """
    label = _settled(core.select("k", F.col("k").alias("root")))
    edges = _settled(links.where("src <> dst").select("src", "dst").distinct())
    for _ in range(rounds):
        if edges.isEmpty():
            return label
        jump = _settled(edges.groupBy(F.col("src").alias("k")).agg(F.min("dst").alias("p")).select("k", F.least("k", "p").alias("root")))
        for _ in range(64):  # each doubles the reach of the last
            up = jump.select(F.col("k").alias("root"), F.col("root").alias("next"))
            after = _settled(jump.join(up, "root").select("k", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            jump = after.select("k", "root")
            if after.where("moved").isEmpty():
                break
        top = jump.select(F.col("k").alias("root"), F.col("root").alias("next"))
        label = _settled(label.join(top, "root", "left").select("k", F.coalesce("next", "root").alias("root")))
        src, dst = (jump.select(F.col("k").alias(c), F.col("root").alias(f"r_{c}")) for c in ("src", "dst"))
        drawn = edges.join(src, "src").join(dst, "dst").where("r_src <> r_dst")
        edges = _settled(drawn.select(F.col("r_src").alias("src"), F.col("r_dst").alias("dst")).distinct())
    if edges.isEmpty():
        return label
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")


def _settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    from hexlore.sources.tables import checkpointed

    return checkpointed(df)


def ward(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, cluster from Ward's tree cut into k, numbered by first key; one task up to MOST_TREE_ROWS, else over blocks."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    if rows.count() > MOST_TREE_ROWS:
        return ward_over_blocks(rows, k).withColumnRenamed("k", key)

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k").reset_index(drop=True)
        return pd.DataFrame({"k": rows.k, "cluster": cut_tree(ward_merges(np.stack(rows.v.to_numpy())), len(rows), k)})

    out = rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(cut, "k long, cluster int")
    return out.withColumnRenamed("k", key)


def ward_over_blocks(rows: DataFrame, k: int) -> DataFrame:
    """k, cluster from (k, v): the same tree as in one task, for any number of rows.

    Copies are one cluster from the start. Each round every cluster knows its nearest one, and all pairs that are each
    other's nearest merge; merging brings no cluster nearer to another, so the order of merges changes nothing, and only
    what merged or was next to it looks anew, at all clusters, in pairs of blocks. Once few clusters are left, one task
    merges them. Merges are edges between keys; without the highest k - 1 of them the components are the clusters.
    """
    from hexlore.sources.tables import free_shuffles

    edge = "struct<gap:double,mix:long,lo:long,hi:long>"
    own = rows.groupBy("v").agg(F.min("k").alias("k"), F.count(F.lit(1)).cast("double").alias("size"))
    first = _settled(own.select("k", "v", "size", F.lit(0.0).alias("top"), F.lit(None).cast(edge).alias("best")))
    live, made, turn, looked = first, [], 0, False
    left, wide = first.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    while left > MOST_TREE_ROWS:
        turn += 1
        parts = over_blocks(live, "k", "v", _nearest_by_ward, "k long, gap double, mix long, lo long, hi long", measures=(left, wide), size=F.col("size"), stale=F.col("best").isNull())
        found = parts.groupBy("k").agg(F.min(F.struct("gap", "mix", "lo", "hi")).alias("found"))
        told = live.join(found, "k", "left").select("k", "v", "size", "top", F.coalesce("best", "found").alias("best"))
        groups = _settled(told.groupBy("best").agg(F.sort_array(F.collect_list(F.struct("k", "v", "size", "top"))).alias("of")))
        merged, unmet = groups.agg(F.count_if(F.size("of") == 2), F.count_if(F.col("best").isNull())).first()
        if unmet:
            raise ValueError("vectors must be finite and of one length")
        x, y = F.col("of")[0], F.col("of")[1]
        pairs = groups.where(F.size("of") == 2)
        height = F.greatest(F.sqrt("best.gap"), x["top"], y["top"])
        made.append(_settled(pairs.select(F.col("best.lo").alias("lo"), F.col("best.hi").alias("hi"), height.alias("height"), F.lit(turn).alias("turn"), F.lit(0).alias("at"))))
        mean = F.zip_with(x["v"], y["v"], lambda p, q: (p * x["size"] + q * y["size"]) / (x["size"] + y["size"]))
        joined = pairs.select(F.col("best.lo").alias("k"), mean.alias("v"), (x["size"] + y["size"]).alias("size"), height.alias("top"), F.lit(None).cast(edge).alias("best"))
        single = groups.where(F.size("of") == 1).select(F.inline("of"), "best")
        gone = made[-1].select(F.explode(F.array("lo", "hi")).alias("other"), F.lit(True).alias("gone"))
        single = single.withColumn("other", F.when(F.col("k") == F.col("best.lo"), F.col("best.hi")).otherwise(F.col("best.lo"))).join(gone, "other", "left")
        # Among equal gaps an edge to a new cluster may be passed over; if so no pair is left, and all look anew.
        none = not merged
        if none and looked:
            raise RuntimeError("no two clusters are each other's nearest")
        looked = none
        single = single.select("k", "v", "size", "top", F.when(F.col("gone").isNull() & F.lit(not none), F.col("best")).alias("best"))
        live, left = _settled(joined.unionByName(single)), left - merged
        free_shuffles(rows.sparkSession)

    def rest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k").reset_index(drop=True)
        merges = ward_merges(np.stack(rows.v.to_numpy()), rows["size"].to_numpy(), rows.top.to_numpy())
        a, b, heights = (np.array(c) for c in zip(*merges, strict=True)) if merges else ([], [], [])
        keys = rows.k.to_numpy()
        return pd.DataFrame({"lo": keys[np.asarray(a, int)], "hi": keys[np.asarray(b, int)], "height": heights, "turn": turn + 1, "at": np.arange(len(merges))})

    schema = "lo long, hi long, height double, turn int, at int"
    edges = live.drop("best").withColumn("all", F.lit(1)).groupBy("all").applyInPandas(rest, schema)
    for m in made:
        edges = edges.unionByName(m)
    edges = _settled(edges)
    # A later merge is higher in the tree where heights are equal.
    high = edges.orderBy(F.desc("height"), F.desc("turn"), F.desc("at"), "lo", "hi").limit(max(0, k - 1)).select("lo", "hi")
    kept = edges.join(F.broadcast(high), ["lo", "hi"], "left_anti")
    links = kept.select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    label = _components(first.select("k"), links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), 64)
    ids = in_order(label.select("root").distinct(), [F.col("root")], "id")
    named = label.join(ids, "root").join(first.select("k", "v"), "k").select("v", (F.col("id") + 1).cast("int").alias("cluster"))
    return rows.join(named, "v").select("k", "cluster")


def _nearest_by_ward(a: dict, b: dict, same: bool) -> list[np.ndarray]:
    """k, gap, mix, lo, hi: for each cluster without a nearest one that of the other block.

    Products find what may be nearest within their error; that is measured by differences, alike from both sides. Of
    equal gaps the first by a mix of both keys counts, so that many equal ones don't all choose one partner.
    """
    out = []
    for x, y in [(a, b)] if same else [(a, b), (b, a)]:
        if not len(y["k"]):
            continue
        square_y, error = (y["v"] ** 2).sum(axis=1), 8 * (y["v"].shape[1] + 8) * np.finfo(float).eps
        stale = np.flatnonzero(x["stale"])
        for at in np.array_split(stale, max(1, math.ceil(len(stale) / 256))):
            v, size = x["v"][at], x["size"][at]
            square = (v**2).sum(axis=1)
            weight = 2 * size[:, None] * y["size"] / (size[:, None] + y["size"])
            gap = np.maximum(square[:, None] + square_y - 2 * (v @ y["v"].T), 0) * weight
            if same:
                gap[np.arange(len(at)), at] = np.inf
            bound = gap.min(axis=1, initial=np.inf) + 4 * size * error * (square + square_y.max())
            i, j = np.nonzero((gap <= bound[:, None]) & np.isfinite(gap))
            exact = ((v[i] - y["v"][j]) ** 2).sum(axis=1) * weight[i, j]
            lo, hi = np.minimum(x["k"][at[i]], y["k"][j]), np.maximum(x["k"][at[i]], y["k"][j])
            mix = _mixed(lo, hi)
            order = np.lexsort((hi, lo, mix, exact, i))
            order = order[np.unique(i[order], return_index=True)[1]]
            out.append((x["k"][at[i[order]]], exact[order], mix[order], lo[order], hi[order]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _mixed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Numbers that pairs of keys are ordered by as if at random."""
    h = lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))).astype(np.int64)


def ward_merges(x: np.ndarray, sizes: np.ndarray | None = None, tops: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(a, b, height) of each merge by nearest-neighbour chains; a and b are any member rows of what merges.

    Rows may be clusters with sizes and heights (tops) of their own; no merge is lower than what it merges.
    """
    n = len(x)
    centre, size, alive = x.astype(float).copy(), np.ones(n) if sizes is None else sizes.astype(float).copy(), np.ones(n, bool)
    height = np.zeros(n) if tops is None else tops.astype(float).copy()
    chain: list[int] = []
    out = []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        top = chain[-1]
        gap = np.where(alive, 2 * size * size[top] / (size + size[top]) * ((centre - centre[top]) ** 2).sum(axis=1), np.inf)
        gap[top] = np.inf
        near = int(np.argmin(gap))
        if len(chain) > 1 and gap[chain[-2]] <= gap[near]:
            near = chain[-2]
        if len(chain) > 1 and near == chain[-2]:
            chain = chain[:-2]
            height[near] = max(float(np.sqrt(gap[near])), height[near], height[top])
            out.append((top, near, float(height[near])))
            centre[near] = (size[near] * centre[near] + size[top] * centre[top]) / (size[near] + size[top])
            size[near] += size[top]
            alive[top] = False
        else:
            chain.append(near)
    return sorted(out, key=lambda m: m[2])


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int) -> list[int]:
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b, _ in merges[: max(0, n - k)]:
        parent[top(a)] = top(b)
    numbers: dict[int, int] = {}
    return [numbers.setdefault(top(i), len(numbers) + 1) for i in range(n)]


def sums_of_squares(df: DataFrame, vector: str, label: str) -> DataFrame:
    """totss, withinss, betweenss of labelled vectors, by aggregates per dimension."""
    flat = df.select(F.col(label).alias("l"), F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    by = flat.groupBy("l", "d").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    centre = by.groupBy("d").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    return by.join(centre, "d").agg(
        F.sum(F.col("n") * F.col("v")).alias("withinss"), F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("betweenss"),
    ).select((F.col("withinss") + F.col("betweenss")).alias("totss"), "withinss", "betweenss")


def principal(df: DataFrame, features: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """df with the first k principal scores as an array, and the shares of variance."""
    model = PCA(k=k, inputCol=features, outputCol="pca_").fit(df)
    return model.transform(df).withColumn("pca", vector_to_array("pca_")).drop("pca_"), list(model.explainedVariance)


def profiles(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def level(share: Column) -> Column:
    return F.when(share > 0.66, "High").when(share > 0.33, "Moderate").otherwise("Low")


def labels(df: DataFrame, label: str, themes: dict[str, str]) -> DataFrame:
    """label, label_text: for each theme (name: column) where the cluster's median stands among all values."""
    medians = quantiles(df, [label], list(themes.values()), {"med": 0.5})
    values = df.select(*themes.values()).join(F.broadcast(medians))
    shares = values.groupBy(label).agg(*[F.avg(F.when(F.col(c).isNotNull(), (F.col(c) <= F.col(f"med_{c}")).cast("double"))).alias(c) for c in themes.values()])
    return shares.select(label, F.concat_ws(" + ", *[F.concat(level(F.col(c)), F.lit(f" {name}")) for name, c in themes.items()]).alias("label_text"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """The share of rows with equal labels, and after naming b's labels by their commonest partner in a."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(b).agg(F.max("n").alias("best"))
    plain = counts.agg((F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    return plain.join(best.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).agg((F.sum("best") / F.first("all")).alias("aligned_agreement")))
