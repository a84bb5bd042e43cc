"""A planar hexagonal lattice and polygon operations, as expressions and equi-joins on cells.

The lattice is pointy-topped with axial coordinates (q, r); it is no H3. Coordinates are planar: longitudes and
latitudes go through project() first, whose local scale suits a city.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The six neighbours of a cell in axial coordinates.
OFFSETS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
SQRT3 = math.sqrt(3.0)
#: Fixed value: the mean radius of the earth in metres.
EARTH = 6_371_008.8
RING = "array<struct<x:double,y:double>>"


def pseudo_xy(key: str | Column) -> tuple[Column, Column]:
    """Stand-in coordinates in the unit square for tables without any."""
    k = (F.col(key) if isinstance(key, str) else key).cast("long")
    return (k * 7919) % 10007 / 10007.0, (k * 104729) % 10007 / 10007.0


def project(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin, by the local scale cos(lat0): good for a city, not for a continent."""
    degree = EARTH * math.pi / 180
    return (lon - lon0) * (degree * math.cos(math.radians(lat0))), (lat - lat0) * degree


def unproject(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Longitude and latitude of a place in metres from an origin."""
    degree = EARTH * math.pi / 180
    return x / (degree * math.cos(math.radians(lat0))) + lon0, y / degree + lat0


def project_ring(points: Column, lon0: float, lat0: float) -> Column:
    """A ring of longitudes (x) and latitudes (y) in metres."""
    def place(p: Column) -> Column:
        x, y = project(p["x"], p["y"], lon0, lat0)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, place)


def cell_of(x: Column, y: Column, edge: float) -> tuple[Column, Column]:
    """The axial cell of a point: cube rounding, the coordinate with the largest rounding error is mended."""
    fq, fr = (SQRT3 / 3 * x - y / 3) / edge, (2.0 / 3 * y) / edge
    fs = -fq - fr
    q, r, s = F.round(fq), F.round(fr), F.round(fs)
    dq, dr, ds = F.abs(q - fq), F.abs(r - fr), F.abs(s - fs)
    mended_q = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    mended_r = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    return mended_q.cast("long"), mended_r.cast("long")


def cell_id(q: Column, r: Column) -> Column:
    """Both coordinates in one number."""
    return (q + 2**20) * F.lit(2**21) + (r + 2**20)


def centre(q: Column, r: Column, edge: float) -> tuple[Column, Column]:
    return edge * SQRT3 * (q + r / 2.0), edge * 1.5 * r


def cell_area(edge: float) -> float:
    return 1.5 * SQRT3 * edge * edge


def ring(q: Column, r: Column, edge: float) -> Column:
    """The six corners of a cell as an array of (x, y)."""
    cx, cy = centre(q, r, edge)
    turn = lambda k: (k * 60 - 30) * math.pi / 180
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct((cx + edge * F.cos(turn(k))).alias("x"), (cy + edge * F.sin(turn(k))).alias("y")))


def ring_area(points: Column) -> Column:
    """Shoelace area of a ring, which need not be closed."""
    cross = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % F.size(points))["y"] - F.get(points, (i + 1) % F.size(points))["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def ring_centroid(points: Column) -> tuple[Column, Column]:
    """The centroid (x, y) of a ring by the shoelace formula, relative to its first point; null for a ring without area."""
    def sums(points: Column) -> Column:
        at = lambda i: F.get(points, i % F.size(points))
        from_first = lambda p, a: p[a] - F.get(points, F.lit(0))[a]

        def step(acc: Column, i: Column) -> Column:
            p, o = at(i), at(i + 1)
            px, py, ox, oy = from_first(p, "x"), from_first(p, "y"), from_first(o, "x"), from_first(o, "y")
            cross = px * oy - ox * py
            return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (px + ox) * cross).alias("x"), (acc["y"] + (py + oy) * cross).alias("y"))

        return F.aggregate(F.sequence(F.lit(0), F.size(points) - 1), F.struct(*[F.lit(0.0).alias(c) for c in "axy"]), step)

    told = sums(points)
    first = F.get(points, F.lit(0))
    return tuple(first[c] + F.try_divide(told[c], 3 * told["a"]) for c in "xy")


def in_ring(x: Column, y: Column, points: Column) -> Column:
    """Whether a point is inside a ring, by ray casting."""
    def crosses(p: Column, i: Column) -> Column:
        o = F.get(points, (i + 1) % F.size(points))
        return ((p["y"] > y) != (o["y"] > y)) & (x < (o["x"] - p["x"]) * (y - p["y"]) / (o["y"] - p["y"]) + p["x"])

    return F.size(F.filter(points, crosses)) % 2 == 1


def lattice(df: DataFrame, points: str, edge: float) -> DataFrame:
    """df with a row for each cell (q, r) whose centre lies in the ring in column points."""
    ends = [F.transform(points, _axis(a)) for a in "xy"]
    low_y, high_y = F.array_min(ends[1]), F.array_max(ends[1])
    rows = df.withColumn("r", F.explode(F.sequence(F.floor(low_y / (1.5 * edge)), F.ceil(high_y / (1.5 * edge)))))
    begin = F.floor(F.array_min(ends[0]) / (SQRT3 * edge) - F.col("r") / 2)
    end = F.ceil(F.array_max(ends[0]) / (SQRT3 * edge) - F.col("r") / 2)
    rows = rows.withColumn("q", F.explode(F.sequence(begin, end)))
    cx, cy = centre(F.col("q"), F.col("r"), edge)
    return rows.where(in_ring(cx, cy, F.col(points)))


def _axis(name: str):
    return lambda p: p[name]


def neighbour_edges(cells: DataFrame) -> DataFrame:
    """q, r, nq, nr: each cell with its six neighbour places, made without a join."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in OFFSETS])
    return cells.select("q", "r", F.explode(steps).alias("o")).select("q", "r", (F.col("q") + F.col("o.a")).alias("nq"), (F.col("r") + F.col("o.b")).alias("nr"))


def lattice_lag(cells: DataFrame, columns: list[str], policy: str = "mean") -> DataFrame:
    """Cells with <column>_lag: the mean over occupied neighbours; all columns in one equi-join and one aggregate.

    policy "strict" makes a whole lag column null if any value of the column is missing.
    """
    values = cells.select(F.col("q").alias("nq"), F.col("r").alias("nr"), *columns)
    lags = neighbour_edges(cells).join(values, ["nq", "nr"]).groupBy("q", "r").agg(*[F.avg(c).alias(f"{c}_lag") for c in columns])
    out = cells.join(lags, ["q", "r"], "left")
    return without_gaps(out, cells, columns) if policy == "strict" else out


def nearest(points: DataFrame, key: str, k: int, bucket: float | None = None) -> DataFrame:
    """src, dst, d, rank: the k nearest other points of each point (x, y), ties by key, by rings of square buckets.

    A point is compared with its bucket and the eight around it; if its k-th distance reaches beyond what these cover,
    or they hold too few, it is compared with wider rings, so the result is exact. Buckets hold about 2 k points if
    their size is not given.
    """
    total, wide, high = points.agg(F.count(F.lit(1)), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    extent = max(wide or 0.0, high or 0.0)
    bucket = bucket or max(extent / max(1.0, math.sqrt(total / (2 * k))), 1e-12)
    placed = points.select(F.col(key).alias("k"), "x", "y", F.floor(F.col("x") / bucket).alias("bx"), F.floor(F.col("y") / bucket).alias("by"))
    # Of the points at one place the least keys alone can be among anyone's nearest, so a crowded place costs a few rows.
    first = F.row_number().over(Window.partitionBy("x", "y").orderBy("k"))
    others = placed.withColumn("n_", first).where(F.col("n_") <= k + 1).select(
        F.col("k").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("bx").alias("cx"), F.col("by").alias("cy"),
    )
    reach, todo, done = 1, placed, None
    while True:
        around = todo.withColumn(
            "cx", F.explode(F.sequence(F.col("bx") - reach, F.col("bx") + reach)),
        ).withColumn("cy", F.explode(F.sequence(F.col("by") - reach, F.col("by") + reach)))
        near = around.join(others, ["cx", "cy"]).where("k <> dst").withColumn("d", F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2))
        best = near.groupBy(F.col("k").alias("src")).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "dst"))), 1, k).alias("best"))
        last = reach * bucket > extent
        # Everything within reach * bucket of the point has been seen.
        sure = F.lit(True) if last else (F.size("best") >= min(k, max(total - 1, 0))) & (F.get("best", F.size("best") - 1)["d"] <= reach * bucket)
        settled = best.where(sure).select("src", F.posexplode("best").alias("pos", "b")).select(
            "src", F.col("b.dst").alias("dst"), F.col("b.d").alias("d"), (F.col("pos") + 1).alias("rank"),
        )
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        todo = todo.join(best.where(sure).select(F.col("src").alias("k")), "k", "left_anti")
        if todo.isEmpty():
            return done
        reach *= 2


def knn_lag(points: DataFrame, key: str, columns: list[str], k: int = 6, bucket: float | None = None, policy: str = "mean") -> DataFrame:
    """Points with <column>_lag, the mean over their k nearest others.

    policy "strict" makes a whole lag column null if any value of the column is missing.
    """
    edges = nearest(points, key, k, bucket)
    values = points.select(F.col(key).alias("dst"), *columns)
    lags = edges.join(values, "dst").groupBy(F.col("src").alias(key)).agg(*[F.avg(c).alias(f"{c}_lag") for c in columns])
    out = points.join(lags, key, "left")
    return without_gaps(out, points, columns) if policy == "strict" else out


def without_gaps(lagged: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """lagged, whose <column>_lag is null throughout if cells miss any value of the column."""
    gaps = F.broadcast(cells.agg(*[F.count_if(F.col(c).isNull()).alias(f"gaps_{c}") for c in columns]))
    return lagged.join(gaps).withColumns({f"{c}_lag": F.when(F.col(f"gaps_{c}") == 0, F.col(f"{c}_lag")) for c in columns}).drop(*[f"gaps_{c}" for c in columns])


def rect_overlap(a: DataFrame, b: DataFrame, bucket: float) -> DataFrame:
    """Pairs of overlapping rectangles (x0, y0, x1, y1) with the area they share; columns of a plain, of b with b_.

    Both sides go to the square buckets that they touch; a pair counts in the bucket of its lower left corner alone.
    """
    def touched(df: DataFrame, mark: str) -> DataFrame:
        df = df.select(*[F.col(c).alias(mark + c) for c in df.columns])
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(mark + lo) / bucket), F.floor(F.col(mark + hi) / bucket)))
        return df.withColumn("bx", span("x0", "x1")).withColumn("by", span("y0", "y1"))

    pairs = touched(a, "").join(touched(b, "b_"), ["bx", "by"])
    left, low = F.greatest("x0", "b_x0"), F.greatest("y0", "b_y0")
    w, h = F.least("x1", "b_x1") - left, F.least("y1", "b_y1") - low
    once = (F.floor(left / bucket) == F.col("bx")) & (F.floor(low / bucket) == F.col("by"))
    return pairs.where((w > 0) & (h > 0) & once).withColumn("shared", w * h).drop("bx", "by")


def touched(df: DataFrame, points: str, bucket: float) -> DataFrame:
    """df, a row for each square bucket (bx, by) that the box of the ring in column points touches."""
    def span(axis: str) -> Column:
        values = F.transform(points, _axis(axis))
        return F.explode(F.sequence(F.floor(F.array_min(values) / bucket), F.floor(F.array_max(values) / bucket)))

    return df.withColumn("bx", span("x")).withColumn("by", span("y"))


def points_in_polygons(places: DataFrame, polygons: DataFrame, points: str, bucket: float) -> DataFrame:
    """Left join of places (x, y) with the polygons whose ring (column points) they are in, the ring left out.

    An equi-join on square buckets, then ray casting; a place in no polygon keeps one row without one, a place in
    several has a row for each. Names of both sides must differ. Buckets should be of a polygon's size, as a polygon
    goes to all buckets of its box.
    """
    dealt = places.withColumns({"bx": F.floor(F.col("x") / bucket), "by": F.floor(F.col("y") / bucket)})
    shapes = touched(polygons, points, bucket).withColumnsRenamed({"bx": "bx_", "by": "by_"})
    inside = (F.col("bx") == F.col("bx_")) & (F.col("by") == F.col("by_")) & in_ring(F.col("x"), F.col("y"), F.col(points))
    return dealt.join(shapes, inside, "left").drop("bx", "by", "bx_", "by_", points)


def polygon_overlay(subjects: DataFrame, windows: DataFrame, subject: str, window: str, bucket: float) -> DataFrame:
    """One row per pair of a polygon (ring subject, of any shape) and a convex one (ring window) that share an area.

    Columns of both sides (their names must differ) and shared, the area. Both sides go to the buckets that their boxes
    touch; a pair is compared in one of the buckets that it shares, the lowest.
    """
    both = touched(subjects, subject, bucket).join(touched(windows, window, bucket), ["bx", "by"])
    low = lambda c, a: F.array_min(F.transform(c, _axis(a)))
    high = lambda c, a: F.array_max(F.transform(c, _axis(a)))
    corner = {a: F.greatest(low(subject, a), low(window, a)) for a in "xy"}
    meet = [corner[a] < F.least(high(subject, a), high(window, a)) for a in "xy"]
    once = (F.floor(corner["x"] / bucket) == F.col("bx")) & (F.floor(corner["y"] / bucket) == F.col("by"))
    pairs = both.where(meet[0] & meet[1] & once).drop("bx", "by")
    return with_clip_area(pairs, subject, window, "shared").where("shared > 0")


def clip_area(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> float:
    """Area of a polygon inside a convex one: the polygon is cut along each edge of the window in turn."""
    turn = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(window, window[1:] + window[:1], strict=True))
    edges = list(zip(window, window[1:] + window[:1], strict=True))
    if turn < 0:
        edges = [(b, a) for a, b in edges]
    shape = list(subject)
    for (ax, ay), (bx, by) in edges:
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in shape]
        cut: list[tuple[float, float]] = []
        for k, (p, s) in enumerate(zip(shape, side, strict=True)):
            q, t = shape[k - 1], side[k - 1]
            if (s >= 0) != (t >= 0):
                f = t / (t - s)
                cut.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                cut.append(p)
        shape = cut
        if not shape:
            return 0.0
    return abs(sum(shape[k - 1][0] * shape[k][1] - shape[k][0] * shape[k - 1][1] for k in range(len(shape)))) / 2


def with_clip_area(pairs: DataFrame, subject: str, window: str, out: str) -> DataFrame:
    """Adds the area of ring subject inside the convex ring window, in Arrow batches."""
    @F.pandas_udf("double")
    def area(a: pd.Series, b: pd.Series) -> pd.Series:
        points = lambda ps: [(p["x"], p["y"]) for p in ps]
        return pd.Series([clip_area(points(p), points(q)) for p, q in zip(a, b, strict=True)])

    return pairs.withColumn(out, area(subject, window))


def interpolate(shared: DataFrame, cell: list[str], variable: str, estimate: str, weight: str, mode: str = "extensive") -> DataFrame:
    """cell, variable, estimate of cells from weighted parts: sums (extensive) or weighted means (intensive).

    A missing part makes the cell's value missing.
    """
    part = F.col(estimate) * F.col(weight)
    whole = F.count(part) == F.count(F.lit(1))
    value = F.sum(part) if mode == "extensive" else F.try_divide(F.sum(part), F.sum(weight))
    return shared.groupBy(*cell, variable).agg(F.when(whole, value).alias(estimate))


def fold_of_block(x: Column, y: Column, block: float, folds: int, seed: int = 42) -> Column:
    """The cross-validation fold of the square block that a point is in."""
    name = F.concat_ws("|", F.floor(x / block).cast("string"), F.floor(y / block).cast("string"), F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def geojson(points: Column) -> Column:
    """A ring as GeoJSON text."""
    closed = F.concat(points, F.slice(points, 1, 1))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows of the last order value in each group, all ties; a group without values keeps its rows."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("rank_", F.rank().over(w)).where("rank_ = 1").drop("rank_")
