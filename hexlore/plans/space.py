"""Spatial queries. Customers and suppliers stand at pseudo-coordinates in the unit square."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlore.operators import geo
from hexlore.plans.registry import query, r6, rounded, table

EDGE = 0.05
XY = "((k * 7919) % 10007) / 10007.0 AS x, ((k * 104729) % 10007) / 10007.0 AS y"
POINTS = f"pt AS (SELECT c_custkey AS k, c_acctbal AS v, {XY.replace('k *', 'c_custkey *')} FROM customer)"
S3 = repr(geo.SQRT3)
BINNED = f"""{POINTS}, f AS (SELECT *, ({S3} / 3 * x - y / 3) / {EDGE} AS fq, (2.0 / 3 * y) / {EDGE} AS fr FROM pt), g AS (SELECT *, round(fq) AS q0, round(fr) AS r0,
round(-fq - fr) AS s0 FROM f),
h AS (SELECT *, abs(q0 - fq) AS dq, abs(r0 - fr) AS dr, abs(s0 + fq + fr) AS ds FROM g),
b AS (SELECT k, x, y, v, CAST(CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN r0
WHEN dr > ds THEN -q0 - s0 ELSE r0 END AS BIGINT) AS r FROM h),
cells AS (SELECT q, r, count(*) AS n, avg(v) AS v FROM b GROUP BY q, r)"""


def points(spark, d, name="customer", key="c_custkey", value="c_acctbal") -> DataFrame:
    x, y = geo.pseudo_xy(key)
    return table(spark, d, name).select(F.col(key).alias("k"), F.col(value).alias("v"), x.alias("x"), y.alias("y"))


def binned(spark, d) -> DataFrame:
    q, r = geo.cell_of(F.col("x"), F.col("y"), EDGE)
    return points(spark, d).withColumns({"q": q, "r": r})


def cells(spark, d) -> DataFrame:
    return binned(spark, d).groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"))


@query(f"""WITH {BINNED} SELECT q, r, (q + 1048576) * 2097152 + (r + 1048576) AS cell_id, n, round(v, 6) AS v, round(CAST({EDGE} * {S3} * (q + r / 2.0) AS DOUBLE), 6) AS cx,
round(CAST({EDGE} * 1.5 * r AS DOUBLE), 6) AS cy, round(CAST({geo.cell_area(EDGE)!r} AS DOUBLE), 6) AS area FROM cells""")
def hex_bin_points(spark, d):
    c = cells(spark, d)
    cx, cy = geo.centre(F.col("q"), F.col("r"), EDGE)
    area = geo.ring_area(geo.ring(F.col("q"), F.col("r"), EDGE))
    return rounded(c.withColumns({"cell_id": geo.cell_id(F.col("q"), F.col("r")), "cx": cx, "cy": cy, "area": area}), "v", "cx", "cy", "area")


@query(f"""WITH {BINNED}, grid AS (SELECT q, r FROM (SELECT unnest(range(-8, 21)) AS r) CROSS JOIN (SELECT unnest(range(-20, 21)) AS q)),
inside AS (SELECT q, r FROM grid WHERE {EDGE} * {S3} * (q + r / 2.0) BETWEEN 0.001 AND 0.7 AND {EDGE} * 1.5 * r BETWEEN 0.001 AND 0.58)
SELECT CAST(inside.q AS BIGINT) AS q, CAST(inside.r AS BIGINT) AS r, coalesce(n, 0) AS n FROM inside LEFT JOIN cells ON inside.q = cells.q AND inside.r = cells.r""")
def grid_counts(spark, d):
    """All cells of a city's outline, with the points in them, none left out."""
    box = [(0.001, 0.001), (0.7, 0.001), (0.7, 0.58), (0.001, 0.58)]
    city = spark.createDataFrame([([{"x": x, "y": y} for x, y in box],)], "outline array<struct<x:double,y:double>>")
    grid = geo.lattice(city, "outline", EDGE).select(F.col("q").cast("long").alias("q"), F.col("r").cast("long").alias("r"))
    return grid.join(cells(spark, d).select("q", "r", "n"), ["q", "r"], "left").fillna(0, ["n"])


@query(f"""WITH {BINNED} SELECT a.q, a.r, round(avg(b.v), 6) AS v_lag FROM cells a LEFT
JOIN cells b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) GROUP BY a.q, a.r""")
def hex_neighbor_lag(spark, d):
    return geo.lattice_lag(cells(spark, d), ["v"]).select("q", "r", r6("v_lag").alias("v_lag"))


@query(f"""WITH {BINNED}, m AS (SELECT q, r, CASE WHEN (q + r) % 9 = 0 THEN NULL ELSE v END AS a, v AS b FROM cells)
SELECT x.q, x.r, CASE WHEN (SELECT count(*) - count(a) FROM m) = 0 THEN round(avg(y.a), 6) END AS a_lag, round(avg(y.b), 6) AS b_lag FROM m x LEFT
JOIN m y ON (y.q - x.q, y.r - x.r) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) GROUP BY x.q, x.r""")
def strict_neighbor_lag(spark, d):
    m = cells(spark, d).select("q", "r", F.when((F.col("q") + F.col("r")) % 9 != 0, F.col("v")).alias("a"), F.col("v").alias("b"))
    return rounded(geo.lattice_lag(m, ["a", "b"], "strict"), "a_lag", "b_lag").select("q", "r", "a_lag", "b_lag")


SUP = f"sp AS (SELECT s_suppkey AS k, s_acctbal AS v, {XY.replace('k *', 's_suppkey *')} FROM supplier)"
NEAR = f"{SUP}, nn AS (SELECT a.k AS src, b.k AS dst, b.v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.k ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.k) AS rank FROM sp a JOIN sp b ON a.k <> b.k)"


@query(f"WITH {NEAR} SELECT src AS k, round(avg(v), 6) AS v_lag FROM nn WHERE rank <= 6 GROUP BY src")
def knn_spatial_lag(spark, d):
    return geo.knn_lag(points(spark, d, "supplier", "s_suppkey", "s_acctbal"), "k", ["v"]).select("k", r6("v_lag").alias("v_lag"))


@query(f"WITH {NEAR} SELECT src, dst, round(d, 9) AS d, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 6")
def knn_graph(spark, d):
    return geo.nearest(points(spark, d, "supplier", "s_suppkey", "s_acctbal"), "k", 6).withColumn("d", F.round("d", 9))


RECT_A = "ra AS (SELECT n_nationkey AS a, n_nationkey % 5 * 1.0 AS x0, n_nationkey // 5 * 1.0 AS y0, n_nationkey % 5 + 1.0 AS x1, n_nationkey // 5 + 1.0 AS y1 FROM nation)"
RECT_B = "rb AS (SELECT n_nationkey AS b, n_nationkey % 5 * 0.9 + 0.25 AS bx0, n_nationkey // 5 * 0.8 + 0.5 AS by0, n_nationkey % 5 * 0.9 + 1.25 AS bx1, n_nationkey // 5 * 0.8 + 1.0 AS by1, CASE WHEN n_nationkey = 7 THEN NULL ELSE n_nationkey * 10.0 END AS e FROM nation)"
OVER = f"""WITH {RECT_A}, {RECT_B}, o AS (SELECT a, b, e, (least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0)) / ((bx1 - bx0) * (by1 - by0)) AS w FROM ra
JOIN rb ON least(x1, bx1) > greatest(x0, bx0) AND least(y1, by1) > greatest(y0, by0))"""


def overlaps(spark, d) -> DataFrame:
    n, row, at = F.col("n_nationkey"), F.floor(F.col("n_nationkey") / 5), F.col("n_nationkey") % 5
    nation = table(spark, d, "nation")
    a = nation.select(n.alias("a"), (at * 1.0).alias("x0"), (row * 1.0).alias("y0"), (at + 1.0).alias("x1"), (row + 1.0).alias("y1"))
    b = nation.select(
        n.alias("b"), (at * 0.9 + 0.25).alias("x0"), (row * 0.8 + 0.5).alias("y0"), (at * 0.9 + 1.25).alias("x1"), (row * 0.8 + 1.0).alias("y1"),
        F.when(n != 7, n * 10.0).alias("e"),
    )
    o = geo.rect_overlap(a, b, 1.0)
    return o.withColumn("w", F.col("shared") / ((F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0")))).withColumn("variable", F.lit("e"))


@query(OVER + " SELECT a, round(CAST(CASE WHEN count(e) = count(*) THEN sum(e * w) END AS DOUBLE), 6) AS extensive, round(CAST(CASE WHEN count(e) = count(*) THEN sum(e * w) / sum(w) END AS DOUBLE), 6) AS intensive FROM o GROUP BY a")
def areal_interp_rect(spark, d):
    o = overlaps(spark, d)
    both = [geo.interpolate(o, ["a"], "variable", "b_e", "w", mode).select("a", r6("b_e").alias(mode)) for mode in ("extensive", "intensive")]
    return both[0].join(both[1], "a")


@query()
def areal_interp_polygon(spark, d):
    """Shares of each hexagon inside a concave zone, by clipping; tests hold the areas against closed forms."""
    zone = [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.4), (0.1, 0.9)]
    zones = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in zone])], "zone long, outline array<struct<x:double,y:double>>")
    rings = cells(spark, d).withColumn("ring", geo.ring(F.col("q"), F.col("r"), EDGE))
    pairs = geo.polygon_overlay(zones, rings, "outline", "ring", 8 * EDGE)
    return pairs.select("zone", "q", "r", r6(F.col("shared") / geo.cell_area(EDGE)).alias("inside"))


@query(f"WITH {POINTS}, {SUP} SELECT DISTINCT pt.k FROM pt JOIN sp ON abs(pt.x - sp.x) <= 0.02 AND abs(pt.y - sp.y) <= 0.02")
def spatial_semi_join(spark, d):
    """Customers in any supplier's square: an equi-join on buckets, then the predicate, each customer once."""
    c, s = points(spark, d), points(spark, d, "supplier", "s_suppkey", "s_acctbal")
    b = 0.04
    s = s.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(F.sequence(F.floor((F.col("x") - 0.02) / b), F.floor((F.col("x") + 0.02) / b))).alias("bx"), "y")
    s = s.select("sx", "sy", "bx", F.explode(F.sequence(F.floor((F.col("y") - 0.02) / b), F.floor((F.col("y") + 0.02) / b))).alias("by"))
    c = c.withColumns({"bx": F.floor(F.col("x") / b), "by": F.floor(F.col("y") / b)})
    hit = (c.bx == s.bx) & (c.by == s.by) & (F.abs(c.x - s.sx) <= 0.02) & (F.abs(c.y - s.sy) <= 0.02)
    return c.join(s, hit, "left_semi").select("k")


@query(f"""WITH {POINTS} SELECT k, CAST(CAST('0x' || substr(md5(CAST(floor(x / 0.1) AS BIGINT) || '|' || CAST(floor(y / 0.1) AS BIGINT) || '|42'),
1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM pt""")
def spatial_blocks_folds(spark, d):
    return points(spark, d).select("k", geo.fold_of_block(F.col("x"), F.col("y"), 0.1, 5).alias("fold"))


@query()
def cell_geojson(spark, d):
    return cells(spark, d).select("q", "r", geo.geojson(geo.ring(F.col("q"), F.col("r"), EDGE)).alias("geojson"))
