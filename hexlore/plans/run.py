"""Queries of the whole run: the grid over a projected outline, polygon joins, neighbourhoods, and the run to scores.

The city is the unit square of the pseudo-coordinates, laid over 0.3 by 0.3 degrees. Nations are tracts in five rows of
five, customers' orders are demolitions at the customers' places, parts are buildings whose line items are rents.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlore import analysis
from hexlore.config import Config
from hexlore.functions import nulls
from hexlore.operators import cluster, events, features, geo, models, score, shape
from hexlore.plans import learning, series, space
from hexlore.plans.registry import query, r6, rounded, table
from hexlore.sources.tables import geojson_features

WEST, SOUTH, SPAN = -97.95, 30.1, 0.3
ORIGIN = (-97.8, 30.25)
EDGE = 1500.0
#: Quick settings: a few of the full grids' values, fewer restarts and trees. Whole runs take Config() as it is.
QUICK = Config(
    cell_edge=EDGE, restarts=3, final_restarts=5, k_range=(2, 6), trees=30, depth=6, folds=3,
    grids={
        "elastic": {"alpha": [0.0, 1.0], "lambda": [0.001, 0.1]}, "forest": {"mtry": [3, 5]},
        "boost": {"nrounds": [5], "max_depth": [3], "eta": [0.1], "gamma": [0], "colsample_bytree": [0.8], "min_child_weight": [1], "subsample": [0.8]},
    },
)

CITY = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"NAME":"Elsewhere"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{"NAME":"City"},"geometry":{"type":"Polygon","coordinates":[[[-97.95,30.1],[-97.65,30.1],[-97.65,30.4],[-97.95,30.4],[-97.95,30.1]]]}}]}'


def outline(spark) -> DataFrame:
    return geojson_features(spark.createDataFrame([(CITY,)], "value string"), "NAME:string").where("NAME = 'City'")


def lonlat(key: str) -> list:
    x, y = geo.pseudo_xy(key)
    return [(F.lit(WEST) + SPAN * x).alias("lon"), (F.lit(SOUTH) + SPAN * y).alias("lat")]


def box(x0, y0, x1, y1) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def tract_ring(key: str) -> Column:
    side = SPAN / 5
    x, y = F.lit(WEST) + side * (F.col(key) % 5), F.lit(SOUTH) + side * F.floor(F.col(key) / 5)
    return box(x, y, x + side, y + side)


#: The statistics of a tract, from its customers.
ESTIMATES = {
    "median_income": "avg(c_acctbal) + 2000",
    "total_pop": "count(*) * 10.0D",
    "white_nh": "count_if(c_mktsegment = 'BUILDING') * 10.0D",
    "black_nh": "count_if(c_mktsegment = 'MACHINERY') * 5.0D",
    "asian_nh": "count_if(c_mktsegment = 'FURNITURE') * 5.0D",
    "hispanic": "count_if(c_mktsegment = 'AUTOMOBILE') * 5.0D",
    "total_tenure": "count(*) * 4.0D",
    "renter_occupied": "count_if(c_mktsegment = 'HOUSEHOLD') * 4.0D",
    "total_edu": "count(*) * 7.0D",
    "bachelors": "count_if(c_acctbal > 6000) * 7.0D",
    "graduate": "count_if(c_acctbal > 8500) * 3.0D",
    "total_poverty_det": "count(*) * 10.0D",
    "below_poverty": "count_if(c_acctbal < 500) * 10.0D",
    "median_rent": "avg(c_acctbal) / 4 + 500",
}


def raw_tables(spark, d) -> analysis.Raw:
    customers = table(spark, d, "customer")
    wide = customers.groupBy("c_nationkey").agg(*[F.expr(e).alias(c) for c, e in ESTIMATES.items()])
    tracts = wide.unpivot(["c_nationkey"], list(ESTIMATES), "variable", "estimate").select(
        F.col("c_nationkey").alias("tract"), tract_ring("c_nationkey").alias("ring"), "variable", "estimate",
    )
    orders = table(spark, d, "orders").select(*lonlat("o_custkey"), F.year("o_orderdate").alias("year"))
    lines = table(spark, d, "lineitem").select(
        *lonlat("l_partkey"), F.col("l_partkey").alias("building"), events.quarter_start("l_shipdate").alias("period"),
        F.col("l_extendedprice").alias("rent"),
    )
    return analysis.Raw(outline(spark), tracts, orders, lines, ORIGIN, list(ESTIMATES), series.COUNT_YEARS, series.QUARTERS, series.PICKS, (1999, 2000, 2001))


@lru_cache(maxsize=4)
def _run(app: str, d: str) -> analysis.Analysis:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    return analysis.Analysis(spark, raw_tables(spark, d), QUICK)


def quick_run(spark, d) -> analysis.Analysis:
    """The run with QUICK settings; its stages are in the checkpoint folder and kept for the session."""
    return _run(spark.sparkContext.applicationId, d)


DEGREE = repr(geo.EARTH * 3.141592653589793 / 180)
S3 = repr(geo.SQRT3)


def grid_sql() -> str:
    dx, dy = f"({DEGREE} * {math.cos(math.radians(ORIGIN[1]))!r})", DEGREE
    return f"""WITH ends AS (SELECT ({WEST} - {ORIGIN[0]}) * {dx} AS x0, ({SOUTH} - {ORIGIN[1]}) * {dy} AS y0, ({WEST} + {SPAN} - {ORIGIN[0]}) * {dx} AS x1, ({SOUTH} + {SPAN} - {ORIGIN[1]}) * {dy} AS y1),
cells AS (SELECT q, r, {EDGE}::DOUBLE * {S3}::DOUBLE * (q + r / 2.0) AS x, {EDGE}::DOUBLE * 1.5 * r AS y FROM (SELECT unnest(range(-40, 41)) AS q) CROSS
JOIN (SELECT unnest(range(-40, 41)) AS r)),
inside AS (SELECT q, r, x, y FROM cells, ends WHERE x > x0 AND x < x1 AND y > y0 AND y < y1)
SELECT CAST(q AS BIGINT) AS q, CAST(r AS BIGINT) AS r, CAST(dense_rank() OVER (ORDER BY (q + 1048576) * 2097152 + (r + 1048576)) AS INTEGER) AS hex_id,
round(x / {dx} + {ORIGIN[0]}, 6) AS longitude, round(y / {dy} + {ORIGIN[1]}, 6) AS latitude,
round(1.5 * {S3}::DOUBLE * {EDGE}::DOUBLE * {EDGE}::DOUBLE / 1000000, 6) AS area_km2 FROM inside"""


@query(grid_sql())
def projected_grid(spark, d):
    """Cells of the city's outline, read from GeoJSON and projected, with centres in degrees and areas in km2."""
    g = analysis.grid(outline(spark), ORIGIN, EDGE)
    return rounded(g, "longitude", "latitude", "area_km2").select(
        F.col("q").cast("long").alias("q"), F.col("r").cast("long").alias("r"), "hex_id", "longitude", "latitude", "area_km2",
    )


#: Zones of several shapes in the unit square; the first two overlap.
ZONES = {1: [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.4), (0.1, 0.9)], 2: [(0.05, 0.5), (0.4, 0.95), (0.35, 0.3)], 3: [(0.6, 0.6), (0.7, 0.95), (0.5, 0.8)]}
EDGES = ", ".join(f"({z}, {k}, {p[0]}, {p[1]}, {q[0]}, {q[1]})" for z, ring in ZONES.items() for k, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)))
SIDES = f"sides AS (SELECT * FROM (VALUES {EDGES}) t(zone, k, x0, y0, x1, y1))"


def zones(spark) -> DataFrame:
    return spark.createDataFrame([(z, [{"x": x, "y": y} for x, y in ring]) for z, ring in ZONES.items()], f"zone int, ring {geo.RING}")


@query(f"""WITH {space.POINTS}, {SIDES}, c AS (SELECT k.k, zone, count(*) AS n FROM pt k
JOIN sides ON (y0 > k.y) <> (y1 > k.y) AND k.x < (x1 - x0) * (k.y - y0) / (y1 - y0) + x0 GROUP BY k.k, zone HAVING count(*) % 2 = 1)
SELECT pt.k, CAST(zone AS INTEGER) AS zone FROM pt LEFT JOIN c ON pt.k = c.k""")
def point_in_polygon(spark, d):
    """Customers with the zones that they are in: none, one, or a row for each."""
    return geo.points_in_polygons(space.points(spark, d), zones(spark), "ring", 0.25).select("k", "zone")


@query(f"""WITH {SIDES} SELECT CAST(zone AS INTEGER) AS zone, round(CAST(abs(sum(x0 * y1 - x1 * y0)) / 2 AS DOUBLE), 6) AS area,
round(CAST(sum((x0 + x1) * (x0 * y1 - x1 * y0)) / (3 * sum(x0 * y1 - x1 * y0)) AS DOUBLE), 6) AS cx,
round(CAST(sum((y0 + y1) * (x0 * y1 - x1 * y0)) / (3 * sum(x0 * y1 - x1 * y0)) AS DOUBLE), 6) AS cy FROM sides GROUP BY zone""")
def polygon_centroids(spark, d):
    cx, cy = geo.ring_centroid(F.col("ring"))
    return rounded(zones(spark).select("zone", geo.ring_area(F.col("ring")).alias("area"), cx.alias("cx"), cy.alias("cy")), "area", "cx", "cy")


@query(f"WITH {SIDES} SELECT CAST(zone AS INTEGER) AS zone, round(CAST(abs(sum(x0 * y1 - x1 * y0)) / 2 AS DOUBLE), 6) AS shared FROM sides GROUP BY zone")
def overlay_zone_areas(spark, d):
    """What the cells of a lattice hold of each zone comes to the zone's area, as the lattice covers all zones."""
    frame = spark.createDataFrame([([{"x": x, "y": y} for x, y in [(-0.2, -0.2), (1.2, -0.2), (1.2, 1.2), (-0.2, 1.2)]],)], f"outline {geo.RING}")
    cells = geo.lattice(frame, "outline", 0.05).select("q", "r", geo.ring(F.col("q"), F.col("r"), 0.05).alias("hexagon"))
    return rounded(geo.polygon_overlay(zones(spark), cells, "ring", "hexagon", 0.4).groupBy("zone").agg(F.sum("shared").alias("shared")), "shared")


@query("SELECT count(DISTINCT c_nationkey) AS n_tracts, round(CAST(sum(10.0) AS DOUBLE), 4) AS total_pop FROM customer")
def tract_totals_on_cells(spark, d):
    """Interpolated counts add up to the tracts' own, over a lattice that covers all of them."""
    raw = raw_tables(spark, d)
    pad = SPAN / 10
    frame = spark.range(1).select(box(F.lit(WEST - pad), F.lit(SOUTH - pad), F.lit(WEST + SPAN + pad), F.lit(SOUTH + SPAN + pad)).alias("ring"))
    cells = analysis.grid(frame, ORIGIN, EDGE)
    found = analysis.cell_statistics(cells, raw.tracts, ORIGIN, EDGE, ["total_pop"])
    n = raw.tracts.agg(F.count_distinct("tract").alias("n_tracts"))
    return found.agg(F.round(F.sum("total_pop"), 4).alias("total_pop")).join(n).select("n_tracts", "total_pop")


LAG_COLUMNS = {
    "rent_change_total": "v", "demo_density": "k % 17 * 1.5", "median_income": "v + k % 5",
    "vulnerability_index": "CASE WHEN k % 9 = 0 THEN NULL ELSE k % 101 * 1.0 END",
}
NEAR = f"""{space.POINTS}, lc AS (SELECT k, x, y, {', '.join(f'{e} AS {c}' for c, e in LAG_COLUMNS.items())} FROM pt),
nn AS (SELECT a.k AS src, b.*, row_number() OVER (PARTITION BY a.k ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.k) AS rank FROM lc a
JOIN lc b ON a.k <> b.k AND abs(a.x - b.x) < 0.5 AND abs(a.y - b.y) < 0.5)"""


@query(f"""WITH {NEAR} SELECT src AS k, {', '.join(f'round(avg({c}), 6) AS {c}_lag' for c in LAG_COLUMNS)}, CASE WHEN (SELECT count(*) - count(vulnerability_index)
FROM lc) = 0 THEN round(avg(vulnerability_index), 6) END AS strict_lag FROM nn WHERE rank <= 6 GROUP BY src""")
def neighbourhood_lags(spark, d):
    """The four neighbourhood means by one search, and one of them by the strict rule."""
    p = space.points(spark, d).select("k", "x", "y", *[F.expr(e).cast("double").alias(c) for c, e in LAG_COLUMNS.items()])
    out = features.neighbourhood(p, "k")
    strict = geo.without_gaps(out.select("k", "vulnerability_index_lag"), p, ["vulnerability_index"]).select("k", F.col("vulnerability_index_lag").alias("strict_lag"))
    lags = [f"{c}_lag" for c in LAG_COLUMNS]
    return rounded(out.select("k", *lags).join(strict, "k"), *lags, "strict_lag")


@query("""SELECT count(CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN 1 END) AS n_complete, count(*) AS n_rows, round_even(count(CASE
WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN 1 END) * 100.0 / count(*), 1) AS pct_complete FROM orders""")
def complete_cases(spark, d):
    return nulls.completeness(series.gappy(spark, d), ["o_orderkey", "price", "priority"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN o_totalprice * 2 END AS linear, o_totalprice AS trees FROM orders")
def complete_case_scores(spark, d):
    """The linear model's score on rows that miss no predictor alone, the others' on all."""
    rows = series.gappy(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    told = rows.withColumns({"linear": F.col("o_totalprice") * 2, "trees": F.col("o_totalprice")})
    return score.complete_only(told, ["price", "priority"], ["linear"]).select("o_orderkey", "linear", "trees")


@query(f"""WITH {space.BINNED}, gr AS (SELECT q, r, CAST(dense_rank() OVER (ORDER BY (q + 1048576) * 2097152 + (r + 1048576)) AS INTEGER) AS hex_id, n, v FROM cells),
s AS (SELECT hex_id, (q + 1048576) * 2097152 + (r + 1048576) AS cell_id, v * 2 AS risk FROM gr WHERE n > 2)
SELECT gr.hex_id, (q + 1048576) * 2097152 + (r + 1048576) AS cell_id, round(risk, 6) AS risk FROM gr LEFT
JOIN s ON gr.hex_id = s.hex_id AND s.cell_id = (q + 1048576) * 2097152 + (r + 1048576)""")
def scores_on_grid(spark, d):
    """Scores brought back to the grid by both keys; cells without a score stay."""
    g = space.cells(spark, d).withColumn("cell_id", geo.cell_id(F.col("q"), F.col("r")))
    g = events.dense_ids(g, ["cell_id"], "hex_id")
    s = g.where("n > 2").select("hex_id", "cell_id", (F.col("v") * 2).alias("risk"))
    return analysis.joined_to_grid(g.select("hex_id", "cell_id"), s).select("hex_id", "cell_id", r6("risk").alias("risk"))


@query(f"""WITH {series.CHANGES}, n AS (SELECT CAST(n_nationkey AS BIGINT) AS cell_id FROM nation),
j AS (SELECT cell_id, period, v FROM n LEFT JOIN ch ON cell = cell_id)
SELECT cell_id, period, round(v, 6) AS v FROM (SELECT *, rank() OVER (PARTITION BY cell_id ORDER BY period DESC NULLS LAST) AS k FROM j) WHERE k = 1""")
def rent_latest_all_cells(spark, d):
    """The last rents of every cell, cells without rents included."""
    cells = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("cell_id"))
    rents = series.rent_changes(spark, d).select(F.col("cell").alias("cell_id"), "period", r6("v").alias("v"))
    return analysis.latest_by_cell(cells, rents, "period").select("cell_id", "period", "v")


NAN = "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END"


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT c_custkey, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100, 6) AS scaled,
round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 6) AS z, (SELECT round(count(*) FILTER (v IS NULL) * 100.0 / count(*), 6)
FROM t) AS pct_missing, v IS NOT NULL AS sufficient FROM t""")
def nan_is_missing(spark, d):
    """NaN beside nulls in scaling, z-scores, the profile of gaps and the flags: it counts as missing everywhere."""
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k, F.when(k % 11 == 0, None).when(k % 7 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("v"))
    out = nulls.with_zscores(nulls.with_minmax100(t, {"scaled": "v"}), {"z": "v"})
    gaps = shape.missing_profile(t, ["v"]).select(r6("pct_missing").alias("pct_missing"))
    return rounded(shape.with_missing_flags(out, ["v"]), "scaled", "z").join(F.broadcast(gaps)).select(
        "c_custkey", "scaled", "z", "pct_missing", F.col("sufficient_data").alias("sufficient"),
    )


@query(f"""WITH {learning.SEG}, t AS (SELECT c_custkey, c_custkey % 6 AS cluster, rent, demo, vuln FROM (SELECT c_custkey, c_acctbal AS rent, c_custkey * 7919 % 1000 / 10.0 AS demo,
CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey * 104729 % 1000 / 10.0 END AS vuln FROM customer))
SELECT c_custkey, CAST(CASE WHEN cluster BETWEEN 1 AND 4 THEN cluster END AS INTEGER) AS cluster_class, CAST(cluster IN (1, 2) AS INTEGER) AS high_risk_cluster, rent, demo, vuln FROM t WHERE cluster BETWEEN 1 AND 4 AND vuln IS NOT NULL""")
def outcome_rows(spark, d):
    """The outcome of clusters 1 to 4, its binary form, and rows that miss neither outcome nor predictors."""
    rows = learning.segmented(spark, d).withColumn("cluster", F.col("c_custkey") % 6).withColumn("sufficient_data", F.lit(True))
    return models.model_rows(models.outcomes(rows, "cluster", 4), "c_custkey", ["rent", "demo", "vuln"])


@query("SELECT CAST(a AS DOUBLE) / 2 AS alpha, round(0.001 + i * 0.999 / 19, 9) AS lambda FROM unnest([0, 1, 2]) t(a), range(20) s(i)")
def elastic_grid(spark, d):
    return models.param_grid(spark, models.GRIDS["elastic"]).select("alpha", F.round("lambda", 9).alias("lambda"))


@query(f"""WITH {learning.FLAT}, tr AS (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0),
s AS (SELECT d, avg(x) AS m, stddev_samp(x) AS s FROM fl JOIN tr USING (vec_id) GROUP BY d)
SELECT vec_id, CAST(d AS INTEGER) AS d, round((x - m) / nullif(s, 0), 6) AS z FROM fl JOIN s USING (d) WHERE vec_id % 3 = 0 AND d < 4""")
def scaled_new_rows(spark, d):
    """New rows scaled by what was learnt from others (four dimensions as columns)."""
    wide = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(4)])
    names = [f"x{k}" for k in range(4)]
    stats = nulls.column_stats(wide.where("vec_id % 3 <> 0"), names)
    z = nulls.scaled_by(wide.where("vec_id % 3 = 0"), stats, {str(k): f"x{k}" for k in range(4)}).select("vec_id", *map(str, range(4)))
    return shape.pivot_longer(z, ["vec_id"], [str(k) for k in range(4)], "d", "z").select("vec_id", F.col("d").cast("int").alias("d"), r6("z").alias("z"))


@query(f"""{learning.IDS}, m AS (SELECT count(CASE WHEN cluster = 0 THEN 1 END) AS n_noise, max(cluster) AS n_clusters FROM cl)
SELECT cluster, count(*) AS n, any_value(n_noise) AS n_noise, any_value(n_clusters) AS n_clusters FROM cl, m GROUP BY cluster""")
def cluster_size_table(spark, d):
    return cluster.cluster_sizes(learning.dbscan_ids(spark, d))


@query(f"""WITH {learning.FLAT}, f AS (SELECT 'd' || d AS feature, stddev_samp(x) AS a, avg(abs(x)) AS b FROM fl
GROUP BY d), n AS (SELECT feature, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 100 AS norm_a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) * 100 AS norm_b FROM f)
SELECT feature, round((norm_a + norm_b) / 2, 4) AS importance_avg FROM n ORDER BY (norm_a + norm_b) / 2 DESC, feature LIMIT 20""")
def top20_importance(spark, d):
    f = learning.flat(spark, d)
    name = F.concat(F.lit("d"), F.col("d").cast("string")).alias("feature")
    merged = models.merge_importance({"a": f.groupBy(name).agg(F.stddev_samp("x").alias("importance")), "b": f.groupBy(name).agg(F.avg(F.abs("x")).alias("importance"))})
    return merged.limit(20).select("feature", F.round("importance_avg", 4).alias("importance_avg"))


#: The figures of the analysis.
FIGURES = [
    ("07_displacement_risk_map.png", "Main displacement risk map (continuous scale)", "Map - Static"),
    ("07_risk_categories_map.png", "Risk categories map (Low/Moderate/High/Very High)", "Map - Static"),
    ("07_interactive_risk_map.html", "Interactive map with popups", "Map - Interactive"),
    ("07_model_comparison_maps.png", "Comparison of Random Forest, XGBoost, and Ensemble predictions", "Map - Comparison"),
    ("07_feature_importance_overall.png", "Top 20 most important features", "Feature Importance"),
    ("07_risk_score_distribution.png", "Histogram of risk score distribution", "Distribution"),
    ("07_risk_categories_pie.png", "Pie chart of risk categories", "Distribution"),
    ("07_summary_dashboard.png", "Combined summary dashboard", "Dashboard"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in FIGURES) + ") t(filename, description, type)")
def figure_catalogue(spark, d):
    return spark.createDataFrame(FIGURES, "filename string, description string, type string")


@query("SELECT p_partkey, p_name AS name, p_size, p_retailprice FROM part WHERE p_size IN (1, 5, 7)")
def classes_by_name(spark, d):
    """Rows of some classes; a range of columns without one of them, another under a new name."""
    p = table(spark, d, "part").where(nulls.is_in("p_size", [1, 5, 7]))
    return shape.select_as(p, ["p_partkey", *shape.between(p, "p_size", "p_retailprice")], without=["p_type"], name="p_name")


@query(f"""WITH {learning.PRED}, s AS (SELECT 'centre' AS model, 1 AS o, actual, predicted FROM pr
UNION ALL SELECT 'shifted', 2, actual, (predicted + CAST(vec_id % 2 AS INTEGER)) % 10 FROM pr),
c AS (SELECT model, actual AS class, count(*) AS n, count(CASE WHEN actual = predicted THEN 1 END) AS tp FROM s GROUP BY 1, 2),
p AS (SELECT model, predicted AS class, count(*) AS np FROM s GROUP BY 1, 2)
SELECT CAST(c.class AS VARCHAR) AS class, c.model, round(CASE WHEN tp > 0 THEN 2.0 * tp / (n + coalesce(np, 0)) END, 6) AS f1 FROM c LEFT
JOIN p ON c.model = p.model AND c.class = p.class""")
def f1_by_class_and_model(spark, d):
    return rounded(models.f1_by_model(two_models(spark, d), "actual", {"centre": "predicted", "shifted": "other"}), "f1")


def two_models(spark, d) -> DataFrame:
    return learning.predicted(spark, d).withColumn("other", (F.col("predicted") + (F.col("vec_id") % 2).cast("int")) % 10)


@query(f"""WITH {learning.PRED}, s AS (SELECT actual, CAST(actual = predicted AS INTEGER) AS a, CAST(actual = (predicted + CAST(vec_id % 2 AS INTEGER)) % 10 AS INTEGER) AS b
FROM pr)
SELECT actual AS class, unnest(['centre', 'shifted']) AS model, round(unnest([avg(a), avg(b)]), 6) AS accuracy FROM s GROUP BY actual""")
def accuracy_by_class_and_model(spark, d):
    return rounded(models.accuracy_by_model(two_models(spark, d), "actual", {"centre": "predicted", "shifted": "other"}), "accuracy")


@query(f"""WITH {learning.PRED}, s AS (SELECT 'centre' AS model, actual, predicted FROM pr UNION ALL SELECT 'shifted', actual, (predicted + CAST(vec_id % 2 AS INTEGER)) % 10
FROM pr),
a AS (SELECT model, avg(CAST(actual = predicted AS INTEGER)) AS accuracy FROM s GROUP BY model)
SELECT model, round(accuracy, 6) AS accuracy FROM a ORDER BY accuracy DESC, model LIMIT 1""")
def best_of_two_models(spark, d):
    return rounded(models.best_model(models.performance(two_models(spark, d), "actual", {"centre": "predicted", "shifted": "other"})), "accuracy")


@query()
def kmeans_ward_agreement(spark, d):
    """K-means and the tree's cut into as many clusters: the share of equal labels, and after naming them alike."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    means = cluster.kmeans_labels(e, "vec_id", "embedding", 10, 5).select("vec_id", (F.col("cluster") + 1).alias("means"))
    both = means.join(cluster.ward(e, "vec_id", "embedding", 10).select("vec_id", F.col("cluster").alias("tree")), "vec_id")
    return spark.createDataFrame(rounded(cluster.agreement(both, "means", "tree"), "agreement", "aligned_agreement").collect(), "agreement double, aligned_agreement double")


@query()
def run_features(spark, d):
    """The wide feature table of the run, a row for every cell."""
    return quick_run(spark, d).features


@query()
def run_k_sweep(spark, d):
    """Cost and silhouette by k of the run's cells, with the final fit's sums of squares beside."""
    run = quick_run(spark, d)
    rows, sweep, fit = run.clusters
    parts = cluster.sums_of_squares(rows, "v", "cluster")
    told = spark.createDataFrame([(k, c, s, k == fit.k) for k, c, s in sweep], "k int, wcss double, silhouette double, chosen boolean")
    return told.join(F.broadcast(parts))


@query()
def run_models(spark, d):
    """The three tuned models on the run's held-out cells, the best one marked."""
    merits = quick_run(spark, d).modelled[1]
    best = models.best_model(merits).select("model", F.lit(True).alias("best"))
    return merits.join(F.broadcast(best), "model", "left").fillna(False, ["best"])


@query()
def run_importance(spark, d):
    """What the three models go by, the twenty most important predictors."""
    return quick_run(spark, d).importance().limit(20)


@query()
def run_scores(spark, d):
    """The run from raw tables to scores: a row per cell of the grid."""
    return quick_run(spark, d).scores


RING_SQL = f"{space.BINNED}, t AS (SELECT q, r, unnest(range(7)) AS k FROM cells)"


@query(f"""WITH {RING_SQL} SELECT q, r, CAST(k AS INTEGER) AS k, round({space.EDGE} * {S3}::DOUBLE * (q + r / 2.0) + {space.EDGE} * cos(radians(k % 6 * 60 - 30)), 6) AS x,
round({space.EDGE} * 1.5::DOUBLE * r + {space.EDGE} * sin(radians(k % 6 * 60 - 30)), 6) AS y FROM t""")
def geojson_corners(spark, d):
    """The corners of each cell, closed, as its GeoJSON text has them."""
    text = space.cells(spark, d).select("q", "r", geo.geojson(geo.ring(F.col("q"), F.col("r"), space.EDGE)).alias("t"))
    points = F.from_json("t", "coordinates array<array<array<double>>>")["coordinates"][0]
    return rounded(text.select("q", "r", F.posexplode(points).alias("k", "p")).select("q", "r", "k", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")), "x", "y")


@query()
def run_score_map(spark, d):
    """The scores with the rings of their cells as GeoJSON, in degrees."""
    out = quick_run(spark, d).scores

    def degrees(p):
        lon, lat = geo.unproject(p["x"], p["y"], *ORIGIN)
        return F.struct(lon.alias("x"), lat.alias("y"))

    ring = F.transform(geo.ring(F.col("q"), F.col("r"), EDGE), degrees)
    return out.select("cell_id", "risk_score", "risk_category", "risk_score_rf", "risk_score_xgb", geo.geojson(ring).alias("geojson"))


@query()
def run_spatial_cv(spark, d):
    """Accuracy of the linear model over folds of square blocks, and over folds of like cells; refitted without each fold."""
    run = quick_run(spark, d)
    k = run.clusters[2].k
    known = run.features.join(run.clusters[0].select("cell_id", "cluster"), "cell_id", "left")
    rows = models.model_rows(models.outcomes(known, "cluster", k), "cell_id").withColumn("label", (F.col("cluster_class") - 1).cast("double"))
    rows = models.assembled(rows.join(run.grid.select("cell_id", "x", "y"), "cell_id"), models.PREDICTORS).persist()
    try:
        fit = models.linear(0.0, 0.01).fit
        blocks = models.cross_validate(analysis.spatial_folds(rows, 4 * EDGE, QUICK.folds), fit, "label", "fold")
        alike = models.cross_validate(models.cluster_folds(rows, folds=QUICK.folds), fit, "label", "fold")
    finally:
        rows.unpersist()
    return spark.createDataFrame([("blocks", blocks), ("clusters", alike)], "folds string, accuracy double")
