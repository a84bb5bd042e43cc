"""Polygon joins, sources, models and the run, by brute force, closed forms and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlore import analysis
from hexlore.functions import nulls
from hexlore.operators import cluster, events, geo, models, score, shape
from hexlore.plans import run
from hexlore.sources import tables
from hexlore.streaming import counts

RING = geo.RING


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def inside(x, y, points):
    hit = False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def stars(n, seed):
    """Polygons of any shape, some of them long and thin."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        cx, cy, w = rng.uniform(0, 10), rng.uniform(0, 10), rng.choice([0.2, 1, 4])
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 9)))
        out.append([(cx + w * rng.uniform(0.2, 1) * math.cos(t), cy + w * rng.uniform(0.2, 1) * math.sin(t)) for t in turns])
    return out


@pytest.mark.parametrize("bucket", [0.3, 2.0, 50.0])
def test_points_in_polygons_by_brute_force(spark, bucket):
    rng, shapes = random.Random(3), stars(25, 4)
    places = [(k, rng.uniform(-1, 11), rng.uniform(-1, 11)) for k in range(300)] + [(900, None, 1.0)]
    zones = spark.createDataFrame([(z, ring(p)) for z, p in enumerate(shapes)], f"zone int, ring {RING}")
    got = geo.points_in_polygons(spark.createDataFrame(places, "k int, x double, y double"), zones, "ring", bucket).collect()
    want = {(k, z) for k, x, y in places if x is not None for z, p in enumerate(shapes) if inside(x, y, p)}
    want |= {(k, None) for k, *_ in places if k not in {w[0] for w in want}}
    assert {(r.k, r.zone) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bucket", [0.4, 3.0])
def test_overlay_by_brute_force(spark, bucket):
    shapes, windows = stars(12, 5), [[(x, y), (x + 1.5, y), (x + 1.5, y + 1.5), (x, y + 1.5)] for x in range(0, 10, 2) for y in range(0, 10, 2)]
    a = spark.createDataFrame([(k, ring(p)) for k, p in enumerate(shapes)], f"a int, outline {RING}")
    b = spark.createDataFrame([(k, ring(p)) for k, p in enumerate(windows)], f"b int, hole {RING}")
    got = {(r.a, r.b): r.shared for r in geo.polygon_overlay(a, b, "outline", "hole", bucket).collect()}
    want = {(i, j): s for i, p in enumerate(shapes) for j, w in enumerate(windows) if (s := geo.clip_area(p, w)) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_centroid_and_projection(spark):
    square, l_shape = [(1, 1), (3, 1), (3, 3), (1, 3)], [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    df = spark.createDataFrame([(0, ring(square)), (1, ring(l_shape)), (2, ring([(0, 0), (1, 1)]))], f"k int, ring {RING}")
    x, y = geo.ring_centroid(F.col("ring"))
    got = {r.k: (r.x, r.y) for r in df.select("k", x.alias("x"), y.alias("y")).collect()}
    assert got[0] == (2.0, 2.0) and got[2] == (None, None)
    assert all(abs(c - 5 / 6) < 1e-12 for c in got[1])
    px, py = geo.project(F.col("lon"), F.col("lat"), 10.0, 50.0)
    lon, lat = geo.unproject(px, py, 10.0, 50.0)
    r = spark.createDataFrame([(10.5, 50.25)], "lon double, lat double").select(px.alias("x"), py.alias("y"), lon.alias("lon"), lat.alias("lat")).first()
    assert abs(r.lon - 10.5) < 1e-12 and abs(r.lat - 50.25) < 1e-12
    assert abs(r.y - 0.25 * math.pi / 180 * geo.EARTH) < 1e-6 and abs(r.x - 0.5 * math.pi / 180 * geo.EARTH * math.cos(math.radians(50))) < 1e-6


def test_geojson_features(spark):
    lines = [
        '{"type":"Feature","properties":{"NAME":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0.1,0.1],[0.2,0.1],[0.2,0.2],[0.1,0.1]]]}}',
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"NAME":"b"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}},{"type":"Feature","properties":{"NAME":"c"},"geometry":{"type":"Point","coordinates":[1,2]}}]}',
        "no json", None,
    ]
    got = tables.geojson_features(spark.createDataFrame([(t,) for t in lines], "value string"), "NAME:string").collect()
    assert sorted((r.NAME, len(r.ring), r.ring[1].x) for r in got) == [("a", 3, 1.0), ("b", 3, 2.0), ("b", 3, 6.0)]


def test_statistics_roads_and_rent_history(spark, tmp_path):
    spark.createDataFrame([("t1", "median_income", 5, None, "x"), ("t1", "unknown", 6, None, "x")], f"unit_id string, variable string, estimate int, ring {RING}, moe string").write.parquet(str(tmp_path / "s"))
    assert [tuple(r) for r in tables.read_statistics(spark, str(tmp_path / "s")).collect()] == [("t1", "median_income", 5.0, None)]
    spark.createDataFrame([("a", "I"), ("b", "M"), ("c", "S"), ("d", None)], "road_id string, RTTYP string").write.parquet(str(tmp_path / "r"))
    assert sorted(r.road_id for r in tables.read_roads(spark, str(tmp_path / "r")).collect()) == ["a", "c"]
    (tmp_path / "h.csv").write_text('Period,Building Address,Building Name,Zip Code,Asking Rent Per Unit\n2022 Q4 QTD,"1 Main, St",A,78701,1500.5\nlater,2 Main,B,78702,1\n2021 Q1,3 Main,C,78703,n/a\n')
    got = sorted((r.building_address, str(r.period), r.rent) for r in tables.read_rent_history(spark, str(tmp_path / "h.csv")).collect())
    assert got == [("1 Main, St", "2022-10-01", 1500.5), ("2 Main", "None", 1.0)]


def test_checkpoints_ask_for_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        tables.checkpoint_folder(Session())
    Context.master = "local[2]"
    assert tables.checkpoint_folder(Session())


def test_quantiles_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.1 else float("nan") if rng.random() < 0.1 else round(rng.gauss(0, 3), 1)) for _ in range(900)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.lo_x, r.med_x, r.hi_x) for r in nulls.quantiles(df, ["g"], ["x"], {"lo": 0.1, "med": 0.5, "hi": 0.93}, parts=7).collect()}
    assert set(got) == {"a", "b", None, "c", "d"}
    for g, told in got.items():
        known = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        want = np.quantile(known, [0.1, 0.5, 0.93]) if known else [None] * 3
        assert told == (None, None, None) if not known else np.allclose(told, want)


def test_volatility_of_a_negative_mean_and_large_values(spark):
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    r = spark.range(1).select(nulls.volatility(arr(-1, -3)).alias("a"), nulls.volatility(arr(-1, -3), positive=True).alias("b"), nulls.array_sd(arr(1e9, 1e9 + 1, 1e9 + 2)).alias("c")).first()
    assert abs(r.a + math.sqrt(2) / 2) < 1e-12 and r.b is None and abs(r.c - 1) < 1e-9


def test_series_by_ranges_are_the_same(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), rng.choice(["p", "q"]), None if rng.random() < 0.1 else round(rng.gauss(5, 2), 1), rng.choice(["a", "b", None])) for _ in range(800)]
    df = spark.createDataFrame(rows, "cell int, period string, v double, unit string")
    plain, ranged = (sorted(map(tuple, events.series(df, ["cell"], "period", "v", "unit", r).collect()), key=str) for r in (False, True))
    assert [r[:2] + r[3:] for r in plain] == [r[:2] + r[3:] for r in ranged]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(plain, ranged, strict=True))


def test_split_takes_the_share_of_every_class(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "big").when(F.col("id") < 4990, "mid").otherwise("few").alias("c"))
    got = {r.c: (r.n, r.t) for r in models.stratified_split(df, "id", "c").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_train").alias("t")).collect()}
    assert got == {"big": (4000, 2800), "mid": (990, 693), "few": (10, 7)}


@pytest.mark.parametrize("bytes_", [2_000_000, 1000])
def test_dbscan_by_brute_force(spark, bytes_, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK_BYTES", bytes_)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in (0, 2, 5)] + [rng.uniform(-3, 8, (30, 2))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.4
    core = near.sum(1) >= 5
    label, n = np.zeros(len(x), int), 0
    for k in np.flatnonzero(core):
        if not label[k]:
            n, todo = n + 1, [k]
            while todo:
                i = todo.pop()
                if not label[i]:
                    label[i] = n
                    todo += np.flatnonzero(near[i] & core & (label == 0)).tolist()
    want = {k: label[k] if core[k] else min([label[j] for j in np.flatnonzero(near[k] & core)], default=0) for k in range(len(x))}
    got = {r.k: (r.is_core, r.cluster) for r in cluster.dbscan(df, "k", "v", 0.4).collect()}
    assert got == {k: (bool(core[k]), want[k]) for k in want}
    far = {r.k: r.knn_dist for r in cluster.knn_distance(df, "k", "v", 5).collect()}
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)
    assert all(abs(far[k] - d[k, 5]) < 1e-12 for k in far)


def test_indicators_and_outcomes(spark):
    rows = [(k, True, *[None if c == 3 and k % 2 else float(k + c) for c in range(len(cluster.INDICATORS))]) for k in range(10)] + [(99, False, *[1.0] * len(cluster.INDICATORS)), (98, True, None, *[1.0] * (len(cluster.INDICATORS) - 1))]
    cells = spark.createDataFrame(rows, f"cell_id long, sufficient_data boolean, {', '.join(f'{c} double' for c in cluster.INDICATORS)}")
    kept, names = cluster.inputs(cells, "cell_id", limit=45.0)
    assert len(cluster.INDICATORS) == 15 and len(models.PREDICTORS) == 18
    assert names == [c for k, c in enumerate(cluster.INDICATORS) if k != 3] and sorted(r.cell_id for r in kept.collect()) == list(range(10))
    told = models.outcomes(spark.createDataFrame([(1, True), (2, True), (3, True), (7, True), (None, True), (1, False)], "cluster int, sufficient_data boolean"), "cluster", 4).collect()
    assert sorted(((r.cluster, r.cluster_class, r.high_risk_cluster) for r in told)) == [(1, 1, 1), (2, 2, 1), (3, 3, 0), (7, None, 0)]


def test_boost_tuning_takes_the_best_setting(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(k % 3), float(k % 3 + rng.normal() * 0.1), float(rng.normal())) for k in range(90)]
    df = models.assembled(spark.createDataFrame(rows, "id long, label double, a double, b double"), ["a", "b"])
    best, tried = models.tuned_boost(df, 3, folds=2, grid={"nrounds": [2], "max_depth": [1, 2], "eta": [0.1], "gamma": [0], "colsample_bytree": [0.8], "min_child_weight": [1], "subsample": [0.8]})
    assert [s["max_depth"] for s, _ in tried] == [1, 2] and all(0 <= a <= 1 for _, a in tried)
    assert best.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.9
    assert len(models.GRIDS["boost"]["eta"]) == 3 and math.prod(map(len, models.GRIDS["boost"].values())) == 216


def test_linear_scores_on_whole_rows_alone(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0), (None, 2.0, 9.0), (float("nan"), 2.0, 9.0)], "a double, b double, s double")
    assert [r.s for r in score.complete_only(df, ["a", "b"], ["s"]).collect()] == [9.0, None, None]
    assert tuple(nulls.completeness(df, ["a", "b"]).first()) == (1, 3, 33.3)


def test_selection(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    out = shape.select_as(df, shape.between(df, "a", "c"), without=["b"], e="d")
    assert out.columns == ["a", "c", "e"] and tuple(out.first()) == (1, 3, 4)
    with pytest.raises(ValueError):
        shape.select_as(df, ["a", "x"])


def test_windowed_counts_leave_late_rows_out(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([(t, "x") for t in ts], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    rows("2024-01-01 01:00:00", "2024-01-01 02:00:00", "2024-01-03 01:00:00").coalesce(1).write.parquet(folder)
    stream = counts.windowed(counts.read(spark, folder, spark.read.parquet(folder)))
    run = stream.writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        rows("2024-01-01 03:00:00", "2024-01-05 01:00:00").coalesce(1).write.mode("append").parquet(folder)
        run.processAllAvailable()
    finally:
        run.stop()
    got = {str(r.window_start)[:10]: r.n for r in spark.table("windowed").collect()}
    assert got["2024-01-01"] == 2 and got["2024-01-03"] == 1


def test_the_run(spark, sf_dir):
    """From raw tables to scores: every cell once, scores in range, the linear model on whole cells alone, sums that add up."""
    it = run.quick_run(spark, sf_dir)
    cells, out = it.grid.count(), it.scores.collect()
    assert len(out) == cells == len({r.cell_id for r in out})
    assert all(r.risk_score is None or 0 <= r.risk_score <= 100 for r in out) and any(r.risk_score is not None for r in out)
    assert {r.risk_category for r in out} <= {*score.CATEGORIES, None}
    whole = {r.cell_id for r in it.features.where(nulls.complete(it.features, models.PREDICTORS)).select("cell_id").collect()}
    assert {r.cell_id for r in out if r.risk_score_elastic is not None} == whole and 0 < len(whole) < cells
    assert all(len(r.contributing_factors.split("; ")) <= 3 for r in out)
    merits = {r.model: r for r in it.modelled[1].collect()}
    assert set(merits) == set(analysis.MODELS)
    rows, sweep, fit = it.clusters
    parts = cluster.sums_of_squares(rows, "v", "cluster").first()
    assert abs(parts.withinss - fit.cost) < 1e-6 * parts.totss and abs(parts.totss - parts.withinss - parts.betweenss) < 1e-6 * parts.totss
    assert [k for k, _, _ in sweep] == list(range(2, 7)) and fit.k == max(max(sweep, key=lambda s: s[2])[0], 4)
    # What an ensemble of three says is the weighted mean where all know the cell, of the trees where the linear one does not.
    total = sum(m.accuracy for m in merits.values())
    for r in out:
        trees = (r.risk_score_rf, r.risk_score_xgb)
        if r.risk_score is not None and r.risk_score_elastic is None and all(0 < t < 100 for t in trees):
            assert abs(r.risk_score - sum(trees) / 2) < 1e-9
        elif r.risk_score_elastic is not None and all(0 < t < 100 for t in (*trees, r.risk_score)):
            want = (r.risk_score_elastic * merits["elastic"].accuracy + trees[0] * merits["forest"].accuracy + trees[1] * merits["boost"].accuracy) / total
            assert abs(r.risk_score - want) < 1e-9
