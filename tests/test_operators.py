"""Hand-made cases of the operators: nulls, zeros, ties, edges, invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlore.functions import nulls
from hexlore.operators import cluster, events, features, geo, models, score, shape
from hexlore.sources import tables
from hexlore.streaming import counts


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(str(k)) for k, c in enumerate(columns)]).first()


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<double>")


def test_null_rules(spark):
    none = F.lit(None).cast("double")
    r = one(spark, nulls.safe_div(F.lit(1.0), F.lit(0.0)), nulls.clamp(none), nulls.clamp(F.lit(120.0)), nulls.clamp(F.lit(-3.0)), nulls.nan_to_null(F.lit(float("nan"))), nulls.strict_mean(F.lit(1.0), none), nulls.is_in(none, [1.0]), nulls.paste(" ", none, F.lit("x")), nulls.change(F.lit(3.0), F.lit(0.0)), nulls.change(F.lit(3.0), F.lit(2.0)), nulls.if_else(none > 0, F.lit(1), F.lit(0)))
    assert tuple(r) == (None, None, 100.0, 0.0, None, None, False, "NA x", None, 50.0, None)


def test_series_helpers(spark):
    r = one(spark, nulls.rate_of_change(arr(2, 3, 4)), nulls.rate_of_change(arr(2)), nulls.acceleration(arr(1, 2, 4, 8)), nulls.acceleration(arr(1, 2)), nulls.volatility(arr(1, 3)), nulls.volatility(arr(-1, 1)), nulls.volatility(arr(1, 2), 3))
    assert r[0] == 100.0 and r[1] is None and r[2] == 1.5 and r[3] is None and abs(r[4] - math.sqrt(2) / 2) < 1e-12 and r[5] is None and r[6] is None


def test_strict_sum_and_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (2, 3.0)], "g int, x double")
    assert {r.g: r.s for r in df.groupBy("g").agg(nulls.strict_sum("x").alias("s")).collect()} == {1: None, 2: 5.0}
    same = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [r.y for r in nulls.with_minmax100(same, {"y": "x"}).collect()] == [None, None]
    assert [r.y for r in nulls.with_zscores(same, {"y": "x"}).collect()] == [None, None]


def test_category_edges(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([0.0, 25.0, 25.0001, 50.0, 75.0, 100.0, None])], "k int, s double")
    got = [r.c for r in df.select("k", score.categorise(F.col("s")).alias("c")).orderBy("k").collect()]
    assert got == ["Low", "Low", "Moderate", "Moderate", "High", "Very High", None]


def test_ecdf_has_ties_and_nulls(spark):
    rng = random.Random(1)
    xs = [None if rng.random() < 0.1 else float(rng.randrange(200)) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(xs)), "k int, x double")
    known = [x for x in xs if x is not None]
    got = {r.k: r.e for r in nulls.with_ecdf(df, {"e": "x"}, "k").collect()}
    assert got == {k: None if x is None else sum(y <= x for y in known) / len(known) for k, x in enumerate(xs)}


def test_ecdf_and_quantiles_of_many_values(spark):
    """More distinct values than approximate quantiles are exact for: totals and rows must still go by the same ranges."""
    n = 300_000
    df = spark.range(n, numPartitions=12).select("id", F.pmod(F.col("id") * 104_729, F.lit(n)).cast("double").alias("x"))
    # The first is 0, so that ranks are numbers plus one.
    wrong = nulls.with_ecdf(df, {"e": "x", "f": "x"}, "id").where((F.col("e") != (F.col("x") + 1) / n) | (F.col("f") != F.col("e")))
    assert [wrong.count() for _ in range(2)] == [0, 0]
    assert nulls.quantiles(df, [], ["x"], {"q": 0.75}).first()["q_x"] == 0.75 * (n - 1)


def test_periods_ties_and_gaps(spark):
    t = spark.createDataFrame([("2022 Q4",), ("2023 Q1 QTD",), ("bad",), (None,), ("2022 Q5",)], "t string")
    assert [str(r.p) for r in t.select(events.parse_quarter(F.col("t")).alias("p")).collect()] == ["2022-10-01", "2023-01-01", "None", "None", "None"]
    rows = [("a", 1, 5.0), ("a", 2, 6.0), ("a", 2, 7.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "g string, p int, v double")
    assert sorted((r.g, r.p) for r in events.snapshot(df, ["g"], "p").collect() if r.g == "a") == [("a", 2), ("a", 2)]
    assert [r.p for r in events.snapshot(df, ["g"], "p").collect() if r.g == "b"] == [None]
    gap = spark.sql("select * from values ('c', date'2020-01-01', 1.0D), ('c', date'2020-07-01', 2.0D), ('c', date'2021-01-01', 4.0D) as t(g, p, v)")
    place = {str(r.p): r.x for r in events.with_changes(gap, ["g"], "p", "v", {"x": 2}).collect()}
    calendar = {str(r.p): r.y for r in events.with_calendar_change(gap, ["g"], "p", "v", 6, "y").collect()}
    assert place["2021-01-01"] == 300.0 and calendar["2021-01-01"] == 100.0 and calendar["2020-01-01"] is None


def test_tidy_select(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a_x int, b int, a_y int, z int")
    assert shape.starts_with(df, "a_") == ["a_x", "a_y"] and shape.ends_with(df, "_y") == ["a_y"] and shape.between(df, "b", "z") == ["b", "a_y", "z"]
    assert shape.any_of(df, ["q", "b"]) == ["b"]
    with pytest.raises(ValueError):
        shape.all_of(df, ["q"])


def test_feature_category_takes_the_first_rule(spark):
    names = {"rent_vuln_interaction": "Temporal Rent", "demo_rent_interaction": "Demolitions", "income_burden_interaction": "Interactions", "rent_change_total_lag": "Spatial Lag", "pct_poc": "Other", "vuln_x_lag": "Vulnerability"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.c for r in df.select("n", features.category(F.col("n")).alias("c")).collect()} == names


def test_clip_and_hexagon(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert geo.clip_area(square, [(0.5, 0), (1.5, 0), (1.5, 1), (0.5, 1)]) == 0.5
    assert geo.clip_area(square, [(0.5, 1), (1.5, 1), (1.5, 0), (0.5, 0)]) == 0.5
    assert geo.clip_area(square, [(2, 2), (3, 2), (3, 3)]) == 0.0
    concave = [(0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2)]
    assert abs(geo.clip_area(concave, [(-1, -1), (3, -1), (3, 3), (-1, 3)]) - 2.5) < 1e-12
    a = one(spark, geo.ring_area(geo.ring(F.lit(3), F.lit(-2), 0.2)))[0]
    assert abs(a - geo.cell_area(0.2)) < 1e-12


def test_points_are_nearest_to_their_cell(spark):
    rng = random.Random(3)
    pts = spark.createDataFrame([(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(500)], "x double, y double")
    q, r = geo.cell_of(F.col("x"), F.col("y"), 0.7)
    for p in pts.select("x", "y", q.alias("q"), r.alias("r")).collect():
        d = lambda a, b: math.hypot(p.x - 0.7 * geo.SQRT3 * (a + b / 2), p.y - 0.7 * 1.5 * b)
        assert all(d(p.q, p.r) <= d(p.q + a, p.r + b) + 1e-9 for a, b in geo.OFFSETS)


def test_neighbour_mean(spark):
    cells = spark.createDataFrame([(0, 0, 7.0), *[(a, b, float(k)) for k, (a, b) in enumerate(geo.OFFSETS)]], "q long, r long, v double")
    got = {(r.q, r.r): r.v_lag for r in geo.lattice_lag(cells, ["v"]).collect()}
    assert got[0, 0] == 2.5 and len(got) == 7
    lone = spark.createDataFrame([(0, 0, 1.0)], "q long, r long, v double")
    assert geo.lattice_lag(lone, ["v"]).first().v_lag is None


@pytest.mark.parametrize(("n", "bucket"), [(1, None), (4, 0.05), (300, 0.05), (300, None)])
def test_nearest_is_exact(spark, n, bucket):
    rng = random.Random(n)
    pts = [(k, rng.random() ** 4, rng.random() ** 4) for k in range(n)]
    got = {}
    for r in geo.nearest(spark.createDataFrame(pts, "k long, x double, y double"), "k", 6, bucket).collect():
        got.setdefault(r.src, {})[r["rank"]] = r.dst
    for k, x, y in pts:
        best = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in pts if j != k)[:6]
        assert got.get(k, {}) == {i: j for i, (_, j) in enumerate(best, 1)}


def test_density_clusters(spark):
    xs = [0.0, 0.1, 0.2, 0.3, 0.4, 0.8, 9.0]
    df = spark.createDataFrame([(k, [x]) for k, x in enumerate(xs)], "k long, v array<double>")
    got = {r.k: (r.is_core, r.cluster) for r in cluster.dbscan(df, "k", "v", 0.45, 5).collect()}
    assert [got[k] for k in range(5)] == [(True, 1)] * 5 and got[5] == (False, 1) and got[6] == (False, 0)


def test_a_long_chain_is_one_cluster(spark):
    keys = list(range(400))
    random.Random(5).shuffle(keys)
    df = spark.createDataFrame([(k, [float(at)]) for at, k in enumerate(keys)] + [(1000 + k, [1000.0 + k / 10]) for k in range(5)], "k long, v array<double>")
    got = {r.k: r.cluster for r in cluster.dbscan(df, "k", "v", 1.5, 3).collect()}
    assert {got[k] for k in keys} == {1} and {got[1000 + k] for k in range(5)} == {2}
    with pytest.raises(RuntimeError):
        cluster.dbscan(df, "k", "v", 1.5, 3, rounds=1)


def test_ward_separates_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    merges = cluster.ward_merges(x)
    assert len(merges) == 59 and [m[2] for m in merges] == sorted(m[2] for m in merges)
    labels = cluster.cut_tree(merges, 60, 3)
    assert labels == [1] * 20 + [2] * 20 + [3] * 20


def test_ward_of_more_rows_than_one_task_takes(spark, monkeypatch):
    """Over blocks the tree is that of one task; copies, ties on a grid and clusters of far rows included."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.5, (90, 3)) for c in (0, 4, 9)] + [np.full((40, 3), 2.0), [[50.0] * 3, [51.0] * 3]])
    df = spark.createDataFrame([(3 * i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    grid = spark.createDataFrame([(i, [float(i % 20), float(i // 20)]) for i in range(400)], "id long, v array<double>")
    whole = {k: {r.id: r.cluster for r in cluster.ward(df, "id", "v", k).collect()} for k in (1, 5, 30)}
    monkeypatch.setattr(cluster, "MOST_TREE_ROWS", 25)
    monkeypatch.setattr(cluster, "BLOCK_BYTES", 2000)
    for k, want in whole.items():
        assert {r.id: r.cluster for r in cluster.ward(df, "id", "v", k).collect()} == want
    got = [r.cluster for r in cluster.ward(grid, "id", "v", 7).collect()]
    assert len(got) == 400 and set(got) == set(range(1, 8))


def test_sweep_takes_all_fits_at_once(spark):
    """Few jobs for many fits; costs and silhouettes are those of plain sums; groups that stand apart are found."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 5, 10)] + [np.full((30, 3), 5.0)])
    df = models.with_vector(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>"), "v", "features")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {k: (cost, width) for k, cost, width in cluster.sweep_kmeans(df, "id", "features", range(2, 6), 20)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 250
    group = np.repeat([0, 1, 2, 1], [60, 60, 60, 30])
    cost = sum(((x[group == g] - x[group == g].mean(axis=0)) ** 2).sum() for g in range(3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = np.stack([d[:, group == g].sum(axis=1) for g in range(3)], axis=1)
    n = np.bincount(group)
    a = near[np.arange(len(x)), group] / (n[group] - 1)
    b = np.where(np.arange(3) == group[:, None], np.inf, near / n).min(axis=1)
    assert abs(got[3][0] - cost) < 1e-6 and abs(got[3][1] - ((b - a) / np.maximum(a, b)).mean()) < 1e-9
    assert got[2][0] > got[3][0] > got[4][0] > got[5][0]
    few = models.with_vector(spark.createDataFrame([(i, [float(i % 2)]) for i in range(6)], "id long, v array<double>"), "v", "features")
    assert [(k, c) for k, c, _ in cluster.sweep_kmeans(few, "id", "features", [2, 4], 3)] == [(2, 0.0), (4, 0.0)]


def test_kmeans_labels_are_those_of_the_best_fit(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(7 * i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<float>")
    got = {r.id: r.cluster for r in cluster.kmeans_labels(df, "id", "v", 3, 8).collect()}
    assert sorted(got) == [7 * i for i in range(120)] and set(got.values()) == {0, 1, 2}
    assert all(len({got[7 * i] for i in range(at, at + 40)}) == 1 for at in (0, 40, 80))


def test_silhouette_of_lone_members(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 1), (3, [9.0], 2)], "k long, v array<double>, l int")
    got = {r.k: r.silhouette for r in cluster.silhouette(df, "k", "v", "l").collect()}
    assert got[3] == 0.0 and abs(got[1] - 8 / 9) < 1e-12 and abs(got[2] - 7 / 8) < 1e-12
    assert cluster.choose_k({2: 0.9, 3: 0.5}) == 4 and cluster.choose_k({5: 0.4, 6: 0.4, 2: 0.1}) == 5


def test_confusion_with_a_class_never_predicted(spark):
    rows = [(1, 1)] * 3 + [(1, 2)] + [(2, 2)] * 2 + [(3, 1)] * 2
    m = models.confusion(spark.createDataFrame(rows, "a int, p int"), "a", "p")
    assert m.count() == 9
    got = models.metrics(m).first()
    assert abs(got.accuracy - 5 / 8) < 1e-12 and abs(got.mean_f1 - (2 * 3 / 9 + 2 * 2 / 5) / 2) < 1e-12
    assert {r["class"]: r.f1 for r in models.by_class(m).collect()}[3] is None


def test_split_takes_the_ceiling(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(100)], "k long, y int")
    split = models.stratified_split(df, "k", "y")
    got = {r.y: (r.n, r.t) for r in split.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_train").alias("t")).collect()}
    assert all(t == math.ceil(0.7 * n) for n, t in got.values())
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, models.stratified_split(df.repartition(7), "k", "y").collect()))


def test_boosted_probabilities(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(float(k % 3), Vectors.dense([k % 3 + 0.01 * k, 1.0])) for k in range(60)], ["label", "features"])
    out = models.BoostedClasses.fit(df, 3, nrounds=3).transform(df).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out) and np.mean([r.prediction == r.label for r in out]) > 0.9


def test_ensemble_falls_back_and_clamps(spark):
    df = spark.createDataFrame([(1, 50.0, 60.0, 70.0), (2, None, 60.0, 70.0), (3, 400.0, 400.0, 400.0), (4, None, None, 1.0)], "k int, el double, rf double, xg double")
    w = spark.createDataFrame([(0.5, 0.25, 0.25)], "e double, f double, b double")
    got = {r.k: r.risk_score for r in score.ensemble(df, w, {"e": "el", "f": "rf", "b": "xg"}, ("e", "f", "b")).collect()}
    assert got == {1: 57.5, 2: 65.0, 3: 100.0, 4: None}


def test_histogram_and_popup(spark):
    df = spark.createDataFrame([(float(k),) for k in range(101)], "s double")
    bins = {r.bin: r.n for r in score.histogram(df, "s").collect()}
    assert sum(bins.values()) == 101 and max(bins) == 50 and bins[50] == 3
    text = one(spark, score.popup(F.lit(7), F.lit(None).cast("double"), F.lit("Low"), F.lit("a; b")))[0]
    assert text == "<b>Cell 7</b><br>Score: NA<br>Risk: Low<br>a<br>b"


def test_csv_audit(spark, tmp_path):
    path = tmp_path / "demo.csv"
    path.write_text("demo_id,latitude,longitude,demo_date,building_type\n1,30.1,-97.5,2020-01-02,House\n2,x,-97.5,2020-01-02,House\n3,30.2,-97.6,2021-05-06,\n")
    schema = tables.SCHEMAS["demolitions"]
    good = tables.read_csv(spark, str(path), schema)
    assert sorted(r.demo_id for r in good.collect()) == [1, 3] and tables.BAD not in good.columns
    assert sorted(r[0] for r in good.select("demo_id").collect()) == [1, 3]
    assert [r[tables.BAD] for r in tables.bad_rows(spark, str(path), schema).collect()] == ["2,x,-97.5,2020-01-02,House"]


def test_stage_tables(spark, tmp_path):
    df = spark.range(3).withColumn("ring", F.lit("geometry"))
    tables.save(df, str(tmp_path / "stage"))
    assert tables.load(spark, str(tmp_path / "stage")).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path / "none"), "cells")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id"]
    empty = tables.or_empty(spark, lambda: tables.load(spark, str(tmp_path / "none")), tables.SCHEMAS["statistics"])
    assert empty.count() == 0 and empty.columns == ["unit_id", "variable", "estimate"]


def test_streamed_counts_equal_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counts.by_year(counts.read(spark, str(tmp_path / "in"), batch), "user_id")
    run = stream.writeStream.format("memory").queryName("streamed").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.select("user_id", "year", "n").collect()))
    assert key(spark.table("streamed")) == key(counts.by_year(batch, "user_id"))


def test_entry_works_without_the_training_data_part():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['hexlore.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
