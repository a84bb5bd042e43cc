"""Queries over embeddings: clusters, classes and their metrics; and over customers by segment: profiles and scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlore.config import Config
from hexlore.functions import nulls
from hexlore.operators import cluster, geo, models, score, shape
from hexlore.plans.registry import query, r6, rounded, table

FLAT = "fl AS (SELECT vec_id, label, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
PRED = f"""{FLAT}, ce AS (SELECT label AS c, d, avg(x) AS m FROM fl GROUP BY label, d), di AS (SELECT vec_id, label, c, sqrt(sum((x - m) ** 2)) AS dist FROM fl
JOIN ce USING (d) GROUP BY vec_id, label, c),
pr AS (SELECT vec_id, label AS actual, arg_min(c, (round(dist, 9), c)) AS predicted FROM di GROUP BY vec_id, label)"""


def flat(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))


def distances(spark, d) -> DataFrame:
    """vec_id, label and dists, the distances to the class centres as (c, dist) in order of classes.

    Centres are classes times dimensions and go to the rows as one broadcast array, so rows are not shuffled.
    """
    by = flat(spark, d).groupBy(F.col("label").alias("c"), "d").agg(F.avg("x").alias("m"))
    own = by.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))
    centres = F.broadcast(own.agg(F.sort_array(F.collect_list(F.struct("c", "m"))).alias("centres")))
    square = lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)
    dist = lambda m: F.sqrt(F.aggregate(F.zip_with("embedding", m, square), F.lit(0.0), lambda s, v: s + v))
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding").join(centres)
    return rows.select("vec_id", "label", F.transform("centres", lambda s: F.struct(s["c"].alias("c"), dist(s["m"]).alias("dist"))).alias("dists"))


def predicted(spark, d) -> DataFrame:
    """Each vector's class and that of the nearest class centre."""
    nearest = F.array_min(F.transform("dists", lambda s: F.struct(F.round(s["dist"], 9).alias("dist"), s["c"].alias("c"))))
    return distances(spark, d).select("vec_id", F.col("label").alias("actual"), nearest["c"].alias("predicted"))


@query(f"""WITH {FLAT}, s AS (SELECT d, avg(x) AS m, stddev_samp(x) AS s FROM fl GROUP BY d)
SELECT vec_id, CAST(d AS INTEGER) AS d, round((x - m) / nullif(s, 0), 6) AS z FROM fl JOIN s USING (d) WHERE d < 8""")
def zscore_matrix(spark, d):
    wide = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(str(k)) for k in range(8)])
    z = nulls.with_zscores(wide, {f"z{k}": str(k) for k in range(8)}).select("vec_id", *[F.col(f"z{k}").alias(str(k)) for k in range(8)])
    return shape.pivot_longer(z, ["vec_id"], [str(k) for k in range(8)], "d", "z").select("vec_id", F.col("d").cast("int").alias("d"), r6("z").alias("z"))


@query(f"""WITH {FLAT}, s AS (SELECT d, avg(x) AS m, stddev_samp(x) AS s FROM fl GROUP BY d)
SELECT vec_id, CAST(d AS INTEGER) AS d, round((x - m) / nullif(s, 0), 6) AS z FROM fl JOIN s USING (d)""")
def zscore_matrix_all(spark, d):
    """zscore_matrix, whose SQL ends at the eighth dimension, over all dimensions."""
    f = flat(spark, d)
    by = F.broadcast(f.groupBy("d").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")))  # a row per dimension
    return f.join(by, "d").select("vec_id", "d", r6(nulls.safe_div(F.col("x") - F.col("m"), "s")).alias("z"))


PAIR = """pa AS (SELECT a.vec_id AS i, a.label AS li, b.vec_id AS j, b.label AS lj, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
FROM embeddings a JOIN embeddings b ON true)"""


@query(f"""WITH {PAIR}, m AS (SELECT i, li, lj, sum(dist) AS t, count(*) AS n FROM pa GROUP BY i, li, lj), ab AS (SELECT i, li, max(CASE
WHEN li = lj AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN t / n END) AS b FROM m GROUP BY i, li)
SELECT i AS vec_id, CAST(li AS VARCHAR) AS label, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) AS silhouette FROM ab""")
def pairwise_silhouette(spark, d):
    return rounded(cluster.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label"), "silhouette")


@query(f"""WITH {FLAT}, g AS (SELECT label, d, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM fl GROUP BY label, d), c AS (SELECT d, sum(n * m) / sum(n) AS g FROM g
GROUP BY d)
SELECT round(sum(n * v) + sum(n * (m - g) ** 2), 6) AS totss, round(sum(n * v), 6) AS withinss, round(sum(n * (m - g) ** 2), 6) AS betweenss FROM g JOIN c USING (d)""")
def wcss_bss(spark, d):
    return rounded(cluster.sums_of_squares(table(spark, d, "embeddings"), "embedding", "label"), "totss", "withinss", "betweenss")


KNN = f"{PAIR}, kd AS (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist) AS k FROM pa WHERE i <> j)"


@query(f"WITH {KNN} SELECT round(quantile_cont(dist, 0.9), 6) AS eps FROM kd WHERE k = 5")
def knn_dist_eps(spark, d):
    return cluster.knn_distance(table(spark, d, "embeddings"), "vec_id", "embedding", 5).agg(r6(F.percentile("knn_dist", F.lit(0.9))).alias("eps"))


EPS = 0.95


@query(f"""WITH {PAIR}, nb AS (SELECT i, j FROM pa WHERE dist <= {EPS}), co AS (SELECT i, count(*) >= 5 AS is_core FROM nb GROUP BY i)
SELECT co.i AS vec_id, co.is_core AS is_core, NOT bool_or(c2.is_core) AS noise FROM co JOIN nb ON co.i = nb.i JOIN co c2 ON nb.j = c2.i GROUP BY co.i, co.is_core""")
def dbscan_core_noise(spark, d):
    return cluster.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", EPS).select("vec_id", "is_core", (F.col("cluster") == 0).alias("noise"))


IDS = f"""WITH RECURSIVE {PAIR}, nb AS (SELECT i, j FROM pa WHERE dist <= {EPS}), co AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= 5), ln AS (SELECT nb.i, nb.j
FROM nb JOIN co a ON nb.i = a.i JOIN co b ON nb.j = b.i),
re AS (SELECT i, i AS j FROM co UNION SELECT re.i, ln.j FROM re JOIN ln ON re.j = ln.i), rt AS (SELECT i, min(j) AS root FROM re
GROUP BY i), nu AS (SELECT i, dense_rank() OVER (ORDER BY root) AS id FROM rt),
cl AS (SELECT e.vec_id, CAST(coalesce((SELECT id FROM nu WHERE nu.i = e.vec_id), (SELECT min(id) FROM nu JOIN nb ON nb.j = nu.i
WHERE nb.i = e.vec_id), 0) AS INTEGER) AS cluster FROM embeddings e)"""


@query(f"{IDS} SELECT vec_id, cluster FROM cl")
def dbscan_ids(spark, d):
    return cluster.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", EPS).select("vec_id", "cluster")


@query()
def kmeans_best_of_n(spark, d):
    """The whole sweep: cost and mean silhouette of the best fit by k, and the k chosen by them."""
    config = Config()
    e, _ = cluster.standardise(table(spark, d, "embeddings"), "embedding", "features")
    e = e.select("vec_id", "features").persist()
    low, high = config.k_range
    try:
        fits = cluster.sweep_kmeans(e, "vec_id", "features", range(low, high + 1), config.restarts, config.most_iterations, config.seed)
    finally:
        e.unpersist()
    best = cluster.choose_k({k: s for k, _, s in fits}, config.least_k)
    return spark.createDataFrame([(k, c, s, k == best) for k, c, s in fits], "k int, wcss double, silhouette double, chosen boolean")


@query()
def ward_cut(spark, d):
    return cluster.ward(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


@query()
def pca_two(spark, d):
    e, _ = cluster.standardise(table(spark, d, "embeddings"), "embedding", "features")
    out, shares = cluster.principal(e, "features")
    return out.select("vec_id", *[F.get("pca", F.lit(k)).alias(f"pc{k + 1}") for k in range(2)], F.lit(shares[0]).alias("variance_1"))


@query(f"""WITH {PRED}, b AS (SELECT predicted, max(n) AS best FROM (SELECT actual, predicted, count(*) AS n FROM pr GROUP BY 1, 2) GROUP BY predicted)
SELECT round((SELECT avg(CAST(actual = predicted AS INTEGER)) FROM pr), 6) AS agreement, round((SELECT sum(best) FROM b) * 1.0 / (SELECT count(*)
FROM pr), 6) AS aligned_agreement""")
def label_agreement(spark, d):
    return rounded(cluster.agreement(predicted(spark, d), "actual", "predicted"), "agreement", "aligned_agreement")


@query("SELECT vec_id, CAST(label AS INTEGER) AS label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|42'), vec_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.7) AS in_train FROM embeddings")
def stratified_split(spark, d):
    return models.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


MATRIX = f"""{PRED}, lv AS (SELECT actual AS l FROM pr UNION SELECT predicted FROM pr),
cm AS (SELECT a.l AS actual, b.l AS predicted, coalesce(n, 0) AS n FROM lv a CROSS JOIN lv b LEFT JOIN (SELECT actual, predicted, count(*) AS n FROM pr
GROUP BY 1, 2) c ON a.l = c.actual AND b.l = c.predicted)"""
BYC = f"""{MATRIX}, bc AS (SELECT l AS class, (SELECT sum(n) FROM cm WHERE actual = l) AS n, (SELECT sum(n) FROM cm WHERE predicted = l) AS np, (SELECT sum(n) FROM cm
WHERE predicted = l AND actual = l) AS tp FROM lv),
f1 AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (n + np) END AS f1 FROM bc)"""


@query(f"WITH {MATRIX} SELECT actual, predicted, CAST(n AS BIGINT) AS n FROM cm")
def confusion_matrix(spark, d):
    return models.confusion(predicted(spark, d), "actual", "predicted")


@query(f"""WITH {BYC}, s AS (SELECT sum(tp) * 1.0 / sum(n) AS po, sum(n * np) * 1.0 / (sum(n) * sum(n)) AS pe, avg(f1) AS f FROM f1)
SELECT round(CAST(po AS DOUBLE), 6) AS accuracy, round(CAST((po - pe) / (1 - pe) AS DOUBLE), 6) AS kappa, round(CAST(f AS DOUBLE), 6) AS mean_f1 FROM s""")
def accuracy_kappa(spark, d):
    return rounded(models.metrics(models.confusion(predicted(spark, d), "actual", "predicted")), "accuracy", "kappa", "mean_f1")


@query(f"WITH {BYC} SELECT CAST(class AS INTEGER) AS class, round(CAST(f1 AS DOUBLE), 6) AS f1 FROM f1")
def f1_by_class(spark, d):
    return models.by_class(models.confusion(predicted(spark, d), "actual", "predicted")).select("class", r6("f1").alias("f1"))


@query(f"""WITH {PRED} SELECT actual AS class, 'centre' AS model, round(avg(CAST(actual = predicted AS INTEGER)), 6) AS accuracy FROM pr GROUP BY actual
UNION ALL SELECT actual, 'constant', round(avg(CAST(actual = 3 AS INTEGER)), 6) FROM pr GROUP BY actual""")
def accuracy_by_class_long(spark, d):
    hit = lambda c: F.avg((F.col("actual") == c).cast("double"))
    wide = predicted(spark, d).groupBy(F.col("actual").alias("class")).agg(hit(F.col("predicted")).alias("centre"), hit(F.lit(3)).alias("constant"))
    return rounded(shape.pivot_longer(wide, ["class"], ["centre", "constant"], "model", "accuracy"), "accuracy")


@query(f"""WITH {PRED}, u AS (SELECT 'Actual' AS type, actual AS class FROM pr UNION ALL SELECT 'Predicted', predicted FROM pr)
SELECT type, class, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY type), 6) AS proportion FROM u GROUP BY 1, 2""")
def prediction_distribution(spark, d):
    from pyspark.sql import Window

    u = shape.pivot_longer(
        predicted(spark, d), ["vec_id"], ["actual", "predicted"], "type", "class",
    ).groupBy(F.initcap("type").alias("type"), "class").agg(F.count(F.lit(1)).alias("n"))
    return u.withColumn("proportion", r6(F.col("n") / F.sum("n").over(Window.partitionBy("type"))))


@query(f"WITH {PRED} SELECT actual, predicted, actual = predicted AS correct, count(*) AS n FROM pr GROUP BY 1, 2")
def agreement_counts(spark, d):
    return models.agreement_counts(predicted(spark, d), "actual", "predicted")


IMP = """ia AS (SELECT 'd' || d AS feature, stddev_samp(x) AS imp_a FROM fl WHERE d < 12 GROUP BY d),
ib AS (SELECT 'd' || d AS feature, avg(abs(x)) AS imp_b FROM fl WHERE d BETWEEN 4 AND 15 GROUP BY d)"""


@query(f"""WITH {FLAT}, {IMP}, j AS (SELECT coalesce(ia.feature, ib.feature) AS feature, imp_a, imp_b FROM ia FULL
JOIN ib ON ia.feature = ib.feature), n AS (SELECT *, (imp_a - min(imp_a) OVER ()) / (max(imp_a) OVER () - min(imp_a) OVER ()) * 100 AS norm_a, (imp_b - min(imp_b) OVER ()) / (max(imp_b) OVER () - min(imp_b) OVER ()) * 100 AS norm_b FROM j)
SELECT feature, round(norm_a, 4) AS norm_a, round(norm_b, 4) AS norm_b, round(list_avg(list_filter([norm_a, norm_b], lambda x: x IS NOT NULL)), 4) AS importance_avg
FROM n""")
def importance_merge(spark, d):
    f = flat(spark, d)
    name = F.concat(F.lit("d"), F.col("d").cast("string")).alias("feature")
    a = f.where("d < 12").groupBy(name).agg(F.stddev_samp("x").alias("importance"))
    b = f.where("d between 4 and 15").groupBy(name).agg(F.avg(F.abs("x")).alias("importance"))
    out = models.merge_importance({"a": a, "b": b})
    return out.select("feature", *[F.round(c, 4).alias(c) for c in ("norm_a", "norm_b", "importance_avg")])


@query("SELECT CAST(a AS DOUBLE) AS nrounds, CAST(b AS DOUBLE) AS max_depth, CAST(c AS DOUBLE) AS eta, CAST(g AS DOUBLE) AS gamma, CAST(s AS DOUBLE) AS colsample_bytree, 1.0::DOUBLE AS min_child_weight, CAST(u AS DOUBLE) AS subsample FROM unnest([100, 200, 300]) t1(a), unnest([3, 4, 6]) t2(b), unnest([0.01, 0.05, 0.1]) t3(c), unnest([0, 0.1]) t4(g), unnest([0.6, 0.8]) t5(s), unnest([0.7, 0.8]) t6(u)")
def param_grid(spark, d):
    return models.param_grid(spark, models.GRIDS["boost"])


def classes(spark, d) -> DataFrame:
    """Whole vectors as ML features, with their labels as classes, a split, and folds of square blocks of their places."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    x, y = geo.pseudo_xy("vec_id")
    return models.stratified_split(e, "vec_id", "label").withColumn("fold", geo.fold_of_block(x, y, 0.25, 3))


def scored(spark, d, fit) -> DataFrame:
    """accuracy on the rows held out, of what fit makes of the others."""
    df = classes(spark, d).persist()
    try:
        hit = (F.col("prediction") == F.col("label")).cast("double")
        accuracy = fit(df.where("in_train")).transform(df.where("not in_train")).agg(F.avg(hit)).first()[0]
    finally:
        df.unpersist()
    return spark.createDataFrame([(accuracy,)], "accuracy double")


@query()
def elastic_cv(spark, d):
    """Four of the sixty settings, two folds; run_models tunes on the run's own cells."""
    return scored(spark, d, models.elastic_net(folds=2, grid={"alpha": [0.0, 1.0], "lambda": [0.001, 0.1]}).fit)


@query()
def rf_cv(spark, d):
    """Two of the four settings with twenty trees, two folds."""
    return scored(spark, d, models.forest(trees=20, folds=2, grid={"mtry": [3, 5]}, depth=6).fit)


@query()
def gbt_multiclass(spark, d):
    """One of the 216 settings with five rounds: ten classes of it are ten boosted models."""
    n_classes = int(table(spark, d, "embeddings").agg(F.max("label")).first()[0]) + 1
    return scored(spark, d, lambda train: models.BoostedClasses.fit(train, n_classes, nrounds=5))


@query()
def spatial_cv(spark, d):
    """Accuracy over folds of square blocks, a model refitted without each."""
    df = classes(spark, d).persist()
    try:
        accuracy = models.cross_validate(df, models.linear(0.0, 0.01).fit, "label", "fold")
    finally:
        df.unpersist()
    return spark.createDataFrame([(accuracy,)], "accuracy double")


@query()
def cluster_folds(spark, d):
    """The sizes of folds of like rows, and the accuracy on each of a model refitted without it."""
    df = models.cluster_folds(classes(spark, d).drop("fold")).select("vec_id", "label", "features", "fold").persist()
    try:
        n = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}  # five rows
        hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
        rows = [(f, n[f], models.linear(0.0, 0.01).fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f)).agg(hit).first()[0]) for f in sorted(n)]
    finally:
        df.unpersist()
    return spark.createDataFrame(rows, "fold int, n long, accuracy double")


@query()
def variable_importance(spark, d):
    """What all three kinds of models go by, on all dimensions; quick settings."""
    df = classes(spark, d).persist()
    try:
        names = [f"d{k}" for k in range(df.first().features.size)]
        train = df.where("in_train")
        n_classes = int(train.agg(F.max("label")).first()[0]) + 1
        fitted = {
            "elastic": models.linear(0.0, 0.01).fit(train), "forest": models.forest(trees=10, folds=2, grid={"mtry": [3]}, depth=5).fit(train),
            "boost": models.BoostedClasses.fit(train, n_classes, nrounds=2),
        }
        tables = {name: models.importance(m, names, spark) for name, m in fitted.items()}
    finally:
        df.unpersist()
    return models.merge_importance(tables)


SEG = """sg AS (SELECT c_mktsegment AS cluster, c_acctbal AS rent, c_custkey * 7919 % 1000 / 10.0 AS demo, CASE
WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey * 104729 % 1000 / 10.0 END AS vuln FROM customer)"""
PROF = f"{SEG}, pf AS (SELECT cluster, count(*) AS n, avg(rent) AS mean_rent, avg(demo) AS mean_demo, avg(vuln) AS mean_vuln FROM sg GROUP BY cluster)"
MEANS = ["mean_rent", "mean_demo", "mean_vuln"]


def segmented(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k, F.col("c_mktsegment").alias("cluster"), F.col("c_acctbal").alias("rent"), (k * 7919 % 1000 / 10.0).alias("demo"),
        F.when(k % 13 != 0, k * 104729 % 1000 / 10.0).alias("vuln"),
    )


def profiled(spark, d) -> DataFrame:
    return cluster.profiles(segmented(spark, d), "cluster", ["rent", "demo", "vuln"])


def norm(c: str) -> str:
    return f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) * 100"


@query(f"WITH {PROF} SELECT cluster, n, {', '.join(f'round({c}, 6) AS {c}' for c in MEANS)} FROM pf")
def cluster_profiles(spark, d):
    return rounded(profiled(spark, d), *MEANS)


@query(f"""WITH {SEG}, md AS (SELECT cluster, median(rent) AS a, median(demo) AS b, median(vuln) AS c FROM sg
GROUP BY cluster), e AS (SELECT md.cluster, avg(CAST(rent <= a AS INTEGER)) AS a, avg(CAST(demo <= b AS INTEGER)) AS b, avg(CASE
WHEN vuln IS NOT NULL THEN CAST(vuln <= c AS INTEGER) END) AS c FROM md CROSS JOIN sg GROUP BY md.cluster)
SELECT cluster, {" || ' + ' || ".join(f"CASE WHEN {c} > 0.66 THEN 'High' WHEN {c} > 0.33 THEN 'Moderate' ELSE 'Low' END || ' {n}'" for c, n in zip('abc', ('Rent', 'Demolition', 'Vulnerability')))} AS label_text FROM e""")
def cluster_labels_text(spark, d):
    return cluster.labels(segmented(spark, d), "cluster", {"Rent": "rent", "Demolition": "demo", "Vulnerability": "vuln"})


@query(f"""WITH {PROF}, nm AS (SELECT cluster, {', '.join(f'{norm(c)} AS {c}' for c in MEANS)} FROM pf)
SELECT cluster, unnest([{', '.join(repr(c) for c in MEANS)}]) AS variable, round(unnest([{', '.join(MEANS)}]), 6) AS value FROM nm""")
def profile_normalized_long(spark, d):
    n = nulls.with_minmax100(profiled(spark, d), {f"n_{c}": c for c in MEANS}).select("cluster", *[F.col(f"n_{c}").alias(c) for c in MEANS])
    return rounded(shape.pivot_longer(n, ["cluster"], MEANS), "value")


RISK = f"{PROF}, rk AS (SELECT cluster, 0.4 * ({norm('mean_rent')}) + 0.3 * ({norm('mean_demo')}) + 0.3 * ({norm('mean_vuln')}) AS risk FROM pf)"


@query(f"WITH {RISK} SELECT cluster, round(CAST(risk AS DOUBLE), 6) AS risk FROM rk")
def cluster_risk_map(spark, d):
    return score.cluster_risk(profiled(spark, d), {"mean_rent": 0.4, "mean_demo": 0.3, "mean_vuln": 0.3}).select("cluster", r6("risk").alias("risk"))


SOFT = f"{PRED}, so AS (SELECT vec_id, sum(exp(-dist) * (c * 10.0)) / sum(exp(-dist)) AS expected FROM di GROUP BY vec_id)"


def expected(spark, d) -> DataFrame:
    """Class probabilities by distance, class c of risk 10 c, and the risk they lead to expect."""
    weights = F.transform("dists", lambda s: F.exp(-s["dist"]))
    total = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    told = score.expected_risk(F.transform(weights, lambda v: v / total), F.transform("dists", lambda s: s["c"] * 10.0))
    return distances(spark, d).select("vec_id", told.alias("expected"))


@query(f"WITH {SOFT} SELECT pr.vec_id, round(CAST(expected AS DOUBLE), 6) AS expected, predicted * 10.0::DOUBLE AS class_risk FROM so JOIN pr USING (vec_id)")
def expected_risk(spark, d):
    risks = spark.createDataFrame([(c, c * 10.0) for c in range(10)], "cluster int, risk double")
    known = score.risk_of_class(predicted(spark, d), "predicted", risks, "class_risk").select("vec_id", "class_risk")
    return rounded(expected(spark, d).join(known, "vec_id"), "expected")


ENS = f"""{SOFT}, en AS (SELECT so.vec_id, CASE WHEN so.vec_id % 10 = 0 THEN NULL ELSE expected END AS el, predicted * 12.0 AS rf, (actual + 1) * 11.0 AS xg FROM so
JOIN pr USING (vec_id)),
es AS (SELECT vec_id, round(CAST(greatest(0, least(100, CASE
WHEN el IS NULL THEN (rf + xg) / 2 ELSE el * 0.6 / 2.0 + rf * 0.65 / 2.0 + xg * 0.75 / 2.0 END)) AS DOUBLE), 6) AS risk_score FROM en),
ec AS (SELECT *, CASE WHEN risk_score <= 25 THEN 'Low' WHEN risk_score <= 50 THEN 'Moderate' WHEN risk_score <= 75 THEN 'High'
WHEN risk_score > 75 THEN 'Very High' END AS risk_category FROM es)"""


def ensembled(spark, d) -> DataFrame:
    rows = expected(spark, d).join(predicted(spark, d), "vec_id")
    rows = rows.select(
        "vec_id", F.when(F.col("vec_id") % 10 != 0, F.col("expected")).alias("el"), (F.col("predicted") * 12.0).alias("rf"),
        ((F.col("actual") + 1) * 11.0).alias("xg"),
    )
    accuracy = spark.createDataFrame([(0.6, 0.65, 0.75)], "elastic double, forest double, boost double")
    out = score.ensemble(rows, accuracy, {"elastic": "el", "forest": "rf", "boost": "xg"}, ("elastic", "forest", "boost"))
    out = rounded(out, "risk_score")
    return out.withColumn("risk_category", score.categorise(F.col("risk_score"))).select("vec_id", "risk_score", "risk_category")


@query(f"WITH {ENS} SELECT * FROM ec")
def ensemble_score(spark, d):
    return ensembled(spark, d)


@query(f"WITH {ENS} SELECT risk_category AS category, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM ec GROUP BY 1")
def risk_categories(spark, d):
    return score.category_counts(ensembled(spark, d), "risk_category")


@query(f"""WITH {ENS} SELECT unnest(['Mean', 'Median', 'SD', 'Min', 'Max']) AS metric, round(unnest([avg(risk_score), median(risk_score), stddev_samp(risk_score), min(risk_score), max(risk_score)]), 4) AS value FROM ec""")
def risk_summary(spark, d):
    return score.summary(ensembled(spark, d), "risk_score").withColumn("value", F.round("value", 4))


@query(f"WITH {ENS} SELECT * FROM ec ORDER BY risk_score DESC NULLS LAST, vec_id LIMIT 10")
def top10_risk(spark, d):
    return score.top(ensembled(spark, d), "risk_score", "vec_id")


@query(f"""WITH {ENS}, m AS (SELECT min(risk_score) AS lo, max(risk_score) AS hi FROM ec)
SELECT CAST(least(50, floor((risk_score - lo) * 50 / (hi - lo)) + 1) AS INTEGER) AS bin, count(*) AS n FROM ec CROSS JOIN m GROUP BY 1""")
def score_histogram(spark, d):
    return score.histogram(ensembled(spark, d), "risk_score")


@query(f"""WITH {ENS} SELECT count(*) AS n_cells, round(avg(risk_score), 4) AS mean_score, round(median(risk_score), 4) AS median_score, count(CASE
WHEN risk_category IN ('High', 'Very High') THEN 1 END) AS n_high, round(count(CASE
WHEN risk_category IN ('High', 'Very High') THEN 1 END) * 100.0 / count(*), 4) AS pct_high FROM ec""")
def dashboard_metrics(spark, d):
    out = score.dashboard(ensembled(spark, d), "risk_score", "risk_category")
    return out.withColumns({c: F.round(c, 4) for c in ("mean_score", "median_score", "pct_high")})


@query("""SELECT min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS median, round(avg(c_acctbal), 4) AS mean,
round(quantile_cont(c_acctbal, 0.75), 4) AS q3, max(c_acctbal) AS max FROM customer""")
def five_number_summary(spark, d):
    out = score.five_numbers(table(spark, d, "customer"), "c_acctbal")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "mean", "q3")})


ECDF = """ed AS (SELECT c_custkey, rent, demo, vuln, CASE WHEN rent IS NOT NULL THEN cume_dist() OVER (PARTITION BY rent IS NULL ORDER BY rent) END AS er, CASE
WHEN demo IS NOT NULL THEN cume_dist() OVER (PARTITION BY demo IS NULL ORDER BY demo) END AS ed, CASE
WHEN vuln IS NOT NULL THEN cume_dist() OVER (PARTITION BY vuln IS NULL ORDER BY vuln) END AS ev FROM sk)"""
SK = SEG.replace("sg AS (SELECT", "sk AS (SELECT c_custkey,")


@query(f"WITH {SK}, {ECDF} SELECT c_custkey, round(er, 9) AS er, round(ev, 9) AS ev FROM ed")
def ecdf_ranks(spark, d):
    out = nulls.with_ecdf(segmented(spark, d), {"er": "rent", "ev": "vuln"}, "c_custkey")
    return out.select("c_custkey", F.round("er", 9).alias("er"), F.round("ev", 9).alias("ev"))


FACT = f"""{SK}, {ECDF}, fa AS (SELECT c_custkey, list_filter([CASE WHEN ev >= 0.75 THEN 'vuln' END, CASE WHEN er >= 0.75 THEN 'rent' END, CASE WHEN ed >= 0.75 THEN 'demo' END], lambda x: x IS NOT NULL) AS f FROM ed)"""


@query(f"WITH {FACT} SELECT c_custkey, CASE WHEN len(f) > 0 THEN array_to_string(f[1:2], '; ') ELSE 'Multiple factors' END AS contributing_factors FROM fa")
def contributing_factors(spark, d):
    return score.factors(segmented(spark, d), "c_custkey", ["vuln", "rent", "demo"], top_n=2).select("c_custkey", "contributing_factors")


@query(f"""WITH {ENS} SELECT vec_id, '<b>Cell ' || vec_id || '</b><br>Score: ' || format('{{:,.1f}}', round_even(risk_score, 1)) || '<br>Risk: ' || risk_category || '<br>' || CASE
WHEN vec_id % 3 = 0 THEN 'NA' ELSE 'rent<br>demo' END AS popup FROM ec""")
def popup_text(spark, d):
    e = ensembled(spark, d)
    why = F.when(F.col("vec_id") % 3 != 0, F.lit("rent; demo"))
    return e.select("vec_id", score.popup(F.col("vec_id"), F.col("risk_score"), F.col("risk_category"), why).alias("popup"))


@query("SELECT model, round(accuracy, 6) AS accuracy FROM (SELECT unnest(['a', 'b', 'c']) AS model, unnest([0.5, 0.7, 0.7]::DOUBLE[]) AS accuracy) ORDER BY accuracy DESC, model LIMIT 1")
def best_model(spark, d):
    return models.best_model(spark.createDataFrame([("a", 0.5), ("b", 0.7), ("c", 0.7)], "model string, accuracy double"))
