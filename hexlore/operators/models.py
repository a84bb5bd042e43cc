"""Splits, multi-class models with cross-validation, their metrics and importances."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexlore.functions.nulls import complete, safe_div, with_minmax100

#: The full grids; smaller ones are for quick runs.
GRIDS = {
    "elastic": {"alpha": [0.0, 0.5, 1.0], "lambda": [float(v) for v in np.linspace(0.001, 1, 20)]},
    "forest": {"mtry": [3, 5, 7, 10]},
    "boost": {
        "nrounds": [100, 200, 300], "max_depth": [3, 4, 6], "eta": [0.01, 0.05, 0.1], "gamma": [0, 0.1], "colsample_bytree": [0.6, 0.8],
        "min_child_weight": [1], "subsample": [0.7, 0.8],
    },
}
#: The predictors of a cell's cluster, and the clusters that count as high risk.
PREDICTORS = [
    "rent_change_recent", "rent_acceleration", "rent_volatility", "rent_level_ratio",
    "demo_density", "demo_recent", "has_recent_demos",
    "median_income", "pct_renter", "pct_college", "poverty_rate", "pct_poc", "rent_burden_proxy",
    "rent_change_total_lag", "demo_density_lag", "median_income_lag",
    "rent_vuln_interaction", "neighborhood_rent_pressure",
]
HIGH_RISK = (1, 2)


def outcomes(df: DataFrame, cluster: str, n_clusters: int) -> DataFrame:
    """Rows of enough data and a known cluster, with cluster_class (1 to n_clusters, else null) and high_risk_cluster."""
    inside = F.col(cluster).between(1, n_clusters)
    rows = df.where(F.col("sufficient_data") & F.col(cluster).isNotNull())
    return rows.withColumns({"cluster_class": F.when(inside, F.col(cluster).cast("int")), "high_risk_cluster": F.col(cluster).isin(*HIGH_RISK).cast("int")})


def model_rows(df: DataFrame, key: str, predictors: list[str] = PREDICTORS) -> DataFrame:
    """key, outcomes and predictors of the rows that miss none of them."""
    columns = ["cluster_class", "high_risk_cluster", *predictors]
    return df.select(key, *columns).where(complete(df, columns))


def assembled(df: DataFrame, predictors: list[str], out: str = "features") -> DataFrame:
    """df with its predictors as one vector; missing ones are NaN, which trees send one way and the linear model must not see."""
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in predictors])
    return df.withColumn(out, array_to_vector(values))


def with_vector(df: DataFrame, values: str, out: str) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(values)))


def zeros(n: int) -> Column:
    return array_to_vector(F.array(*[F.lit(0.0)] * n))


def param_grid(spark, grid: dict[str, list]) -> DataFrame:
    """Every combination of values, one per row."""
    names = list(grid)
    return spark.createDataFrame([tuple(map(float, row)) for row in product(*grid.values())], names)


def shuffled(key: str, seed: int) -> Column:
    """A fixed random order of keys, the same in every engine with md5."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """df with in_train: the first ceil(share * n) rows of each class in a fixed random order.

    The order is cut into intervals of the hash; sums over these give how many rows come before, and rows are put in
    order inside their interval alone, so no class goes through one task.
    """
    hashed = df.withColumns({"hash_": shuffled(key, seed), "bin_": F.conv(F.substring(shuffled(key, seed), 1, 4), 16, 10).cast("int")})
    counts = hashed.groupBy(F.col(label).alias("class_"), F.col("bin_").alias("at_")).agg(F.count(F.lit(1)).alias("n_"))
    w = Window.partitionBy("class_")
    before = counts.withColumns({"before_": F.sum("n_").over(w.orderBy("at_")) - F.col("n_"), "need_": F.ceil(F.sum("n_").over(w) * share)}).drop("n_")
    place = F.row_number().over(Window.partitionBy(label, "bin_").orderBy("hash_", key))
    rows = hashed.withColumn("place_", place).join(before, F.col(label).eqNullSafe(F.col("class_")) & (F.col("bin_") == F.col("at_")))
    return rows.withColumn("in_train", F.col("before_") + F.col("place_") <= F.col("need_")).select(*df.columns, "in_train")


def linear(alpha: float, strength: float, features: str = "features", label: str = "label") -> Pipeline:
    """One multinomial linear model on scaled features, without tuning."""
    lr = LogisticRegression(featuresCol="scaled_", labelCol=label, family="multinomial", maxIter=100, standardization=False, elasticNetParam=alpha, regParam=strength)
    return Pipeline(stages=[StandardScaler(inputCol=features, outputCol="scaled_", withMean=True, withStd=True), lr])


def elastic_net(features: str = "features", label: str = "label", folds: int = 5, grid: dict | None = None, fold_col: str = "", seed: int = 42) -> CrossValidator:
    lr = LogisticRegression(featuresCol="scaled_", labelCol=label, family="multinomial", maxIter=100, standardization=False)
    g = grid or GRIDS["elastic"]
    params = ParamGridBuilder().addGrid(lr.elasticNetParam, g["alpha"]).addGrid(lr.regParam, g["lambda"]).build()
    scaled = StandardScaler(inputCol=features, outputCol="scaled_", withMean=True, withStd=True)
    return _tuned(Pipeline(stages=[scaled, lr]), params, label, folds, fold_col, seed)


def forest(
    features: str = "features", label: str = "label", trees: int = 500, folds: int = 5, grid: dict | None = None, fold_col: str = "", depth: int = 15,
    seed: int = 42,
) -> CrossValidator:
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    params = ParamGridBuilder().addGrid(rf.featureSubsetStrategy, [str(m) for m in (grid or GRIDS["forest"])["mtry"]]).build()
    return _tuned(rf, params, label, folds, fold_col, seed)


def _tuned(estimator, params, label: str, folds: int, fold_col: str, seed: int) -> CrossValidator:
    score = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return CrossValidator(estimator=estimator, estimatorParamMaps=params, evaluator=score, numFolds=folds, foldCol=fold_col, seed=seed, parallelism=8)


@dataclass
class BoostedClasses:
    """One boosted model per class; the classes' scores, normalised, are the probabilities. It is no XGBoost."""

    features: str
    models: list[Model] = field(default_factory=list)

    @classmethod
    def fit(
        cls, df: DataFrame, n_classes: int, *, features: str = "features", label: str = "label", nrounds: int = 20, max_depth: int = 3,
        eta: float = 0.1, gamma: float = 0.0, subsample: float = 1.0, colsample: float = 1.0, min_child_weight: int = 1, seed: int = 42,
    ) -> BoostedClasses:
        out = cls(features)
        for c in range(n_classes):
            one = df.withColumn("one_", (F.col(label) == c).cast("double"))
            gbt = GBTClassifier(
                featuresCol=features, labelCol="one_", maxIter=nrounds, maxDepth=max_depth, stepSize=eta, minInfoGain=gamma,
                subsamplingRate=subsample, featureSubsetStrategy=str(colsample) if colsample < 1 else "all", minInstancesPerNode=min_child_weight,
                seed=seed,
            )
            out.models.append(gbt.fit(one))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with probability (array) and prediction (the first of the likeliest classes)."""
        kept = df.columns
        for k, m in enumerate(self.models):
            m = m.copy().setPredictionCol(f"y{k}_").setProbabilityCol(f"p{k}_").setRawPredictionCol(f"r{k}_")
            df = m.transform(df).withColumn(f"s{k}_", F.get(vector_to_array(f"p{k}_"), F.lit(1)))
        scores = [F.col(f"s{k}_") for k in range(len(self.models))]
        total = sum(scores[1:], scores[0])
        out = df.withColumn("probability", F.array(*[safe_div(s, total) for s in scores]))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double")).select(*kept, "probability", "prediction")


def tuned_boost(
    df: DataFrame, n_classes: int, *, features: str = "features", label: str = "label", grid: dict | None = None, folds: int = 5, fold_col: str = "",
    seed: int = 42, jobs: int = 4,
) -> tuple[BoostedClasses, list[tuple[dict, float]]]:
    """The boosted classes of the best setting, refitted on all rows, and every setting with its mean accuracy over folds.

    Folds are those of fold_col, else by a hash of the rows. Settings are fitted side by side, jobs at a time. The first
    of equals is best.
    """
    g = grid or GRIDS["boost"]
    names = {
        "nrounds": "nrounds", "max_depth": "max_depth", "eta": "eta", "gamma": "gamma", "colsample_bytree": "colsample",
        "min_child_weight": "min_child_weight", "subsample": "subsample",
    }
    settings = [{names[k]: v for k, v in zip(g, row, strict=True)} for row in product(*g.values())]
    fold = fold_col or "fold_"
    dealt = df if fold_col else df.withColumn(fold, F.pmod(F.xxhash64(*[c for c in df.columns if c != features], F.lit(seed)), F.lit(folds)).cast("int"))
    fit = lambda t, setting: BoostedClasses.fit(t, n_classes, features=features, label=label, seed=seed, **setting)
    if len(settings) == 1:
        return fit(df, settings[0]), [(settings[0], float("nan"))]
    with ThreadPoolExecutor(jobs) as pool:
        scores = list(pool.map(lambda s: cross_validate(dealt, lambda t: fit(t, s), label, fold), settings))
    best = max(range(len(settings)), key=lambda k: scores[k])
    return fit(df, settings[best]), list(zip(settings, scores, strict=True))


def cross_validate(df: DataFrame, fit, label: str, fold: str) -> float:
    """The mean accuracy over folds of a column, a model being fitted anew without each."""
    scores = []
    for f in sorted(r[0] for r in df.select(fold).distinct().collect()):  # a handful of folds
        model = fit(df.where(F.col(fold) != f))
        scores.append(model.transform(df.where(F.col(fold) == f)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])
    return float(np.mean(scores))


def cluster_folds(df: DataFrame, features: str = "features", folds: int = 5, seed: int = 42) -> DataFrame:
    """df with fold: groups of rows close in their scaled features, by k-means."""
    from pyspark.ml.clustering import KMeans

    scaled = StandardScaler(inputCol=features, outputCol="scaled_", withMean=True, withStd=True).fit(df).transform(df)
    return KMeans(k=folds, seed=seed, featuresCol="scaled_", predictionCol="fold").fit(scaled).transform(scaled).drop("scaled_")


def importance(model, names: list[str], spark) -> DataFrame:
    """feature, importance: split gains, or absolute coefficients averaged over classes."""
    best = model.bestModel if isinstance(model, CrossValidatorModel) else model
    last = best.stages[-1] if hasattr(best, "stages") else best
    # Boosted classes: the mean over the classes' models.
    if isinstance(last, BoostedClasses):
        values = np.mean([m.featureImportances.toArray() for m in last.models], axis=0)
    elif hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double")


def merge_importance(tables: dict[str, DataFrame]) -> DataFrame:
    """feature, imp_*, norm_* (0 to 100), importance_avg of the models that know the feature, best first."""
    out = None
    for name, t in tables.items():
        t = t.select("feature", F.col("importance").alias(f"imp_{name}"))
        out = t if out is None else out.join(t, ["feature"], "full")
    out = with_minmax100(out, {f"norm_{n}": f"imp_{n}" for n in tables})
    norms = F.filter(F.array(*[F.col(f"norm_{n}") for n in tables]), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(norms, F.lit(0.0), lambda s, v: s + v), F.size(norms).cast("double"))
    return out.withColumn("importance_avg", mean).orderBy(F.col("importance_avg").desc_nulls_last(), "feature")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n for all pairs of levels, met or not; the levels are those of either column."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.select(F.explode(F.array("actual", "predicted")).alias("level")).distinct()
    grid = levels.select(F.col("level").alias("actual"), F.lit(1).alias("j")).join(levels.select(F.col("level").alias("predicted"), F.lit(1).alias("j")), "j").drop("j")
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def by_class(matrix: DataFrame) -> DataFrame:
    """class, f1 (null where nothing was right), n, n_predicted, tp from a confusion table."""
    rows = matrix.select(F.explode(F.array(F.struct(F.col("actual").alias("c"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("t")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("t")))).alias("x"))
    sums = rows.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.a").alias("n"), F.sum("x.p").alias("n_predicted"), F.sum("x.t").alias("tp"))
    return sums.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("n") + F.col("n_predicted"))))


def metrics(matrix: DataFrame) -> DataFrame:
    """accuracy, kappa, mean_f1 (classes without an F1 left out) from a confusion table."""
    sums = by_class(matrix).agg(
        F.sum("tp").alias("tp"), F.sum("n").alias("all"), F.sum(F.col("n").cast("double") * F.col("n_predicted")).alias("chance"),
        F.avg("f1").alias("mean_f1"),
    )
    po, pe = safe_div("tp", "all"), safe_div(F.col("chance"), F.col("all").cast("double") * F.col("all"))
    return sums.select(po.alias("accuracy"), safe_div(po - pe, 1 - pe).alias("kappa"), "mean_f1")


def performance(df: DataFrame, actual: str, predictions: dict[str, str]) -> DataFrame:
    """model, accuracy, kappa, mean_f1 of the predictions (model: column)."""
    tables = [metrics(confusion(df, actual, c)).select(F.lit(m).alias("model"), "*") for m, c in predictions.items()]
    return reduce(DataFrame.unionByName, tables)


def f1_by_model(df: DataFrame, actual: str, predictions: dict[str, str]) -> DataFrame:
    """class, model, f1 of the predictions (model: column)."""
    tables = [
        class_names(
            by_class(confusion(df, actual, c)).select(F.concat(F.lit("Class: "), F.col("class").cast("string")).alias("class"), F.lit(m).alias("model"), "f1"),
            "class",
        ) for m,
        c in predictions.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def accuracy_by_model(df: DataFrame, actual: str, predictions: dict[str, str]) -> DataFrame:
    """class, model, accuracy: the share of a class's rows that each model gets right."""
    wide = df.groupBy(F.col(actual).alias("class")).agg(*[F.avg((F.col(actual) == F.col(c)).cast("double")).alias(m) for m, c in predictions.items()])
    return wide.unpivot(["class"], list(predictions), "model", "accuracy")


def best_model(table: DataFrame) -> DataFrame:
    """The model of the highest accuracy, the first by name of equals."""
    return table.orderBy(F.col("accuracy").desc_nulls_last(), "model").limit(1).select("model", "accuracy")


def agreement_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), (F.col(actual) == F.col(predicted)).alias("correct")).agg(F.count(F.lit(1)).alias("n"))


def class_names(df: DataFrame, column: str) -> DataFrame:
    """Removes the words before a class's name."""
    return df.withColumn(column, F.regexp_replace(column, "^Class: ", ""))

