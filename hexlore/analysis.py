"""The whole analysis, from raw tables to risk scores: grid, statistics, events, rents, features, clusters, models, scores.

Each stage takes the tables that it needs and gives one; Analysis runs them in order and keeps what they give in the
shared checkpoint folder. Raw tables:

* outline: ring (longitude x, latitude y) of the city
* tracts: tract, ring, variable, estimate in long form
* events: lon, lat, year of each demolition
* rents: lon, lat, building, period (first day of a quarter), rent
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexlore.config import Config
from hexlore.functions.nulls import column_stats, scaled_by
from hexlore.operators import cluster, events, features, geo, models, score, shape
from hexlore.sources.tables import checkpointed

#: Shares of the statistics as features.
SHARES = {
    "pct_white": (["white_nh"], "total_pop"),
    "pct_black": (["black_nh"], "total_pop"),
    "pct_asian": (["asian_nh"], "total_pop"),
    "pct_hispanic": (["hispanic"], "total_pop"),
    "pct_renter": (["renter_occupied"], "total_tenure"),
    "pct_college": (["bachelors", "graduate"], "total_edu"),
    "poverty_rate": (["below_poverty"], "total_poverty_det"),
}
MODELS = ("elastic", "forest", "boost")


@dataclass(frozen=True)
class Raw:
    outline: DataFrame
    tracts: DataFrame
    events: DataFrame
    rents: DataFrame
    origin: tuple[float, float]
    variables: list[str]
    years: list[int]
    quarters: list[str]
    picks: dict[str, str]
    demo_years: tuple[int, int, int]


def grid(outline: DataFrame, origin: tuple[float, float], edge: float) -> DataFrame:
    """hex_id, cell_id, q, r, x, y (metres), longitude, latitude, area_km2 of the cells whose centre is in the outline."""
    cells = geo.lattice(outline.select(geo.project_ring(F.col("ring"), *origin).alias("ring")), "ring", edge).select("q", "r").distinct()
    x, y = geo.centre(F.col("q"), F.col("r"), edge)
    lon, lat = geo.unproject(F.col("x"), F.col("y"), *origin)
    area = geo.ring_area(geo.ring(F.col("q"), F.col("r"), edge)) / 1e6
    cells = cells.withColumns({"cell_id": geo.cell_id(F.col("q"), F.col("r")), "x": x, "y": y}).withColumns({"longitude": lon, "latitude": lat, "area_km2": area})
    return events.dense_ids(cells, ["cell_id"], "hex_id")


def located(rows: DataFrame, origin: tuple[float, float], edge: float) -> DataFrame:
    """rows (lon, lat) with the cell that they are in; rows without coordinates have none."""
    x, y = geo.project(F.col("lon"), F.col("lat"), *origin)
    q, r = geo.cell_of(x, y, edge)
    return rows.withColumn("cell_id", geo.cell_id(q, r))


def cell_statistics(cells: DataFrame, tracts: DataFrame, origin: tuple[float, float], edge: float, variables: list[str]) -> DataFrame:
    """cell_id and each variable: sums of the tracts' estimates, weighted by the share of the tract that the cell holds."""
    shapes = tracts.select("tract", "ring").dropDuplicates(["tract"]).select("tract", geo.project_ring(F.col("ring"), *origin).alias("outline"))
    rings = cells.select("cell_id", geo.ring(F.col("q"), F.col("r"), edge).alias("hexagon"))
    parts = geo.polygon_overlay(shapes, rings, "outline", "hexagon", 8 * edge)
    parts = parts.select("cell_id", "tract", (F.col("shared") / geo.ring_area(F.col("outline"))).alias("weight"))
    shared = parts.join(tracts.select("tract", "variable", "estimate"), "tract")
    long = geo.interpolate(shared, ["cell_id"], "variable", "estimate", "weight")
    return shape.pivot_wider(long, ["cell_id"], "variable", "estimate", variables)


def cell_features(cells: DataFrame, statistics: DataFrame, counts: DataFrame, rents: DataFrame, raw: Raw, config: Config) -> DataFrame:
    """The wide feature table, a row for every cell; what a cell has no data for is null, its counts are 0."""
    base, one, two = (f"demo_count_{y}" for y in raw.demo_years)
    out = cells.join(statistics, "cell_id", "left").join(counts.drop("q", "r"), "cell_id", "left").join(rents, "cell_id", "left")
    out = features.shares(out, SHARES).withColumn("pct_poc", F.try_divide(F.col("total_pop") - F.col("white_nh"), F.col("total_pop")) * 100)
    out = features.rent_features(out, **raw.picks, values=[f"rent_{q}" for q in raw.quarters], median="median_rent")
    out = features.demo_features(out, "demo_count_total", base, one, two, F.col("area_km2"))
    out = features.vulnerability(out, "median_income", "pct_renter", "poverty_rate", "pct_college", "median_rent")
    out = features.neighbourhood(checkpointed(out), "cell_id", features.LAGGED, config.neighbours)
    out = features.interactions(out)
    return shape.with_missing_flags(out, list(dict.fromkeys([*cluster.INDICATORS, *models.PREDICTORS])), config.missing_limit)


def clustered(cells: DataFrame, config: Config) -> tuple[DataFrame, list[tuple[int, float, float]], cluster.Fit]:
    """cell_id, cluster (from 1) of cells with all indicators; cost and silhouette by k; the fit of the k chosen."""
    rows, names = cluster.inputs(cells, "cell_id", cluster.INDICATORS, config.missing_limit)
    scaled = scaled_by(rows, column_stats(rows, names), {f"z_{c}": c for c in names})
    # A constant indicator has no scale and tells nothing apart.
    matrix = scaled.select("cell_id", F.array(*[F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c in names]).alias("v"))
    matrix = checkpointed(models.with_vector(matrix, "v", "features"))
    n = matrix.count()
    ks = range(config.k_range[0], min(config.k_range[1], n - 1) + 1)
    sweep = cluster.sweep_kmeans(matrix, "cell_id", "features", ks, config.restarts, config.most_iterations, config.seed)
    k = min(cluster.choose_k({k: s for k, _, s in sweep}, config.least_k), max(n - 1, 1))
    fit = cluster.best_kmeans(matrix, "features", k, config.final_restarts, config.most_iterations, config.seed)
    return checkpointed(fit.model.transform(matrix).select("cell_id", "v", (F.col("cluster") + 1).alias("cluster"))), sweep, fit


def fitted(train: DataFrame, n_classes: int, config: Config, predictors: list[str] = models.PREDICTORS) -> dict[str, object]:
    """The three tuned models by name, from rows with label (0 to n_classes - 1) and predictors."""
    df = models.assembled(train, predictors).persist()
    try:
        out = {
            "elastic": models.elastic_net(folds=config.folds, grid=config.grids.get("elastic"), seed=config.seed).fit(df),
            "forest": models.forest(trees=config.trees, folds=config.folds, grid=config.grids.get("forest"), depth=config.depth, seed=config.seed).fit(df),
            "boost": models.tuned_boost(df, n_classes, folds=config.folds, grid=config.grids.get("boost"), seed=config.seed)[0],
        }
    finally:
        df.unpersist()
    return out


def predictions(cells: DataFrame, fits: dict[str, object], risks: DataFrame, predictors: list[str] = models.PREDICTORS) -> DataFrame:
    """cells with cluster_<model> (from 1) and risk_<model>, the risk to expect by class probabilities.

    The linear model tells nothing of cells that miss a predictor; the trees see a missing one as NaN.
    """
    out = models.assembled(cells, predictors)
    kept = [*cells.columns, "features"]
    ordered = F.broadcast(risks.agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "risk"))), lambda s: s["risk"]).alias("risks_")))
    out = out.join(ordered)
    for name, fit in fits.items():
        rows = out if name != "elastic" else out.withColumn("features", F.when(models.complete(out, predictors), F.col("features")).otherwise(models.zeros(len(predictors))))
        told = fit.transform(rows)
        probability = F.col("probability") if dict(told.dtypes)["probability"].startswith("array") else vector_to_array("probability")
        told = told.withColumns({f"cluster_{name}": (F.col("prediction") + 1).cast("int"), f"risk_{name}": score.expected_risk(probability, F.col("risks_"))})
        kept += [f"cluster_{name}", f"risk_{name}"]
        out = told.select(*kept, "risks_")
    return score.complete_only(out, predictors, ["cluster_elastic", "risk_elastic"]).drop("features", "risks_")


class Analysis:
    """One run over raw tables; stages are made when asked for and kept."""

    def __init__(self, spark: SparkSession, raw: Raw, config: Config) -> None:
        self.spark, self.raw, self.config = spark, raw, config

    @cached_property
    def grid(self) -> DataFrame:
        return checkpointed(grid(self.raw.outline, self.raw.origin, self.config.cell_edge))

    @cached_property
    def features(self) -> DataFrame:
        raw, edge = self.raw, self.config.cell_edge
        statistics = cell_statistics(self.grid, raw.tracts, raw.origin, edge, raw.variables)
        counts = events.counts_by_year(self.grid.select("cell_id"), located(raw.events, raw.origin, edge), "cell_id", "year", raw.years, "demo_count")
        series = events.series(located(raw.rents, raw.origin, edge), ["cell_id"], "period", "rent", "building")
        named = series.select("cell_id", "median_value", F.concat(F.lit("rent_"), F.year("period").cast("string"), F.lit("_q"), F.quarter("period").cast("string")).alias("q"))
        rents = shape.pivot_wider(named, ["cell_id"], "q", "median_value", [f"rent_{q}" for q in raw.quarters])
        return checkpointed(cell_features(self.grid, statistics, counts, rents, raw, self.config))

    @cached_property
    def clusters(self) -> tuple[DataFrame, list[tuple[int, float, float]], cluster.Fit]:
        return clustered(self.features, self.config)

    @cached_property
    def profiles(self) -> DataFrame:
        known = self.features.join(self.clusters[0].select("cell_id", "cluster"), "cell_id")
        return checkpointed(cluster.profiles(known, "cluster", ["rent_change_total", "demo_density", "vulnerability_index"]))

    @cached_property
    def modelled(self) -> tuple[dict[str, object], DataFrame, DataFrame]:
        """The models, the table of their merits on held-out rows, and those rows with predictions."""
        k = self.clusters[2].k
        known = self.features.join(self.clusters[0].select("cell_id", "cluster"), "cell_id", "left")
        rows = models.model_rows(models.outcomes(known, "cluster", k), "cell_id").withColumn("label", (F.col("cluster_class") - 1).cast("double"))
        rows = checkpointed(models.stratified_split(rows, "cell_id", "label", self.config.train_share, self.config.seed))
        fits = fitted(rows.where("in_train"), k, self.config)
        told = checkpointed(predictions(rows.where("not in_train"), fits, self.risks).select("cell_id", "cluster_class", *[f"cluster_{m}" for m in MODELS]))
        return fits, checkpointed(models.performance(told, "cluster_class", {m: f"cluster_{m}" for m in MODELS})), told

    @cached_property
    def risks(self) -> DataFrame:
        return checkpointed(score.cluster_risk(self.profiles, self.config.risk_weights).select("cluster", "risk"))

    def importance(self) -> DataFrame:
        return models.merge_importance({m: models.importance(fit, models.PREDICTORS, self.spark) for m, fit in self.modelled[0].items()})

    @cached_property
    def scores(self) -> DataFrame:
        """A row per cell: scores, category, cluster, factors; cells of the grid without a score keep their row."""
        fits, merits, _ = self.modelled
        told = predictions(self.features, fits, self.risks)
        # Three rows, one per model.
        weights = merits.agg(*[F.max(F.when(F.col("model") == m, F.col("accuracy"))).alias(m) for m in MODELS])
        out = score.ensemble(told, weights, {m: f"risk_{m}" for m in MODELS}, MODELS)
        out = out.withColumn("risk_category", score.categorise(F.col("risk_score"), self.config.category_edges))
        top = [r.feature for r in self.importance().limit(self.config.factor_features).collect()]  # names of a few features
        out = score.factors(out, "cell_id", top, self.config.factors, self.config.factor_percentile)
        kept = shape.select_as(
            out, ["hex_id", "cell_id", "risk_score", "risk_category", "contributing_factors"], predicted_cluster="cluster_forest",
            risk_score_rf="risk_forest", risk_score_xgb="risk_boost", risk_score_elastic="risk_elastic",
        )
        clamped = {c: score.clamp(c) for c in ("risk_score_rf", "risk_score_xgb")}
        return checkpointed(joined_to_grid(self.grid, kept.withColumns(clamped)))


def joined_to_grid(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """The cells with their scores by both keys; a cell without a score keeps its row."""
    return cells.join(scores, ["hex_id", "cell_id"], "left")


def spatial_folds(cells: DataFrame, block: float, folds: int = 5, seed: int = 42) -> DataFrame:
    """cells (x, y) with fold, that of the square block that they are in."""
    return cells.withColumn("fold", geo.fold_of_block(F.col("x"), F.col("y"), block, folds, seed))


def latest_by_cell(cells: DataFrame, series: DataFrame, period: str) -> DataFrame:
    """Every cell with the rows of its last period, all ties; cells without any keep one row."""
    w = Window.partitionBy("cell_id").orderBy(F.col(period).desc_nulls_last())
    return cells.join(series, "cell_id", "left").withColumn("rank_", F.rank().over(w)).where("rank_ = 1").drop("rank_")
