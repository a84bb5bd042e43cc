"""From class probabilities to risk scores of 0 to 100, their categories, factors and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlore.functions.nulls import clamp, complete, quantiles, with_ecdf, with_minmax100

#: The categories in order of score.
CATEGORIES = ("Low", "Moderate", "High", "Very High")


def cluster_risk(profile: DataFrame, parts: dict[str, float]) -> DataFrame:
    """profile with risk: the weighted sum of its columns, each scaled to 0 to 100 over the clusters."""
    scaled = with_minmax100(profile, {f"n_{c}": c for c in parts})
    terms = [F.col(f"n_{c}") * w for c, w in parts.items()]
    return scaled.withColumn("risk", sum(terms[1:], terms[0])).drop(*[f"n_{c}" for c in parts])


def risk_of_class(df: DataFrame, predicted: str, risks: DataFrame, out: str) -> DataFrame:
    """df with the risk of its predicted cluster (risks: cluster, risk), null where there is none."""
    return df.join(risks.select(F.col("cluster").alias(predicted), F.col("risk").alias(out)), predicted, "left")


def expected_risk(probabilities: Column, risks: Column) -> Column:
    """The sum of probabilities times risks, both arrays in the order of classes."""
    return F.aggregate(F.zip_with(probabilities, risks, lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)


def ensemble(df: DataFrame, weights: DataFrame, scores: dict[str, str], fallback: tuple[str, str, str], out: str = "risk_score") -> DataFrame:
    """df with the weighted mean of scores, weights being shares of accuracy (one row, columns named as the models).

    fallback (model, a, b): where the model's score is missing, the plain mean of scores a and b. Clamped to 0-100.
    """
    total = sum((F.col(m) for m in list(scores)[1:]), F.col(next(iter(scores))))
    shares = F.broadcast(weights.select(*[(F.col(m) / total).alias(f"w_{m}") for m in scores]))
    terms = [F.col(s) * F.col(f"w_{m}") for m, s in scores.items()]
    mixed = F.when(F.col(scores[fallback[0]]).isNull(), (F.col(scores[fallback[1]]) + F.col(scores[fallback[2]])) / 2).otherwise(sum(terms[1:], terms[0]))
    return df.join(shares).withColumn(out, clamp(mixed)).drop(*[f"w_{m}" for m in scores])


def categorise(score: Column, edges: tuple[float, float, float] = (25.0, 50.0, 75.0)) -> Column:
    """The category of a score; an edge belongs to the category below it."""
    return F.when(score <= edges[0], CATEGORIES[0]).when(score <= edges[1], CATEGORIES[1]).when(score <= edges[2], CATEGORIES[2]).when(score > edges[2], CATEGORIES[3])


def factors(df: DataFrame, key: str, features: list[str], top_n: int = 3, percentile: float = 0.75) -> DataFrame:
    """df with contributing_factors: the first top_n features (in order of importance) whose value stands high."""
    ranked = with_ecdf(df, {f"e_{c}": c for c in features}, key)
    high = F.filter(F.array(*[F.when(F.col(f"e_{c}") >= percentile, F.lit(c)) for c in features]), lambda x: x.isNotNull())
    told = F.when(F.size(high) > 0, F.array_join(F.slice(high, 1, top_n), "; ")).otherwise("Multiple factors")
    return ranked.withColumn("contributing_factors", told).drop(*[f"e_{c}" for c in features])


def complete_only(scored: DataFrame, predictors: list[str], columns: list[str]) -> DataFrame:
    """scored with null in columns wherever a predictor is missing: the linear model knows nothing of such rows."""
    whole = complete(scored, predictors)
    return scored.withColumns({c: F.when(whole, F.col(c)) for c in columns})


def category_counts(df: DataFrame, category: str) -> DataFrame:
    """category, n, pct (one decimal, halves to even)."""
    counts = df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("category", "n", F.bround(F.col("n") * 100.0 / F.col("all"), 1).alias("pct"))


def with_quantiles(df: DataFrame, column: str, at: dict[str, float], *more: Column) -> DataFrame:
    """One row: the aggregates in more beside quantiles of a column by name; none of them holds the column in one task."""
    found = quantiles(df, [], [column], at).withColumnsRenamed({f"{name}_{column}": name for name in at})
    return df.agg(*more).join(F.broadcast(found.agg(*[F.max(name).alias(name) for name in at])))


def summary(df: DataFrame, score: str) -> DataFrame:
    """metric, value: Mean, Median, SD, Min, Max."""
    one = with_quantiles(df, score, {"Median": 0.5}, F.avg(score).alias("Mean"), F.stddev_samp(score).alias("SD"), F.min(score).alias("Min"), F.max(score).alias("Max"))
    return one.unpivot([], ["Mean", "Median", "SD", "Min", "Max"], "metric", "value")


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    one = with_quantiles(df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"))
    return one.select("min", "q1", "median", "mean", "q3", "max")


def top(df: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), key).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin (1 to bins), n: equal widths over the range; the largest value is in the last bin."""
    ends = F.broadcast(df.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_")))
    place = F.least(F.lit(bins), F.floor(F.try_divide((F.col(column) - F.col("lo_")) * bins, F.col("hi_") - F.col("lo_"))) + 1)
    return df.where(F.col(column).isNotNull()).join(ends).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dashboard(df: DataFrame, score: str, category: str) -> DataFrame:
    high = F.col(category).isin(*CATEGORIES[2:])
    return with_quantiles(
        df, score, {"median_score": 0.5}, F.count(F.lit(1)).alias("n_cells"), F.avg(score).alias("mean_score"), F.count_if(high).alias("n_high"),
        (F.count_if(high) * 100.0 / F.count(F.lit(1))).alias("pct_high"),
    )


def popup(title: Column, score: Column, category: Column, why: Column) -> Column:
    """The text of a map popup; missing values read NA."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("NA"))
    return F.concat(
        F.lit("<b>Cell "), text(title), F.lit("</b><br>Score: "), F.coalesce(F.format_number(F.bround(score, 1), 1), F.lit("NA")),
        F.lit("<br>Risk: "), text(category), F.lit("<br>"), F.regexp_replace(text(why), "; ", "<br>"),
    )
