"""The feature formulas of the wide cell table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlore.functions.nulls import change, if_else, pct, row_values, safe_div, strict_mean, volatility, with_minmax100
from hexlore.operators.geo import knn_lag


def shares(df: DataFrame, parts: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Adds percentages: the sum of some columns over another."""
    return df.withColumns({name: pct(sum((F.col(c) for c in own[1:]), F.col(own[0])), whole) for name, (own, whole) in parts.items()})


def rent_features(df: DataFrame, first: str, mid: str, later: str, recent: str, last: str, values: list[str], median: str) -> DataFrame:
    """Total and recent change, acceleration, volatility, level.

    first to mid and later to last are the early and the late stretch, each a quarter of its difference per step;
    recent is the base of the recent change.
    """
    early, late = (F.col(mid) - F.col(first)) / 4, (F.col(last) - F.col(later)) / 4
    known = F.col(first).isNotNull() & F.col(mid).isNotNull() & F.col(later).isNotNull() & F.col(last).isNotNull()
    return df.withColumns({
        "rent_change_total": change(last, first),
        "rent_change_recent": change(last, recent),
        "rent_acceleration": F.when(known & (early > 0), pct(late - early, early)),
        "rent_volatility": volatility(row_values(*values), 3, positive=True),
        "rent_current": F.col(last),
        "rent_level_ratio": F.when(F.col(median) > 0, safe_div(last, median)),
    })


def demo_features(df: DataFrame, total: str, base: str, one: str, two: str, area: Column) -> DataFrame:
    """Density, recent count, trend against the base year, flag."""
    recent = F.col(one) + F.col(two)
    return df.withColumns({
        "demo_density": safe_div(total, area),
        "demo_recent": recent,
        "demo_trend": F.when(F.col(base) > 0, safe_div(recent / 2 - F.col(base), base)),
        "has_recent_demos": if_else(recent > 0, F.lit(1), F.lit(0)),
    })


def vulnerability(df: DataFrame, income: str, renters: str, poverty: str, college: str, rent: str) -> DataFrame:
    """Burden, four scaled components and their plain mean (null if any is).

    Where the table has pct_poc, pct_poc_vulnerable repeats it under the name by which it is read as a component.
    """
    signed = df.withColumns({"neg_income_": -F.col(income), "neg_college_": -F.col(college), "rent_burden_proxy": F.when(F.col(income) > 0, safe_div(F.col(rent) * 12, income))})
    out = with_minmax100(signed, {"vuln_low_income": "neg_income_", "vuln_high_rent": renters, "vuln_poverty": poverty, "vuln_low_edu": "neg_college_"})
    out = out.withColumn("vulnerability_index", strict_mean("vuln_low_income", "vuln_high_rent", "vuln_poverty", "vuln_low_edu")).drop("neg_income_", "neg_college_")
    return out.withColumn("pct_poc_vulnerable", F.col("pct_poc")) if "pct_poc" in df.columns else out


#: The columns whose neighbourhood means are features.
LAGGED = ["rent_change_total", "demo_density", "median_income", "vulnerability_index"]


def neighbourhood(df: DataFrame, key: str, columns: list[str] = LAGGED, k: int = 6, policy: str = "mean") -> DataFrame:
    """Adds <column>_lag of cells with centres (x, y): means over the k nearest others, one search for all columns."""
    return knn_lag(df, key, columns, k, policy=policy)


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "rent_vuln_interaction": F.col("rent_change_total") * F.col("vulnerability_index"),
        "demo_rent_interaction": F.col("demo_density") * F.col("rent_level_ratio"),
        "income_burden_interaction": F.col("vuln_low_income") * F.col("rent_burden_proxy"),
        "neighborhood_rent_pressure": (F.col("rent_change_total") + F.col("rent_change_total_lag")) / 2,
    })


def category(name: Column) -> Column:
    """The group of a feature by its name; the first rule that fits counts."""
    lag = name.endswith("_lag")
    return (
        F.when(name.startswith("rent_") & ~lag, "Temporal Rent")
        .when(name.startswith("demo_") & ~lag, "Demolitions")
        .when(name.startswith("vuln_") | (name == "vulnerability_index"), "Vulnerability")
        .when(lag, "Spatial Lag")
        .when(name.endswith("_interaction"), "Interactions")
        .otherwise("Other")
    )
