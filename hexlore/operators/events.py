"""Point events and quarterly series brought onto cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexlore.functions.nulls import pct, quantiles
from hexlore.operators.geo import latest
from hexlore.operators.shape import in_order


def parse_quarter(text: Column) -> Column:
    """The first day of "2022 Q4" or "2022 Q4 QTD"; null for other texts."""
    parts = F.regexp_extract(F.regexp_replace(text, " QTD", ""), r"^(\d{4}) Q([1-4])$", 1)
    quarter = F.regexp_extract(F.regexp_replace(text, " QTD", ""), r"^(\d{4}) Q([1-4])$", 2)
    return F.when(parts != "", F.make_date(parts.try_cast("int"), (quarter.try_cast("int") - 1) * 3 + 1, F.lit(1)))


def quarter_start(ts: str | Column) -> Column:
    return F.trunc((F.col(ts) if isinstance(ts, str) else ts).cast("date"), "quarter")


def counts_by_year(cells: DataFrame, events: DataFrame, key: str, year: str, years: list[int], prefix: str = "count") -> DataFrame:
    """Cells with <prefix>_total and <prefix>_<year>; cells without events have zeros."""
    counts = events.groupBy(key).agg(F.count(year).alias(f"{prefix}_total"), *[F.count_if(F.col(year) == y).alias(f"{prefix}_{y}") for y in years])
    out = cells.join(counts, key, "left")
    return out.fillna(0, subset=[c for c in out.columns if c.startswith(f"{prefix}_")])


def series(rows: DataFrame, by: list[str], period: str, value: str, unit: str, by_ranges: bool = False) -> DataFrame:
    """Median value and number of distinct units of each group and period.

    Spark's median merges the distinct values of a group, with counts, in one task. by_ranges gives the same medians
    from ranges of values, several times slower on small groups, for tables in which one group may hold most rows.
    """
    if not by_ranges:
        return rows.groupBy(*by, period).agg(F.median(value).alias("median_value"), F.count_distinct(unit).alias("n_units"))
    # A row per group, period and unit is counted, so that a large group is spread over its units first.
    units = rows.select(*by, period, unit).distinct().groupBy(*by, period).agg(F.count(unit).alias("n_units"))
    medians = quantiles(rows, [*by, period], [value], {"median": 0.5}).withColumnRenamed(f"median_{value}", "median_value")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_u")) for c in [*by, period]]
    units = units.withColumnsRenamed({c: f"{c}_u" for c in [*by, period]})
    return medians.join(units, same).select(*by, period, "median_value", "n_units")


def with_changes(df: DataFrame, by: list[str], period: str, value: str, lags: dict[str, int]) -> DataFrame:
    """Adds percentage changes against the row so many places before, in order of period (null periods last)."""
    w = Window.partitionBy(*by).orderBy(F.col(period).asc_nulls_last())
    return df.withColumns({name: pct(F.col(value) - F.lag(value, n).over(w), F.lag(value, n).over(w)) for name, n in lags.items()})


def with_calendar_change(df: DataFrame, by: list[str], period: str, value: str, months: int, name: str) -> DataFrame:
    """Adds the percentage change against the row of exactly so many months before, whatever rows are missing."""
    old = df.select(*by, F.add_months(period, months).alias(period), F.col(value).alias("old_"))
    return df.join(old, [*by, period], "left").withColumn(name, pct(F.col(value) - F.col("old_"), "old_")).drop("old_")


def snapshot(df: DataFrame, by: list[str], period: str) -> DataFrame:
    return latest(df, by, period)


def geocode(places: DataFrame, key: str, *gazetteers: DataFrame) -> DataFrame:
    """Adds x and y from the first gazetteer (key, x, y) that knows the place; null if none does."""
    out = places
    for k, g in enumerate(gazetteers):
        out = out.join(g.select(key, F.col("x").alias(f"x{k}_"), F.col("y").alias(f"y{k}_")), key, "left")
    pick = lambda a: F.coalesce(*[F.col(f"{a}{k}_") for k in range(len(gazetteers))])
    return out.withColumns({"x": pick("x"), "y": pick("y")}).drop(*[f"{a}{k}_" for a in "xy" for k in range(len(gazetteers))])


def dense_ids(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds a dense number per group of columns, in their order (nulls last); numbered on the distinct groups, then joined back."""
    groups = df.select(*[F.col(c).alias(f"{c}_g") for c in columns]).distinct()
    ids = in_order(groups, [F.col(c).asc_nulls_last() for c in groups.columns], name).withColumn(name, (F.col(name) + 1).cast("int"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_g")) for c in columns]
    return df.join(ids, on, "left").drop(*groups.columns)
