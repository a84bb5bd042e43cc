"""Column factories with the null rules of the analysis: missing poisons, division by zero is missing, NaN is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: str | Column) -> Column:
    return F.when(~F.isnan(col(x)), col(x))


def known(df: DataFrame, *columns: str) -> dict[str, Column]:
    """The columns by name, with NaN read as null where a column can hold it."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    return {c: nan_to_null(c) if c in floating else F.col(c) for c in columns}


def complete(df: DataFrame, columns: list[str]) -> Column:
    """Whether all of the columns have a value (NaN is none)."""
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in known(df, *columns).values()], F.lit(True))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_complete, n_rows, pct_complete (one decimal, halves to even) of a table, as one row."""
    n, rows = F.count_if(complete(df, columns)), F.count(F.lit(1))
    return df.agg(n.alias("n_complete"), rows.alias("n_rows"), F.bround(F.try_divide(n * 100.0, rows), 1).alias("pct_complete"))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b; null if either is null or b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def pct(a: str | Column, b: str | Column) -> Column:
    return safe_div(a, b) * 100


def change(new: str | Column, old: str | Column) -> Column:
    """Percentage change; null unless the old value is there and above zero."""
    return F.when(col(old) > 0, pct(col(new) - col(old), old))


def strict_sum(x: str | Column) -> Column:
    """Sum of a group, null if any value is."""
    return F.when(F.count(col(x)) == F.count(F.lit(1)), F.sum(col(x)))


def strict_mean(*xs: str | Column) -> Column:
    """Mean across columns, null if any is."""
    return reduce(lambda a, b: a + b, map(col, xs)) / len(xs)


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """A null condition gives null, not the second value."""
    return F.when(condition, yes).when(~condition, no)


def is_in(x: str | Column, values: list) -> Column:
    """Membership that is never null."""
    return F.coalesce(col(x).isin(values), F.lit(False))


def clamp(x: str | Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def paste(sep: str, *xs: str | Column) -> Column:
    """Joined text in which a missing value reads NA."""
    return F.concat_ws(sep, *[F.coalesce(col(x).cast("string"), F.lit("NA")) for x in xs])


def row_values(*xs: str | Column) -> Column:
    """The values of a row that are there, as an array of doubles."""
    return F.filter(F.array(*[nan_to_null(col(x).cast("double")) for x in xs]), lambda v: v.isNotNull())


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a).cast("double"))


def array_sd(a: Column) -> Column:
    """Sample standard deviation from squared deviations, null for fewer than two values."""
    # An array of one element binds the mean once for all values.
    squares = F.get(F.transform(F.array(array_mean(a)), lambda m: F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))), F.lit(0))
    return F.when(F.size(a) > 1, F.sqrt(squares / (F.size(a) - 1)))


def rate_of_change(a: Column, time_diff: float = 1.0) -> Column:
    """(last - first) / (steps * first) in percent per step of a series; null for fewer than two values."""
    return F.when(F.size(a) >= 2, pct(F.element_at(a, -1) - F.element_at(a, 1), F.element_at(a, 1) * time_diff))


def acceleration(a: Column) -> Column:
    """Mean second difference; null for fewer than three values."""
    second = F.transform(F.sequence(F.lit(2), F.greatest(F.size(a) - 1, F.lit(2))), lambda i: F.get(a, i) - 2 * F.get(a, i - 1) + F.get(a, i - 2))
    return F.when(F.size(a) >= 3, array_mean(second))


def volatility(a: Column, least: int = 2, positive: bool = False) -> Column:
    """Standard deviation over mean; null for too few values, a mean of zero, and with positive for one below zero."""
    mean = array_mean(a)
    return F.when((F.size(a) >= least) & ((mean > 0) if positive else (mean != 0)), F.try_divide(array_sd(a), mean))


def with_minmax100(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns scaled to 0-100 over the whole table: one aggregate row, broadcast, no window without a key.

    NaN counts as missing: it moves no end of the scale and its own scaled value is null.
    """
    own = known(df, *columns.values())
    ends = [f(own[c]).alias(f"{f.__name__}_{new}") for new, c in columns.items() for f in (F.min, F.max)]
    one = F.broadcast(df.agg(*ends))
    scaled = {new: pct(own[c] - F.col(f"min_{new}"), F.col(f"max_{new}") - F.col(f"min_{new}")) for new, c in columns.items()}
    return df.join(one).withColumns(scaled).drop(*[f"{e}_{new}" for new in columns for e in ("min", "max")])


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean (m_) and the sample standard deviation (s_) of each column, NaN left out."""
    return df.agg(*[f(v).alias(f"{n}_{c}") for c, v in known(df, *columns).items() for n, f in (("m", F.avg), ("s", F.stddev_samp))])


def scaled_by(df: DataFrame, stats: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns centred and divided as the stats (of any table) say; a constant column gives null."""
    own = known(df, *columns.values())
    out = df.join(F.broadcast(stats)).withColumns({new: safe_div(own[c] - F.col(f"m_{c}"), F.col(f"s_{c}")) for new, c in columns.items()})
    return out.drop(*stats.columns)


def with_zscores(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns centred and divided by the sample standard deviation; a constant column and NaN give null."""
    return scaled_by(df, column_stats(df, list(dict.fromkeys(columns.values()))), columns)


def with_ecdf(df: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
    """Adds the share of non-null values not above a row's own, exactly, from counts of distinct values.

    All columns go through one pass as (feature, value) rows, missing ones left out, and come back by the key (one row
    each). Counts are summed per range of sorted values first, so no window orders all rows in one task.
    """
    own = known(df, *columns.values())
    values = F.array(*[F.struct(F.lit(new).alias("feature"), own[c].cast("double").alias("v")) for new, c in columns.items()])
    flat = df.select(F.col(key).alias("key_"), F.explode(F.filter(values, lambda x: x["v"].isNotNull())).alias("x")).select("key_", "x.feature", "x.v")
    shares = running_share(flat.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")))
    found = flat.join(shares, ["feature", "v"]).groupBy("key_").agg(*[F.max(F.when(F.col("feature") == new, F.col("share"))).alias(new) for new in columns])
    return df.join(found, F.col(key) == F.col("key_"), "left").drop("key_")


def in_parts(seen: DataFrame, by: list[str], parts: int) -> DataFrame:
    """seen (by, v, n: distinct values of groups with counts) with part, a range of values, and before, the rows in lower ranges.

    Ranges are cut at approximate quantiles of each group; totals of ranges are few, so no task orders a whole group.
    Cuts are written once: their approximation differs between two computations, while totals and rows must agree.
    """
    from hexlore.sources.tables import checkpointed

    cuts = seen.groupBy(*by).agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 10_000).alias("cuts"), F.sum("n").alias("all"))
    dealt = seen.join(checkpointed(cuts), by).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    totals = dealt.groupBy(*by, "part").agg(F.sum("n").alias("own"))
    before = totals.select(*by, "part", (F.sum("own").over(Window.partitionBy(*by).orderBy("part")) - F.col("own")).alias("before"))
    return dealt.join(before, [*by, "part"])


def running_share(seen: DataFrame, parts: int = 64) -> DataFrame:
    """feature, v, share from (feature, v, n): the running share of n in order of v."""
    upto = F.sum("n").over(Window.partitionBy("feature", "part").orderBy("v"))
    return in_parts(seen, ["feature"], parts).select("feature", "v", ((F.col("before") + upto) / F.col("all")).alias("share"))


def quantiles(df: DataFrame, by: list[str], columns: list[str], at: dict[str, float], parts: int = 64) -> DataFrame:
    """One row per group (in all, without by): <name>_<column> for each quantile, exact, interpolated, missing values left out.

    From counts of distinct values in ranges; a group that holds most rows is in no task as a whole.
    """
    own = known(df, *columns)
    values = F.array(*[F.struct(F.lit(c).alias("feature"), own[c].cast("double").alias("v")) for c in columns])
    flat = df.select(*by, F.explode(F.filter(values, lambda x: x["v"].isNotNull())).alias("x")).select(*by, "x.feature", "x.v")
    # A null group would be lost in joins by equality.
    named = [F.struct(*[F.col(c) for c in by]).alias("by_")] if by else [F.lit(0).alias("by_")]
    seen = flat.select(*named, "feature", "v").groupBy(F.to_json(F.struct("by_")).alias("group_"), "by_", "feature", "v").agg(F.count(F.lit(1)).alias("n")).drop("by_")
    placed = in_parts(seen, ["group_", "feature"], parts).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("group_", "feature", "part").orderBy("v")))
    low, high = (lambda q: F.floor((F.col("all") - 1) * q)), (lambda q: F.ceil((F.col("all") - 1) * q))
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)

    def value(c: str, q: float) -> Column:
        mine = F.col("feature") == c
        a, b = (F.max(F.when(mine & holds(f(q)), F.col("v"))) for f in (low, high))
        rank = (F.max(F.when(mine, F.col("all"))) - 1) * q
        return a + (b - a) * (rank - F.floor(rank))

    told = placed.groupBy("group_").agg(*[value(c, q).alias(f"{name}_{c}") for name, q in at.items() for c in columns])
    if not by:
        return told.drop("group_")
    groups = df.select(*by).distinct().withColumn("group_", F.to_json(F.struct(F.struct(*[F.col(c) for c in by]).alias("by_"))))
    return groups.join(told, "group_", "left").drop("group_")
