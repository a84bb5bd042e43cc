"""Choosing, reshaping and profiling columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexlore.functions.nulls import known
from hexlore.sources.tables import checkpointed


def starts_with(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def ends_with(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def matches(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def all_of(df: DataFrame, names: list[str]) -> list[str]:
    """The names, all of which must exist."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return list(names)


def any_of(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def between(df: DataFrame, first: str, last: str) -> list[str]:
    """The columns from first to last, in the table's order."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def pivot_wider(df: DataFrame, ids: list[str], names: str, values: str, levels: list) -> DataFrame:
    """One row per id with a column per level; levels are given, so no extra job looks for them."""
    return df.groupBy(*ids).pivot(names, levels).agg(F.first(values, ignorenulls=True))


def pivot_longer(df: DataFrame, ids: list[str], columns: list[str], names: str = "variable", values: str = "value") -> DataFrame:
    """One row per id and column, nulls kept."""
    return df.unpivot(ids, columns, names, values)


def select_as(df: DataFrame, keep: list[str], *, without: list[str] = (), **renamed: str) -> DataFrame:
    """Columns by name, less those in without, and further ones under new names (new=old)."""
    names = [c for c in all_of(df, keep) if c not in without]
    return df.select(*names, *[F.col(old).alias(new) for new, old in renamed.items()])


def bind_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def null_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns of a type without values, for inputs that are planned."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """variable, pct_missing of each column (NaN is missing), by one aggregate."""
    columns = columns or df.columns
    own = known(df, *columns)
    one = df.agg(*[(100.0 * F.count_if(own[c].isNull()) / F.count(F.lit(1))).alias(c) for c in columns])
    return one.unpivot([], columns, "variable", "pct_missing")


def drop_sparse(df: DataFrame, columns: list[str], limit: float = 50.0) -> tuple[DataFrame, list[str]]:
    """df without those columns of which limit percent or more are missing, and the columns left."""
    left = [r.variable for r in missing_profile(df, columns).where(F.col("pct_missing") < limit).collect()]  # one row per column
    left = [c for c in columns if c in left]
    return df.drop(*[c for c in columns if c not in left]), left


def with_missing_flags(df: DataFrame, columns: list[str], limit: float = 50.0) -> DataFrame:
    """Adds missing_feature_count, missing_feature_pct and sufficient_data of each row."""
    count = sum((v.isNull().cast("int") for v in known(df, *columns).values()), F.lit(0))
    share = count * 100.0 / len(columns)
    return df.withColumns({"missing_feature_count": count, "missing_feature_pct": share, "sufficient_data": share < limit})


def in_order(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with its place (from 0) in an order; ranges of the order are numbered apart, then shifted by what is before them.

    So no task orders the whole table; the numbers of rows by range are as few as there are partitions.
    """
    where = {"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}
    rows = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(where))
    parts = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part_", (F.sum("n").over(Window.orderBy("part_")) - F.col("n")).alias("before_"))
    return rows.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("at_")).drop("part_", "at_", "before_")


def sample_rows(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most n rows, the same ones each time."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
