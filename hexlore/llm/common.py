"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlore.sources.tables import checkpointed, free_shuffles  # noqa: F401

#: The white space that separates words, as a regex class body and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text (maximal runs outside SPACE_CHARS); null and blank texts give an empty array."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{SPACE_CLASS}]+"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df once to the shared checkpoint folder and reads it from there, so that a lost executor costs nothing."""
    return checkpointed(df)


#: Keys that join_hot joins by a broadcast, at most.
MOST_HOT = 100_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """rows (materialised) left-joined with facts (one row a key, size being the rows of the key), however they are spread.

    Keys that hold more than one row in MOST_HOT, fewer than MOST_HOT of them by that, meet their rows by a broadcast,
    so none gathers its rows in one task; the others are joined by a shuffle, and rows without a key by neither.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    least = max(1000, total // MOST_HOT)
    hot, rest = F.broadcast(facts.where(F.col(size) > least)), facts.where(F.col(size) <= least)
    known = rows.where(F.col(key).isNotNull())
    if facts.where(F.col(size) > least).isEmpty():
        out = known.join(rest, key, "left")
    else:
        out = known.join(hot, key).unionByName(known.join(hot.select(key), key, "left_anti").join(rest, key, "left"))
    bare = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != key])
    return out.unionByName(bare).drop(size)
