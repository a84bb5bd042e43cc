"""Reading and writing tables: Parquet stages, CSV with an audit of bad rows, checkpoints."""

from __future__ import annotations

import gc
import logging
import tempfile
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic import dataframe as classic

log = logging.getLogger("hexlore")

#: Documented inputs, by name.
SCHEMAS = {
    "demolitions": "demo_id long, latitude double, longitude double, demo_date date, building_type string",
    "rent_cells": "hex_id long, date date, median_rent double",
    "rent_points": "property_id long, latitude double, longitude double, date date, rent double",
    "evictions": "eviction_id long, latitude double, longitude double, filing_date date, case_type string, outcome string",
    "land_values": "parcel_id long, latitude double, longitude double, assessment_date date, land_value double, improvement_value double",
    "ownership": "property_id long, latitude double, longitude double, owner_name string, owner_type string, acquisition_date date, units int",
    "statistics": "unit_id string, variable string, estimate double",
    "roads": "road_id string, RTTYP string, line array<struct<x:double,y:double>>",
    "rent_history": "Period string, `Building Address` string, `Building Name` string, `Zip Code` string, `Asking Rent Per Unit` double",
}
#: The variables of the statistics.
STATISTICS = [
    "median_income", "total_pop", "white_nh", "black_nh", "asian_nh", "hispanic", "total_tenure", "owner_occupied", "renter_occupied",
    "total_edu", "less_than_hs", "hs_grad", "some_college", "bachelors", "graduate", "total_poverty_det", "below_poverty", "median_rent", "median_home_value",
]
BAD = "_bad_row"


def load(spark: SparkSession, path: str, description: str = "") -> DataFrame:
    """A stage table; a missing one is an error that names it."""
    try:
        out = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no stage table {description or path} at {path}") from e
    log.info("read %s", description or path)
    return out


def geojson_features(lines: DataFrame, properties: str, column: str = "value") -> DataFrame:
    """The properties and the ring (outer, not closed, x and y) of each polygon in rows of GeoJSON text.

    A row holds a Feature or a FeatureCollection; a MultiPolygon gives a row per part. Holes and other geometries are
    left out, as are rows that are no GeoJSON.
    """
    polygon, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    feature = f"struct<type:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    whole = F.from_json(F.col(column), f"features array<{feature}>")["features"]
    lone = F.from_json(F.col(column), f"type string, properties struct<{properties}>, geometry struct<type:string,coordinates:string>")
    every = lines.select(F.explode(F.coalesce(whole, F.array(lone))).alias("f")).where("f.geometry is not null")
    text = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(text, polygon))).when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(text, many))
    rows = every.select("f.properties.*", F.explode(parts).alias("part"))
    outer = F.col("part")[0]
    ring = F.transform(F.slice(outer, 1, F.size(outer) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.withColumn("ring", ring).drop("part")


def read_statistics(spark: SparkSession, path: str, variables: list[str] = STATISTICS) -> DataFrame:
    """unit_id, variable, estimate and, where there is one, ring, in long form from Parquet; the variables asked for alone."""
    rows = load(spark, path, "statistics")
    kept = ["unit_id", "variable", F.col("estimate").cast("double").alias("estimate"), *["ring"] * ("ring" in rows.columns)]
    return rows.select(*kept).where(F.col("variable").isin(variables))


def read_roads(spark: SparkSession, path: str, classes: tuple[str, ...] = ("I", "S")) -> DataFrame:
    """The roads of some classes from Parquet."""
    return load(spark, path, "roads").where(F.col("RTTYP").isin(*classes))


def read_rent_history(spark: SparkSession, path: str) -> DataFrame:
    """building_address, building_name, zip, period (a date, null if it can't be read), rent from the CSV of asking rents."""
    from hexlore.operators.events import parse_quarter

    rows = read_csv(spark, path, SCHEMAS["rent_history"])
    return rows.select(
        F.col("Building Address").alias("building_address"), F.col("Building Name").alias("building_name"), F.col("Zip Code").alias("zip"),
        parse_quarter(F.col("Period")).alias("period"), F.col("Asking Rent Per Unit").alias("rent"),
    )


def save(df: DataFrame, path: str, description: str = "") -> None:
    df.write.mode("overwrite").parquet(path)
    log.info("wrote %s", description or path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, keep_bad: bool = False) -> DataFrame:
    """Rows of a CSV with a header that fit the schema; with keep_bad all rows, the text of the others in _bad_row.

    Values are read as text and cast, so that a row is judged by all its columns, whichever the query asks for: the
    reader's own audit sees only the columns that are left after pruning.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField(BAD, T.StringType())])
    rows = spark.read.csv(path, schema=text, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=False)
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    unfit = reduce(lambda x, y: x | y, [F.col(c).isNotNull() & v.isNull() for c, v in cast.items()])
    line = F.coalesce(F.col(BAD), F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in fields]))
    bad = F.when(F.col(BAD).isNotNull() | unfit, line)
    if keep_bad:
        return rows.select(*[v.alias(c) for c, v in cast.items()], bad.alias(BAD))
    return rows.where(bad.isNull()).select(*[v.alias(c) for c, v in cast.items()])


def bad_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that read_csv drops: their texts in _bad_row beside what could be parsed."""
    return read_csv(spark, path, schema, keep_bad=True).where(F.col(BAD).isNotNull())


def write_csv(df: DataFrame, path: str, geometry: tuple[str, ...] = ("ring", "geometry")) -> None:
    """A CSV folder with a header; geometry columns are left out."""
    df.drop(*geometry).write.mode("overwrite").csv(path, header=True)


def or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """What read() gives, or an empty table of the schema if the source can't be reached."""
    try:
        return read()
    except (OSError, AnalysisException) as e:
        log.warning("source not available, going on without: %s", e)
        return spark.createDataFrame([], schema)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a local session without the setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="ckpt-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage and its size estimates cut.

    checkpoint() alone keeps the size estimates of its plan, and estimates of joins, being products, get millions of
    digits over rounds of joins.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    done = df.checkpoint()
    return classic.DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, which it does once their plans are collected garbage.

    For jobs of many steps, whose disk would else hold the shuffles of all of them till the end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
