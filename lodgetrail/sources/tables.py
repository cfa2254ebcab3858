"""Stored tables and coordinate caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_TYPE = "map<string,struct<lat:double,lon:double>>"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table; filters and column choices made later reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table, where a driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def cache_points(document: Column) -> Column:
    """A JSON object of key -> point, as a map."""
    return F.from_json(document, CACHE_TYPE)


def read_point_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON cache file to rows (place_key, lat, lon).

    The file format is one object, so a single file is one task; larger caches
    are kept as the parquet rows this returns.
    """
    files = spark.read.text(path, wholetext=True)
    return explode_points(files, F.col("value"))


def explode_points(df: DataFrame, document: Column) -> DataFrame:
    points = df.select(F.explode(cache_points(document)).alias("place_key", "point"))
    return points.select("place_key", "point.lat", "point.lon")
