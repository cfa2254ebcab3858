"""Deep pages and map boxes over stored orders: only the parts that hold the answer are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail.operators.filters import in_viewport, located
from lodgetrail.operators.ordered import placed

# Rows of a range or a map part: what one page reads at least.
ROWS_PER_PART = 100_000


class RankIndex:
    """A result stored in its order, cut into ranges of equal size; each row knows its ``place``, from 1.

    A page without a condition lies in one range or two. With a condition, the rows that meet it are counted per range
    (reading the condition's columns only), and the ranges that hold the page are read. Nothing is sorted and no
    task sees offset + limit rows. Continuing after a place reads from its range on.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, rows_per_range: int) -> None:
        self.path, self.rows_per_range = path, rows_per_range
        self._rows = spark.read.schema(schema).parquet(path)

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[Column], path: str, rows_per_range: int = ROWS_PER_PART) -> RankIndex:
        """Sort once over ranges and store; ``order`` must be total. Columns named ``place`` and ``part`` are replaced."""
        rows = placed(df.drop("place", "part"), *order)
        # One file per range, sorted by place, so that its row groups can be skipped as well.
        cut = rows.withColumn("part", F.floor((F.col("place") - 1) / rows_per_range).cast("bigint"))
        cut.repartition("part").sortWithinPartitions("part", "place").write.mode("overwrite").partitionBy("part").parquet(path)
        return cls(df.sparkSession, path, cut.schema, rows_per_range)

    @staticmethod
    def schema_of(rows: T.StructType) -> T.StructType:
        """What is stored of rows with this schema."""
        return T.StructType([*rows.fields, T.StructField("place", T.LongType()), T.StructField("part", T.LongType())])

    def page(self, limit: int, offset: int = 0, condition: Column | None = None) -> DataFrame:
        """Rows ``offset`` + 1 to ``offset`` + ``limit`` of those that meet the condition, with their ``place`` in the whole order."""
        if limit < 1 or offset < 0:
            raise ValueError("a page has at least one row and no negative offset")
        if condition is None:
            first, last = offset // self.rows_per_range, (offset + limit - 1) // self.rows_per_range
            rows = self._rows.filter(F.col("part").between(first, last))
            return rows.filter(F.col("place").between(offset + 1, offset + limit)).drop("part").orderBy("place")
        counts = self._rows.filter(condition).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        until = F.sum("n").over(Window.orderBy("part"))
        wanted = counts.withColumn("until", until).filter((F.col("until") > offset) & (F.col("until") - F.col("n") < offset + limit))
        parts = wanted.agg(F.min("part").alias("first"), F.max("part").alias("last"), F.min(F.col("until") - F.col("n")).alias("before")).first()
        if parts.first is None:
            return self._rows.filter(F.lit(False)).drop("part")
        rows = self._rows.filter(F.col("part").between(parts["first"], parts["last"])).filter(condition)
        return rows.orderBy("place").offset(offset - parts.before).limit(limit).drop("part")

    def page_after(self, place: int, limit: int, condition: Column | None = None) -> DataFrame:
        """The next ``limit`` rows after ``place`` that meet the condition.

        Ranges are read in growing runs until enough rows are found, so a page costs what lies between its ends. A row keeps
        its place while this index is in use, so no row is lost or seen twice between pages.
        """
        last = self._rows.agg(F.max("part")).first()[0]
        first = place // self.rows_per_range
        reach = 0 if condition is None else 1
        while True:
            rows = self._rows.filter(F.col("part").between(first, first + reach)).filter(F.col("place") > place)
            found = (rows if condition is None else rows.filter(condition)).orderBy("place").limit(limit)
            if last is None or first + reach >= last or found.count() == limit:
                return found.drop("part")
            reach = 2 * reach + 1


# Bits of a coordinate in a map cell: about 600 m.
_CELL_BITS = 16


def morton(lat: Column, lon: Column) -> Column:
    """Interleaved bits of both coordinates: points near each other mostly get near numbers."""
    def spread(value: Column, low: float, high: float) -> Column:
        x = F.least(F.greatest(F.floor((value - low) / (high - low) * 2**_CELL_BITS), F.lit(0)), F.lit(2**_CELL_BITS - 1)).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return x
    return spread(lat, -90.0, 90.0).bitwiseOR(F.shiftleft(spread(lon, -180.0, 180.0), 1))


class MapIndex:
    """Located rows in Morton order, cut into parts of about equal size whose bounding boxes are kept beside them.

    A box reads the parts it meets, so a busy city has many small parts and the sea none. Rows without finite
    coordinates are on no map and are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self._rows = spark.read.schema(schema).parquet(f"{path}/rows")
        self._boxes = spark.read.parquet(f"{path}/boxes")

    @classmethod
    def build(cls, df: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> MapIndex:
        """Sort once over ranges and store. Columns named ``part`` are replaced."""
        shown = df.drop("part").filter(located()).withColumn("_cell", morton(F.col("latitude"), F.col("longitude")))
        ranked = placed(shown, F.col("_cell"))
        rows = ranked.withColumn("part", F.floor((F.col("place") - 1) / rows_per_part).cast("bigint")).drop("place", "_cell")
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
        boxes = stored.groupBy("part").agg(
            F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))
        boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")  # a row per part
        return cls(df.sparkSession, path, rows.schema)

    @staticmethod
    def schema_of(rows: T.StructType) -> T.StructType:
        """What is stored of rows with this schema."""
        return T.StructType([*rows.fields, T.StructField("part", T.LongType())])

    def parts(self, south: float, north: float, west: float, east: float) -> list[int]:
        """Parts whose bounding boxes meet the box."""
        met = self._boxes.filter(
            (F.col("south") <= north) & (F.col("north") >= south) & (F.col("west") <= east) & (F.col("east") >= west))
        return sorted(r.part for r in met.select("part").collect())

    def viewport(self, south: float, north: float, west: float, east: float) -> DataFrame:
        """The located rows inside the box, edges included."""
        found = self.parts(south, north, west, east)
        rows = self._rows.filter(F.col("part").isin(found) if found else F.lit(False))
        return rows.filter(in_viewport(south, north, west, east)).drop("part")
