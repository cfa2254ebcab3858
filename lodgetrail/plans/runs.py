"""Tables made of immutable runs, bucketed by one key."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Runs of one level that are merged into one of the next.
FAN_IN = 8
# Runs are numbered by the version that wrote them and their level.
_LEVELS = 100
_CREATING = Lock()


def run_id(version: int, level: int = 0) -> int:
    return version * _LEVELS + level


def level_of(run: int) -> int:
    return run % _LEVELS


class RunTable:
    """Rows under ``path``, one folder per run, each with the same buckets.

    All runs are read as one bucketed table, so rows of a key meet without a
    shuffle however many runs hold them, and a lookup by key opens one
    bucket of each run. Which runs count is the caller's to say; folders of runs
    nobody names are leftovers and are overwritten when their number comes up.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int, key: str = "slug", order: Sequence[str] = ()) -> None:
        self.spark, self.path, self.schema, self.buckets, self.key, self.order = spark, path, schema, buckets, key, tuple(order)
        self.name = f"lodgetrail_runs_{md5(path.encode()).hexdigest()[:16]}"
        self._listed: set[int] = set()

    def write(self, run: int, rows: DataFrame) -> None:
        """Write a run; its rows are shuffled once, into the buckets."""
        draft = f"{self.name}_{run}"
        self.spark.sql(f"DROP TABLE IF EXISTS {draft}")
        placed = rows.select(*self.schema.names).repartition(self.buckets, self.key)
        placed.write.mode("overwrite").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key, *self.order).option(
            "path", f"{self.path}/run={run}").saveAsTable(draft)
        self.spark.sql(f"DROP TABLE {draft}")  # the files stay
        self._listed.discard(run)

    def read(self, runs: Sequence[int]) -> DataFrame:
        """Rows of the runs, with the number of their ``run``."""
        if not runs:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("run", T.LongType())]))
        with _CREATING:
            if not self.spark.catalog.tableExists(self.name):
                self._create()
        if set(runs) - self._listed:
            self.spark.catalog.refreshTable(self.name)
            self._listed |= set(runs)
        return self.spark.table(self.name).filter(F.col("run").isin(*runs))

    def _create(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        # Partitions are found by listing the folder, not kept in a catalog.
        kept = self.spark.conf.get("spark.sql.hive.manageFilesourcePartitions")
        self.spark.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")
        try:
            self.spark.sql(
                f"CREATE TABLE {self.name} ({columns}, run BIGINT) USING parquet PARTITIONED BY (run) "
                f"CLUSTERED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        finally:
            self.spark.conf.set("spark.sql.hive.manageFilesourcePartitions", kept)

    def appended(self, runs: Sequence[int], version: int, rows: DataFrame) -> list[int]:
        """The runs after ``rows`` were added as one more.

        Where a level is full, its runs become one run of the next level first: each row is
        rewritten once per level, and a lookup opens at most ``FAN_IN`` runs per level.
        """
        runs = list(runs)
        level = 0
        while len(full := [r for r in runs if level_of(r) == level]) >= FAN_IN:
            merged = run_id(version, level + 1)
            # Read as plain files: rows that lie in buckets already would not be dealt again, and a bucket would get many files.
            self.write(merged, self.spark.read.schema(self.schema).parquet(*(f"{self.path}/run={r}" for r in full)))
            runs = [r for r in runs if r not in full] + [merged]
            level += 1
        self.write(run_id(version), rows)
        return [*runs, run_id(version)]
