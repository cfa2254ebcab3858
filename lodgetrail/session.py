"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that shape plans. Cluster sizing (executors, memory, partition
# counts) stays with whoever submits the job.
PLAN_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs the next step a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sessions merge inside each task before they are shuffled by client.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "lodgetrail", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**PLAN_SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a session somebody else created.

    Local-day and ISO-date rules are defined on UTC instants, so the session
    zone is the one setting results depend on.
    """
    for name, value in PLAN_SETTINGS.items():
        spark.conf.set(name, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which import it by name."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodgetrail-py-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def work_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is made and recorded if all work runs in this process
    (unit tests); executors elsewhere could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodgetrail-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is not created here."""
    return f"{work_root(spark)}/lodgetrail/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where one result feeds several writes: the lineage is cut on durable
    storage, so losing executors costs only the tasks they were running.
    """
    spark = df.sparkSession
    path = new_work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
