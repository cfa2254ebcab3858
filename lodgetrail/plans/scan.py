"""A whole scan: landed pages in, new table versions out."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail import dims, schemas
from lodgetrail.functions import clock
from lodgetrail.operators import collect, images as image_ops, merge
from lodgetrail.plans import counters
from lodgetrail.plans.exports import with_change_date
from lodgetrail.plans.paging import ROWS_PER_PART, MapIndex, RankIndex
from lodgetrail.plans.runs import FAN_IN, RunTable, run_id
from lodgetrail.sources import details as detail_pages
from lodgetrail.sources import pages as list_pages


@dataclass(frozen=True)
class Site:
    """Where listings live; the addresses are the caller's."""

    base_url: str
    cdn_url: str
    hosts: tuple[str, ...] = ()


def collect_listings(
    list_landing: DataFrame, site: Site, location_landing: DataFrame | None = None,
    monthly_only: bool = False,
) -> DataFrame:
    """Landed list pages (page_no, url, html) to one raw row per slug."""
    order = ["page_no", "card_no"]

    def read(landing: DataFrame) -> DataFrame:
        """Cards of the embedded JSON, and visible cards of pages without it."""
        landing = landing.withColumnRenamed("url", "page_url")
        cards = list_pages.read_cards(landing, site.base_url, site.cdn_url)
        return cards.unionByName(list_pages.read_html_cards(landing, site.base_url, site.cdn_url))

    cards = read(list_landing)
    main = collect.first_occurrence(cards, ["slug"], order)
    if monthly_only:
        main = main.filter(F.col("has_monthly_contract") == "true")
    if location_landing is None:
        return main
    return collect.precedence_union(main, read(location_landing), order)


def full_batch(raw: DataFrame, detail_landing: DataFrame | None, site: Site) -> DataFrame:
    """Raw rows with their detail columns, in the merged schema, checked row by row."""
    if detail_landing is not None:
        # Reading a page costs far more than moving it: pieces by size, one or two a core, would leave cores idle.
        detail_landing = detail_landing.repartition(3 * detail_landing.sparkSession.sparkContext.defaultParallelism)
        raw = collect.attach_details(raw, detail_pages.read_details(detail_landing, site.cdn_url))
    return merge.invalid_rows(schemas.conform(raw, schemas.FULL_SCHEMA))


@dataclass(frozen=True)
class ScanOutcome:
    scan_id: int
    status: str
    counters: dict
    removals_checked: bool


_LOG_SCHEMA = (
    "scan_id bigint, version bigint, batch_key string, started_at string, status string, seen bigint, "
    "new_count bigint, updated_count bigint, price_changed_count bigint, removed_count bigint, "
    "monthly_count bigint, error_count bigint, removals_checked boolean, error_message string"
)
# Beside the log, an entry holds what its version is made of: runs per table, trusted scans so far, stored and active
# listings, and rows in deltas since the base.
_TABLES = ("state", "images", "history", "counts")

#: Stored beside a listing: its misses minus the trusted scans when it was written. Adding the trusted scans of a later
#: version gives its misses then, so a listing that no scan saw needs no new row until it is removed.
_DUE = "due_key"
_ROW_SCHEMA = T.StructType([*schemas.STATE_SCHEMA.fields, T.StructField(_DUE, T.LongType())])
_DATED_SCHEMA = T.StructType([*schemas.HISTORY_SCHEMA.fields, T.StructField("change_date", T.DateType())])

# Deltas after which a new base is written, however small they are.
_MOST_DELTAS = 24


class TrackingStore:
    """Versioned tables of one tracked site under a root path.

    All tables consist of runs bucketed by slug (``plans/runs.py``). The state is a base run and the deltas since: a scan
    writes the listings it saw or removed, and reads only what is stored of those. When the deltas reach half of the
    listings, the scan writes a new base. Images and history get one run per scan, and eight runs of a size become one.
    Counters are signed differences per scan, folded on reading. A manifest names the runs of each version and is
    written last, so a failed or repeated scan leaves the previous version in force and overwrites its own leftovers.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._state = RunTable(spark, f"{self.root}/state", _ROW_SCHEMA, buckets)
        self._images = RunTable(spark, f"{self.root}/images", schemas.IMAGE_SCHEMA, buckets, order=("position",))
        self._history = RunTable(spark, f"{self.root}/history", _DATED_SCHEMA, buckets, order=("changed_at",))
        self._counts = RunTable(spark, f"{self.root}/counts", T.StructType.fromDDL(counters.TALLY), 1, key="counter", order=("detail",))

    # -- manifests -------------------------------------------------------------
    # One small JSON file per scan attempt. The newest names the version in
    # force; together they are the scan log.

    def _manifest_dir(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _manifest_numbers(self) -> list[int]:
        fs, folder = self._manifest_dir()
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        """One entry; it is a small file, so it is read here and not by a job."""
        fs, folder = self._manifest_dir()
        jvm = self.spark.sparkContext._jvm
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{number:010d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _version(self, version: int | None = None) -> dict:
        """The manifest entry of a version (the one in force)."""
        numbers = self._manifest_numbers()
        empty = {"version": 0, "trusted": 0, "listings": 0, "active": 0, "delta_rows": 0, "runs": {t: [] for t in _TABLES}}
        if not numbers or version == 0:
            return empty
        for number in reversed(numbers):
            entry = self._manifest(number)
            if version is None or (entry["version"] == version and entry["status"] == "completed"):
                return empty | entry
        raise ValueError(f"there is no version {version}")

    def version(self) -> int:
        return self._version()["version"]

    def scan_log(self) -> DataFrame:
        if not self._manifest_numbers():
            return self.spark.createDataFrame([], _LOG_SCHEMA)
        return self.spark.read.schema(_LOG_SCHEMA).json(f"{self.root}/manifests/*.json")

    def _write_manifest(self, entry: dict) -> None:
        """Written under a draft name and renamed: it appears whole or not at all."""
        fs, folder = self._manifest_dir()
        jvm = self.spark.sparkContext._jvm
        numbers = self._manifest_numbers()
        name = f"{(numbers[-1] if numbers else 0) + 1:010d}.json"
        draft = jvm.org.apache.hadoop.fs.Path(folder, f"_{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not fs.rename(draft, jvm.org.apache.hadoop.fs.Path(folder, name)):
            raise RuntimeError(f"scan entry {name} was written by another run")

    # -- tables --------------------------------------------------------------

    def _stored(self, version: dict) -> DataFrame:
        """The newest row of each listing, with its misses as of the version.

        A row gives way to a newer one of its bucket: no shuffle and no sort, the newer slugs are hashed.
        """
        runs = version["runs"]["state"]
        rows = self._state.read(runs)
        if len(runs) > 1:
            newest = self._state.read(runs[1:]).groupBy("slug").agg(F.max("run").alias("_newest")).hint("shuffle_hash")
            rows = rows.alias("r").join(newest.alias("n"), (F.col("r.slug") == F.col("n.slug")) & (F.col("r.run") < F.col("n._newest")), "left_anti")
        misses = F.when(F.col("status") == "active", F.col(_DUE) + version["trusted"]).otherwise(F.col("missing_scan_count"))
        return rows.withColumn("missing_scan_count", misses)

    def state(self, scan_id: int | None = None) -> DataFrame:
        return self._stored(self._version(scan_id)).select(*schemas.STATE_SCHEMA.names)

    def images(self) -> DataFrame:
        return self._images.read(self._version()["runs"]["images"]).drop("run")

    def history(self) -> DataFrame:
        return self._history.read(self._version()["runs"]["history"]).drop("run")

    def tally(self) -> DataFrame:
        """Listings per counter and detail, folded from what each scan changed; no stored listing is read."""
        return counters.folded(self._counts.read(self._version()["runs"]["counts"]))

    def _built(self, path: str) -> bool:
        fs, _ = self._manifest_dir()
        return fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))

    def rank_index(self, name: str, order: list[Column], rows_per_range: int = ROWS_PER_PART) -> RankIndex:
        """The listings of the version in force in one order, made at its first use; ``name`` stands for the order."""
        version = self.version()
        path = f"{self.root}/rank/v={version}/{name}-{rows_per_range}"
        if not self._built(path):
            return RankIndex.build(self.state(version), order, path, rows_per_range)
        return RankIndex(self.spark, path, RankIndex.schema_of(schemas.STATE_SCHEMA), rows_per_range)

    def map_index(self, rows_per_part: int = ROWS_PER_PART) -> MapIndex:
        """The located listings of the version in force by place, made at its first use."""
        version = self.version()
        path = f"{self.root}/maps/v={version}/{rows_per_part}"
        if not self._built(f"{path}/boxes"):
            return MapIndex.build(self.state(version), path, rows_per_part)
        return MapIndex(self.spark, path, MapIndex.schema_of(schemas.STATE_SCHEMA))

    # -- the scan ------------------------------------------------------------

    def apply_scan(
        self, batch: DataFrame, scan_time: str, complete: bool = True, batch_key: str | None = None,
        threshold: int = dims.REMOVED_AFTER_MISSING_SCANS,
        minimum: float = dims.MIN_SCAN_COVERAGE,
    ) -> ScanOutcome | None:
        """Merge one batch; None if ``batch_key`` was merged before.

        A failure is logged with its message and raised again; the tables stay
        at the previous version.
        """
        if batch_key is not None and not self.scan_log().filter(
            (F.col("batch_key") == batch_key) & (F.col("status") == "completed")
        ).isEmpty():
            return None
        before = self._version()
        scan_id = before["version"] + 1
        entry = {"scan_id": scan_id, "batch_key": batch_key, "started_at": scan_time}
        try:
            after, checked = self._write_version(before, scan_id, batch, clock.instant(scan_time), complete, threshold, minimum)
        except Exception as error:
            held = {k: before[k] for k in ("version", "trusted", "listings", "active", "delta_rows", "runs")}
            self._write_manifest({**entry, **held, "status": "failed", "error_message": str(error)[:2000]})
            raise
        self._write_manifest({**entry, "version": scan_id, "status": "completed", "removals_checked": checked, **after})
        self._delete(f"staging/scan={scan_id}")
        names = [f.split()[0] for f in _LOG_SCHEMA.split(", ")]
        return ScanOutcome(scan_id, "completed", {k: v for k, v in after.items() if k in names}, checked)

    def seed(self, state: DataFrame) -> None:
        """Take over listings tracked elsewhere as the first version."""
        if self.version():
            raise ValueError("the store already holds listings")
        self._state.write(run_id(1), _with_due(state, 0))
        stored = self._state.read([run_id(1)])
        self._counts.write(run_id(1), counters.tally(stored))
        known = _totals(counters.folded(self._counts.read([run_id(1)])))
        runs = {"state": [run_id(1)], "images": [], "history": [], "counts": [run_id(1)]}
        self._write_manifest({"scan_id": 1, "version": 1, "status": "completed", "trusted": 0, **known, "delta_rows": 0, "runs": runs})

    def _stage(self, scan_id: int, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/staging/scan={scan_id}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _delete(self, relative: str) -> None:
        fs, _ = self._manifest_dir()
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}"), True)

    def drop_old_versions(self, keep: int = 2) -> None:
        """Delete runs that none of the newest ``keep`` versions is made of; history and images stay readable."""
        newest = self.version()
        if not newest:
            return
        used = [self._version(v)["runs"] for v in range(max(1, newest - keep + 1), newest + 1)]
        fs, _ = self._manifest_dir()
        for table in _TABLES:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            wanted = {r for runs in used for r in runs[table]}
            for f in fs.listStatus(folder) if fs.exists(folder) else ():
                name = f.getPath().getName()
                if name.startswith("run=") and int(name[4:]) not in wanted:
                    self._delete(f"{table}/{name}")
            getattr(self, f"_{table}")._listed.clear()
        for table in ("rank", "maps"):
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            for f in fs.listStatus(folder) if fs.exists(folder) else ():
                if int(f.getPath().getName().removeprefix("v=")) <= newest - keep:
                    self._delete(f"{table}/{f.getPath().getName()}")

    def _touched(self, before: dict, slugs: DataFrame, threshold: int) -> DataFrame:
        """Stored listings a scan may change: those it names, and those one more miss removes."""
        stored = self._stored(before)
        named = stored.join(slugs.hint("shuffle_hash"), "slug", "left_semi")
        due = stored.filter((F.col("status") == "active") & (F.col(_DUE) >= threshold - before["trusted"] - 1))
        return named.unionByName(due.join(slugs.hint("shuffle_hash"), "slug", "left_anti")).select(*schemas.STATE_SCHEMA.names)

    def _write_version(
        self, before: dict, scan_id: int, batch: DataFrame, at: Column, complete: bool, threshold: int, minimum: float,
    ) -> tuple[dict, bool]:
        batch = self._stage(scan_id, "batch", batch)
        slugs = batch.select("slug").distinct()
        known = self._stage(scan_id, "known", self._touched(before, slugs, threshold))
        upserted = self._stage(scan_id, "upserted", merge.upsert(known, batch, at, carry=("images", "thumbnail_url")))
        # Everything the scan decides on and logs, in one pass; whether it is trusted only matters for removals.
        decision = merge.classify(merge.count_missing(upserted, F.lit(True), threshold))
        saw = decision.agg(
            F.count_if("was_seen").alias("seen"), F.count_distinct(F.when(F.col("was_seen"), F.col("slug"))).alias("slugs"),
            F.count_if(F.expr("was_applied AND NOT old_status <=> 'active'")).alias("newly"),
            F.count_if(F.expr("was_applied AND NOT was_known")).alias("fresh"),
            F.count_if(F.expr("was_seen AND (was_known OR was_applied)")).alias("rows"),
            F.struct(*merge.counter_columns()).alias("log")).first()
        if saw.seen != saw.slugs:
            twice = batch.groupBy("slug").count().filter("count > 1").first()
            raise ValueError(f"the batch holds {twice.slug} {twice['count']} times")
        active = before["active"] + saw.newly
        trusted = bool(complete and (active == 0 or saw.seen >= active * minimum))
        logged = saw.log.asDict()
        if not trusted:
            decision = merge.classify(merge.count_missing(upserted, F.lit(False), threshold))
            logged["removed_count"] = 0
        now = before["trusted"] + trusted
        changed = merge.new_state(decision.filter("was_seen OR was_removed"))

        runs = {**before["runs"]}
        listings = before["listings"] + saw.fresh
        pending = before["delta_rows"] + saw.rows + logged["removed_count"] if runs["state"] else listings
        if 2 * pending >= listings or len(runs["state"]) > _MOST_DELTAS:
            gone = decision.filter("was_seen OR was_removed").select("slug").hint("shuffle_hash")
            rest = self._stored(before).select(*schemas.STATE_SCHEMA.names).join(gone, "slug", "left_anti")
            # Who was not seen keeps its due key: this scan, if trusted, is one more miss.
            rows = _with_due(changed, now).unionByName(_with_due(rest, before["trusted"]))
            runs["state"], pending = [run_id(scan_id)], 0
        else:
            rows = _with_due(changed, now)
            runs["state"] = [*runs["state"], run_id(scan_id)]
        applied = upserted.filter("was_applied").select("slug", "images", "thumbnail_url", "was_known")
        shown = self._images.read(runs["images"]).join(slugs.hint("shuffle_hash"), "slug", "left_semi")
        found = image_ops.new_image_rows(applied, shown)
        events = with_change_date(merge.history_rows(decision, at))
        sides = merge.new_state(decision).withColumn("_sign", F.lit(1)).unionByName(known.withColumn("_sign", F.lit(-1)))
        tally = counters.tally(sides, F.col("_sign"))
        # The tables are written at the same time; each job is small beside the cluster.
        with ThreadPoolExecutor(4) as pool:
            state = pool.submit(self._state.write, run_id(scan_id), rows)
            later = {"images": pool.submit(self._images.appended, runs["images"], scan_id, found),
                     "history": pool.submit(self._history.appended, runs["history"], scan_id, events),
                     "counts": pool.submit(self._appended_counts, runs["counts"], scan_id, tally)}
        state.result()
        runs |= {table: done.result() for table, done in later.items()}
        totals = {"listings": listings, "active": active - logged["removed_count"]}
        return {**logged, **totals, "trusted": now, "delta_rows": pending, "runs": runs}, trusted

    def _appended_counts(self, runs: list[int], scan_id: int, rows: DataFrame) -> list[int]:
        """Differences are summed, not only put together, once there are many."""
        if len(runs) < FAN_IN:
            self._counts.write(run_id(scan_id), rows)
            return [*runs, run_id(scan_id)]
        self._counts.write(run_id(scan_id), counters.folded(self._counts.read(runs).drop("run").unionByName(rows)))
        return [run_id(scan_id)]


def _with_due(state: DataFrame, trusted: int) -> DataFrame:
    due = F.when(F.col("status") == "active", F.coalesce("missing_scan_count", F.lit(0)) - trusted)
    return state.withColumn(_DUE, due.cast("bigint"))


def _totals(tally: DataFrame) -> dict:
    """Stored and active listings, of which a version keeps count."""
    n = {r.detail: r.n for r in tally.filter("counter = 'status'").collect()}
    return {"listings": sum(n.values()), "active": n.get("active", 0)}


def run_scan(
    store: TrackingStore, site: Site, list_landing: DataFrame, scan_time: str,
    location_landing: DataFrame | None = None, detail_landing: DataFrame | None = None,
    monthly_only: bool = False, restricted: bool = False, batch_key: str | None = None,
) -> ScanOutcome | None:
    """Extract, collect, attach details, merge. A restricted scan never counts misses."""
    raw = collect_listings(list_landing, site, location_landing, monthly_only)
    return store.apply_scan(
        full_batch(raw, detail_landing, site), scan_time, complete=not (monthly_only or restricted), batch_key=batch_key)
