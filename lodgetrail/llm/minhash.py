"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation gives two signature values, the smallest and the largest hash of the set, so ``PERMUTATIONS`` hash
evaluations make twice as many values. Bands of ``ROWS`` values put sets into buckets: with 24 bands of 4 a pair at the
threshold of 0.85 shares no bucket with probability 2e-8.

No bucket is expanded into its pairs. Equal sets collapse to one class first. In every bucket the members are
compared with its smallest member (a star), and links found make components. Only members of a bucket that are then
still in different components may hold undiscovered links; they are found exactly by a prefix-filtered join of their
full sets, rarest shingles first, between components only. The order of shingles is taken from a bounded sample; any
order gives the same links, a good one gives fewer candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodgetrail.llm.common import grams, hashed_words, mix, small_batches
from lodgetrail.llm.graph import components
from lodgetrail.session import new_work_dir, stage

SHINGLE = 5
PERMUTATIONS = 48
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a star that are compared in one group; larger stars are dealt to several.
STAR = 64
#: Documents and shingles from which the order of shingles is made.
ORDER_DOCUMENTS, ORDER_SHINGLES = 4096, 1 << 18

_FACTORS = np.random.default_rng(5).integers(1, 2**63, (2, PERMUTATIONS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 14


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; shorter texts are one shingle, texts without words none."""
    if 0 < len(words) < SHINGLE:
        return mix(grams(words, len(words)) + np.uint64(len(words)))
    return np.unique(grams(words, SHINGLE))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The bucket of a non-empty set in every band."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(found), _CHUNK):
        permuted = found[at : at + _CHUNK][None, :] * _FACTORS[0][:, None] + _FACTORS[1][:, None]
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    values = mix(np.stack([low, high], axis=1).reshape(BANDS, ROWS))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTORS[0][0]
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r])
    return keys.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """``doc``, ``n``, ``same`` (hash of the whole set, null for empty ones) and ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, keys = [], [], []
            for words in hashed_words(batch.column("text"), fold=True):
                found = shingle_set(words)
                n.append(len(found))
                same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(band_keys(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "n", "same", "keys"])

    return docs.mapInArrow(run, "doc long, n long, same binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc`` and ``shingles`` (the set as bytes) of the wanted documents, bucketed by ``doc``.

    The one place where texts are shuffled. The same join is asked for at every size; later joins on ``doc`` read the
    buckets as they are.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [shingle_set(words).tobytes() for words in hashed_words(batch.column("text"), fold=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(blobs, pa.binary())], ["doc", "shingles"])

    rows = docs.join(wanted.hint("merge"), "doc").select("doc", "text").mapInArrow(run, "doc long, shingles binary")
    path = new_work_dir(spark, "sets")
    name = f"shingle_{path.rpartition('/')[2].replace('-', '_')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").bucketBy(buckets, "doc").option("path", path).saveAsTable(name)
    return spark.table(name)


def _with_sets(sets: DataFrame, wanted: DataFrame, fields: str, emit: Callable[[dict, np.ndarray], list[tuple]]) -> DataFrame:
    """Rows that ``emit`` makes from the rows of ``wanted`` (one per ``doc``) and their shingle sets."""
    extra = [c for c in wanted.columns if c != "doc"]
    kinds = to_arrow_schema(sets.sparkSession.createDataFrame([], fields).schema)

    def record(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.types)], kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, blob in zip(batch.select(["doc", *extra]).to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                out += emit(row, np.frombuffer(blob, dtype=np.uint64))
                while len(out) >= 4000:
                    yield record(out[:4000])
                    out = out[4000:]
            if out:
                yield record(out)

    return sets.join(wanted, "doc").select("doc", "shingles", *extra).mapInArrow(run, fields)


def _confirm(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (``hub``, ``doc``) with 100 * intersection >= threshold * union of their full sets.

    The members of a hub are dealt to groups of about ``STAR``; the hub's set goes to each, one joined row per group. A group
    is read in order, hub first, so a task holds one hub's set and one batch.
    """
    degree = stage(pairs.groupBy("hub").count(), "star-size")
    dealt = stage(pairs.join(degree, "hub").select("hub", "doc", F.pmod(F.xxhash64("doc"), F.ceil(F.col("count") / STAR)).cast("int").alias("salt")), "stars")
    hubs = dealt.select(F.col("hub").alias("doc"), "hub", "salt").distinct()
    roles = dealt.select("doc", "hub", "salt", F.lit(1).alias("role")).unionByName(hubs.withColumn("role", F.lit(0)))
    rows = sets.select("doc", "shingles").join(roles, "doc").select("hub", "salt", "role", "doc", "shingles")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for g, s, role, doc, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found = np.frombuffer(blob, dtype=np.uint64)
                if role == 0:
                    hub, own = (g, s), found
                elif hub == (g, s):
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * both >= threshold * (len(own) + len(found) - both):
                        a.append(doc)
                        b.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stage(rows.mapInArrow(compare, "a long, b long"), "confirmed")


def _shingle_order(sets: DataFrame, rest: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a bounded sample of ``rest``, sorted, and how often they occur in it."""
    some = rest.select("doc").orderBy(F.xxhash64("doc"), "doc").limit(ORDER_DOCUMENTS)
    each = _with_sets(sets, F.broadcast(some), "shingle long", lambda _, found: [(x,) for x in found.view(np.int64).tolist()])
    often = each.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES).collect()
    known = np.array(sorted((r[0], r[1]) for r in often), dtype=np.int64).reshape(-1, 2)
    return known[:, 0].copy(), known[:, 1].copy()


def _between_components(sets: DataFrame, rest: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs (``hub``, ``doc``) of ``rest`` (``doc``, ``component``) in different components.

    Prefix filter: with the shingles of all sets in one order, two sets at the threshold share one among the first
    n - ceil(t * n) + 1 of each, and what can still follow the shared places bounds their intersection.
    """
    known, count = _shingle_order(sets, rest)

    def emit(row: dict, found: np.ndarray) -> list[tuple]:
        signed = found.view(np.int64)
        at = np.minimum(np.searchsorted(known, signed), max(len(known) - 1, 0))
        seen = np.where(known[at] == signed, count[at], 0) if len(known) else np.zeros(len(signed), dtype=np.int64)
        n = len(signed)
        prefix = signed[np.lexsort((signed, seen))][: n - (-(-threshold * n // 100)) + 1]
        return [(row["doc"], row["component"], n, k, int(x)) for k, x in enumerate(prefix)]

    prefixes = stage(_with_sets(sets, rest, "doc long, component long, n long, place long, shingle long", emit), "prefixes")
    left = prefixes.select(F.col("doc").alias("hub"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("place").alias("p"), "shingle")
    right = prefixes.select("doc", "component", "n", "place", "shingle")
    overlap = F.least(F.col("m") - F.col("p"), F.col("n") - F.col("place"))
    fits = (F.col("hub") < F.col("doc")) & (F.col("c") != F.col("component")) & (100 * F.least("m", "n") >= threshold * F.greatest("m", "n")) & (
        (100 + threshold) * overlap >= threshold * (F.col("m") + F.col("n")))
    met = left.join(right, (left["shingle"] == right["shingle"]) & fits)
    return met.select("hub", "doc").distinct()


def near_duplicates(df: DataFrame, threshold: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Link rows whose sets of 5-word shingles have a similarity of at least ``threshold`` percent.

    Words are runs of other characters than ASCII white space, with A-Z lower-cased. Returns ``key``, ``n_shingles``,
    ``component_id`` (the smallest key reachable by links) and ``kept`` (the key is the component's). Texts without
    words, null texts too, have an empty set and link with nothing; shorter texts are one shingle. Equal sets, repeated
    rows too, are linked. ``key`` must be a whole number. An empty table gives an empty table; other columns are not
    looked at.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(df[key].cast("long").alias("doc"), F.coalesce(df[text], F.lit("")).alias("text"))
    sketches = stage(_sketches(docs), "sketches")
    classes = stage(sketches.where("same IS NOT NULL").groupBy("same").agg(
        F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys")), "set-classes")
    bands = classes.select("doc", "n", F.explode("keys").alias("bucket"))
    full = stage(bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc").alias("hub")).where("size > 1"), "buckets")
    members = stage(bands.join(full, "bucket").select("bucket", "size", "hub", "doc", "n"), "bucket-members")
    hub_sizes = members.where("doc = hub").select("hub", F.col("n").alias("m")).distinct()
    stars = members.where("doc <> hub").select("hub", "doc", "n").distinct().join(stage(hub_sizes, "hub-sizes"), "hub")
    near = stars.where(100 * F.least("n", "m") >= threshold * F.greatest("n", "m")).select("hub", "doc")
    sets = _sets(docs, members.select("doc").distinct())
    links = _confirm(sets, near, threshold)
    joined = stage(components(links), "star-components")
    # Members other than the hub, in buckets where they are of several components.
    others = members.where("size > 2 AND doc <> hub").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    others = stage(others, "bucket-components")
    torn = stage(others.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"), "torn-buckets")
    rest = stage(others.join(torn, "bucket").select("doc", "component").distinct(), "undecided")
    if rest.take(1):
        more = _confirm(sets, stage(_between_components(sets, rest, threshold), "candidates"), threshold)
        # The stars stand for the links they were made of.
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    known = classes.select("same", "doc").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("same", F.coalesce("component", "doc").alias("component"))
    out = sketches.select("doc", "n", "same").join(stage(known, "set-components"), "same", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc") == component).alias("kept"))
