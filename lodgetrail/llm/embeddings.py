"""Near-duplicate embeddings by PCA-ordered tiles.

Unit vectors are rotated onto their principal axes, so the leading coordinates hold most of a product. Tiles follow the
first axis. Parts of two tiles whose boxes of leading coordinates lie too far apart are left; for the others the product
of the leading coordinates plus the product of the remaining norms bounds every cosine from above; pairs below the
threshold stop there, the others take in the next coordinates, and only what survives is computed in full, in double
precision, on the vectors as given.

The vectors are stored once, in blocks of a few tiles, and each pair of blocks meets by reading that table: nothing is
shuffled for it, so disk grows with the vectors. Memory of a task is bounded by the size of its two parts of the table;
the number of pairs grows with the square of the number of different vectors, as an exact comparison must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail.llm.graph import components
from lodgetrail.session import stage

TILE = 2048
#: Tiles stored and moved as one row, fewer where their vectors are wide.
BLOCK_TILES = 8
_BLOCK_BYTES = 8 << 20
#: Vectors of one stored file.
_FILE_BYTES = 16 << 20
#: Coordinates after which pairs are given up or carried on.
STEPS = (28, 44)
# Rows and columns of a product that stays in the processor's cache.
_ROWS = 512
# Single precision in the bounds errs by far less.
_SLACK = 1e-4
# Stands for a null key while vectors are compared.
_NO_KEY = -(2**63)
#: Linked rows a task holds before it merges them.
_HELD = 1 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for very large and small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Tile:
    """Ids, weights and unit vectors, with what bounds their products."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray, axes: np.ndarray):
        self.ids, self.weights, self.units = ids, weights, units
        self.turned = units @ axes
        self.steps = [s for s in STEPS if s < units.shape[1]]
        self.rests = [np.sqrt((self.turned[:, k:] ** 2).sum(axis=1)) for k in self.steps]
        if self.steps:
            lead = self.turned[:, : self.steps[0]]
            self.bound = np.c_[lead, self.rests[0]].astype(np.float32)
            starts = np.arange(0, len(units), _ROWS)
            self.low, self.high = np.minimum.reduceat(lead, starts), np.maximum.reduceat(lead, starts)


def _near(a: Tile, b: Tile, threshold: float) -> np.ndarray:
    """For each part of ``_ROWS`` vectors of one tile and each of the other: whether their boxes are near enough for a link."""
    gap = np.maximum(np.maximum(a.low[:, None] - b.high[None], b.low[None] - a.high[:, None]), 0)
    return (gap**2).sum(axis=2) <= 2 - 2 * threshold + _SLACK


def _pairs(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of vectors of two tiles whose cosine reaches the threshold."""
    firsts, seconds = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    near = _near(a, b, threshold) if a.steps else None
    space = np.empty((_ROWS, _ROWS), dtype=np.float32)
    for top in range(0, len(a.units), _ROWS):
        for left in range(0, len(b.units), _ROWS):
            rows, columns = slice(top, top + _ROWS), slice(left, left + _ROWS)
            i, few = None, 0
            if a.steps:
                if not near[top // _ROWS, left // _ROWS]:
                    continue
                x, y = a.bound[rows], b.bound[columns]
                bound = np.matmul(x, y.T, out=space if len(x) == len(y) == _ROWS else None)
                at = np.flatnonzero(bound >= threshold - _SLACK)
                if not len(at):
                    continue
                i, j, few = at // len(y) + top, at % len(y) + left, bound.size // 20
                for n, k in enumerate(a.steps[1:], 1):
                    if len(i) <= few:
                        partial = np.einsum("ij,ij->i", a.turned[i, :k], b.turned[j, :k])
                        held = partial + a.rests[n][i] * b.rests[n][j] >= threshold - _SLACK
                        i, j = i[held], j[held]
            if i is None or len(i) > few:  # most survive: the whole part at once is cheaper
                i, j = np.nonzero(a.units[rows] @ b.units[columns].T >= threshold)
                i, j = i + top, j + left
            else:
                held = np.einsum("ij,ij->i", a.units[i], b.units[j]) >= threshold
                i, j = i[held], j[held]
            firsts.append(i)
            seconds.append(j)
    return np.concatenate(firsts), np.concatenate(seconds)


def _linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of unit vectors whose cosine reaches the threshold."""
    one, other = (Tile(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x, axes) for x in (a, b))
    return _pairs(one, other, threshold)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the smallest item reachable by the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare_tiles(one: Tile, other: Tile | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weighted link counts and smallest reachable ids of the vectors of two tiles (or one) that have a link."""
    ids, weights = one.ids, one.weights
    if other is None:
        i, j = _pairs(one, one, threshold)
        i, j = i[i != j], j[i != j]
        counts = np.bincount(i, weights[j], len(ids))
    else:
        ids, weights = np.r_[ids, other.ids], np.r_[weights, other.weights]
        i, j = _pairs(one, other, threshold)
        j = j + len(one.ids)
        counts = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
    if not len(i):
        return ids[:0], weights[:0], ids[:0]
    order = np.argsort(ids, kind="stable")  # roots by id, not by place
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    root = ids[order][_roots(len(ids), place[i], place[j])][place]
    has = counts > 0
    return ids[has], counts[has].astype(np.int64), root[has]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What several comparisons found, a row for each id: its links together, the smallest id reachable by any."""
    ids, links, roots = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(total, at, links)
    return nodes, total, nodes[_roots(len(nodes), at, np.searchsorted(nodes, roots))]


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _blobs(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _given(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and the vectors filled up with zeros."""
    column = batch.column("_vector")
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    there = column.drop_null()
    sizes = there.value_lengths().to_numpy(zero_copy_only=False)
    full = np.zeros((len(at), width))
    full[np.arange(width) < sizes[:, None]] = there.flatten().to_numpy(zero_copy_only=False)
    return at, full


def _digests(rows: np.ndarray) -> list[bytes]:
    """Equal for equal unit vectors."""
    return [hashlib.blake2b(row, digest_size=16).digest() for row in rows + 0.0]


def near_duplicates(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Link all rows whose cosine is at least ``threshold``.

    Returns ``key``, ``n_links`` (other rows linked directly), ``component_id`` (smallest key reachable) and ``kept``
    (the key is the component's). Vectors that are null, empty, zero or hold null, NaN or infinite components link with
    nothing. Shorter vectors count as filled up with zeros. Equal vectors are compared once and counted as often as
    they occur; rows with one key count as rows. An empty table gives an empty table; other columns are not looked at.
    """
    spark = df.sparkSession
    values, endless = F.col("_vector"), F.lit(float("inf"))
    most, least = F.array_max(values), F.array_min(values)
    # Whether an array contains a number is unknown where it holds null.
    fine = F.coalesce((F.size(values) > 0) & ~F.array_contains(values, F.lit(float("nan"))) & (most < endless) & (least > -endless)
                      & ((most != 0) | (least != 0)), F.lit(False))
    rows = df.select(df[key].cast("long").alias("_key"), df[vector].cast("array<double>").alias("_vector"))
    rows = rows.withColumn("_vector", F.when(fine, values))
    width = rows.agg(F.max(F.size("_vector"))).first()[0] or 0
    # Numbers of single precision are kept as such: the double is the same.
    kind = "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    item = np.dtype(kind).itemsize

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, full = _given(batch, width)
            digest = [None] * batch.num_rows
            for i, found in zip(at, _digests(unit(full)) if len(at) else [], strict=True):
                digest[i] = found
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(digest, pa.binary())], ["_key", "_class"])

    read = stage(rows.mapInArrow(classify, "_key long, _class binary"), "classes-of-rows")
    classes = stage(read.where("_class IS NOT NULL").groupBy("_class").agg(F.min("_key").alias("id"), F.count("*").alias("n")), "vector-classes")
    different, usable = classes.agg(F.count("*"), F.sum("n")).first()
    if not different:
        return read.select(F.col("_key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"), F.lit(True).alias("kept"))
    axes = _axes(rows.where("_vector IS NOT NULL"), width)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal vectors of a batch go on as one row, so that a frequent one doesn't fill a task.
        for batch in batches:
            at, full = _given(batch, width)
            if len(at):
                units = unit(full) + 0.0
                named = pa.table({"_class": pa.array(_digests(units), pa.binary()), "id": batch.column("_key").take(pa.array(at)), "row": np.arange(len(at))})
                once = named.group_by("_class", use_threads=False).aggregate([("id", "min"), ("row", "count"), ("row", "min")])
                row = once.column("row_min").to_numpy()
                # Each row is added up on its own: equal vectors get equal sums, and so the same place.
                first = (units[row] * axes[:, 0]).sum(axis=1) + 0.0
                columns = [once.column(c).combine_chunks() for c in ("_class", "id_min", "row_count")]
                yield pa.RecordBatch.from_arrays([*columns, _blobs(full[row].astype(kind)), pa.array(first)], ["_class", "id", "n", "vector", "lead"])

    tile = TILE
    size = tile * max(1, min(BLOCK_TILES, _BLOCK_BYTES // (tile * width * 8)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, vectors, last = [], [], [], None

        def block() -> pa.RecordBatch:
            known = np.array([_NO_KEY if x is None else x for x in ids], dtype="<i8")
            blobs = [known.tobytes(), np.array(weights, dtype="<i8").tobytes(), b"".join(vectors)]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["ids", "weights", "vectors"])

        for batch in batches:
            for found, at, n, given in zip(*(batch.column(c).to_pylist() for c in ("_class", "id", "n", "vector")), strict=True):
                if found == last:
                    ids[-1] = min((x for x in (ids[-1], at) if x is not None), default=None)
                    weights[-1] += n
                    continue
                if len(ids) == size:
                    yield block()
                    ids, weights, vectors = [], [], []
                ids.append(at)
                weights.append(n)
                vectors.append(given)
                last = found
        if ids:
            yield block()

    # Blocks of tiles along the first axis; equal vectors are neighbours. So many files that each core has a part of the pairs;
    # what is sorted at once follows the rows, of which copies go.
    led = rows.where("_vector IS NOT NULL").mapInArrow(lead, "_class binary, id long, n long, vector binary, lead double")
    files = max(-(-different * width * item // _FILE_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-different // tile)))
    parts = max(files, -(-usable * width * item // _FILE_BYTES))
    ordered = led.repartitionByRange(parts, "lead", "_class").sortWithinPartitions("lead", "_class").coalesce(files)
    packed = ordered.mapInArrow(pack, "ids binary, weights binary, vectors binary")
    blocks = stage(packed.withColumn("block", F.monotonically_increasing_id()), "tiles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles(row: dict, side: str) -> list[Tile]:
            ids, weights = (np.frombuffer(row[f"{x}_{side}"], "<i8") for x in ("ids", "weights"))
            units = unit(np.frombuffer(row[f"vectors_{side}"], kind).astype(np.float64).reshape(-1, width))
            return [Tile(ids[k : k + tile], weights[k : k + tile], units[k : k + tile], axes) for k in range(0, len(ids), tile)]

        parts, held, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block_a"] != last:
                    last, ones = row["block_a"], tiles(row, "a")
                if row["block_b"] == last:
                    met = [(x, y) for k, x in enumerate(ones) for y in (None, *ones[k + 1 :])]
                else:
                    met = [(x, y) for y in tiles(row, "b") for x in ones]
                for x, y in met:
                    found = compare_tiles(x, y, threshold)
                    if len(found[0]):
                        parts.append(found)
                        held += len(found[0])
                    if held > _HELD:
                        parts = [_merged(parts)]
                        held = 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)], ["id", "links", "root"])

    # Each part of the table is read beside each other part. Of the two orders of a pair one counts, by turns: all tasks have work.
    one, other = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns)) for side in "ab")
    turn = F.xxhash64("block_a").bitwiseXOR(F.xxhash64("block_b")).bitwiseAND(F.lit(1)) == 0
    met = one.hint("shuffle_replicate_nl").join(other, (F.col("block_a") == F.col("block_b")) | ((F.col("block_a") < F.col("block_b")) == turn))
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(_BLOCK_BYTES)):
        found = stage(met.mapInArrow(compare, "id long, links long, root long"), "tile-links")
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(totals, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    # A vector that comes once and has no link is its own component.
    linked = per_class.where("n > 1 OR links IS NOT NULL")
    known = stage(linked.select("_class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-links")
    out = read.select("_key", "_class").join(known, "_class", "left")
    component = F.coalesce("component_id", "_key")
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("_key") == component).alias("kept"))


def _axes(rows: DataFrame, width: int) -> np.ndarray:
    """Orthonormal principal axes, the leading ones first; a single row has none, any axes serve it."""
    if len(rows.take(2)) < 2:
        return np.eye(width)
    short = F.col("_vector")
    filled = F.concat(short, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(short)))
    # The scale of a vector doesn't matter for its direction; divided by its largest component it stays finite.
    flat = rows.select(filled.alias("v")).withColumn("most", F.array_max(F.transform("v", F.abs))).select(
        array_to_vector(F.zip_with("v", F.array_repeat("most", width), lambda x, m: x / m)).alias("v"))
    found = PCA(k=width, inputCol="v", outputCol="p").fit(flat).pc.toArray()
    if not np.isfinite(found).all():
        return np.eye(width)
    axes, _ = np.linalg.qr(found)
    return axes
