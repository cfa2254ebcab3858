"""What the operators share: word rules, input columns, batch helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same rule for Spark's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
#: Documents in one Arrow batch; whole texts cross over, so batches are kept small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def smallest(df: DataFrame, by: Column, ties: list[str], k: int) -> DataFrame:
    """The ``k`` rows with the smallest ``by``, a 64-bit hash, then ``ties``.

    Only rows whose hash is below the share ``k`` of all rows, and a margin, are sorted: a task passes on about its part of
    the ``k``, not ``k`` rows. Where equal hashes make that share hold too few, it is doubled.
    """
    n, share = df.count(), 1.0
    named = df.withColumn("_by", by)
    if n > k:
        share = 1.1 * k / n + 1000 / n
        while share < 1 and named.where(F.col("_by") < int((share - 0.5) * 2**64)).limit(k).count() < k:
            share *= 2
    if share < 1:
        named = named.where(F.col("_by") < int((share - 0.5) * 2**64))
    return named.orderBy("_by", *ties).limit(k).drop("_by")


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null and empty texts."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda w: w != "")


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty string."""
    return [t or "" for t in batch.column(name).to_pylist()]


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself if it is visible, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def runs(values: list[str], size: int) -> Iterator[slice]:
    """Slices of ``values`` with about ``size`` characters each, one item at least."""
    start, held = 0, 0
    for i, v in enumerate(values):
        held += len(v)
        if held >= size:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(values):
        yield slice(start, len(values))


# --- word hashes -----------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13 | 3
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text hashed at once.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a one-to-one map)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_slice(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one behind the other, and where each text's words end."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    first[edges] = ~space[edges]
    last[edges - 1] = ~space[edges - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last)
    size = 1 << max(10, int(len(data) - 1).bit_length())
    sums = np.cumsum(_CODES[data] * _powers(_BASE, size)[: len(data)], dtype=np.uint64)
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    hashes = (sums[stop] - before) * _powers(_INVERSE, size)[start]
    return mix(hashes + (stop - start + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(start, ends)


def hashed_words(column: pa.Array, fold: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each text of a string column without nulls; ``fold`` lower-cases A-Z first.

    Works on the column's bytes, about ``SLICE_BYTES`` at a time; no Python string is made.
    """
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, blob = column.buffers()
    offsets = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(blob, dtype=np.uint8) if blob is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        hashes, stops = _hash_slice(_FOLD[part] if fold else part, offsets[row + 1 : end + 1] - offsets[row])
        at = 0
        for stop in stops:
            yield hashes[at:stop]
            at = stop
        row = end


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n] * _CODES[0]
    for k in range(1, size):
        out = out + words[k : k + n] * _CODES[k]
    return mix(out)
