"""Packing tokenised documents into sequences of fixed capacity by exact complements.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` rows at any scale. Sums of one, two
and three available lengths are indexed; combinations that fill the gap beside a piece exactly are consumed as often as
their counts allow, and what is left is packed best-fit. A plan entry says: so many pieces of this length, from this
rank on, go to consecutive sequences at this offset. Pieces are ranked within their length without bringing the pieces
of a length together: by part of the input, then by place in the part.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail.llm.common import byte_symbols, small_batches, texts
from lodgetrail.session import stage

# Fixed values of byte-level tokenizer files: their pre-tokenizer, and the pattern it stands for.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizers file."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._library = Tokenizer.from_file(path)
        self._special = [t["content"] for t in spec["added_tokens"]]
        byte = {c: b for b, c in byte_symbols().items()}
        vocab = {t: n for t, n in spec["model"]["vocab"].items() if t not in self._special}
        ranks = {bytes(byte[c] for c in token): n for token, n in vocab.items()}
        # Where ids follow the order of the merges, they serve as ranks, and a faster encoder of the same rule does.
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == _BYTE_LEVEL and merged == sorted(merged)
        self._fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of ``text``."""
        if self._fast is None or any(s in text for s in self._special):
            ids = self._library.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ByteEncoder:
    """The encoder of a file, made once per worker."""
    return ByteEncoder(path)


def pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise whole texts, append ``end_id`` and cut what is longer than ``capacity``.

    Returns ``key``, ``piece`` (from 0), ``start`` (ids of the document before it), ``length`` and ``ids`` (binary,
    little-endian 32-bit). All pieces but the first have ``capacity`` ids. Null and empty texts make one piece that
    holds ``end_id`` alone; repeated rows make their own pieces; other columns are not looked at.
    """
    small_batches(df.sparkSession)
    rows = df.select(df[key].alias(key), df[text].alias("text"))
    schema = T.StructType([
        T.StructField(key, rows.schema[key].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = load(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, t in enumerate(texts(batch, "text")):
                coded = encoder.encode(t) + last
                n = len(coded) // 4
                first = n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                ends = [*starts[1:], n]
                row += [i] * len(starts)
                piece += range(len(starts))
                start += starts
                length += [b - a for a, b in zip(starts, ends, strict=True)]
                ids += [coded[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(ids, pa.binary())], [key, "piece", "start", "length", "ids"])

    return rows.mapInArrow(cut, schema)


@dataclass
class Plan:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def _at_most(have: np.ndarray) -> np.ndarray:
    """For every x the largest available length up to x, 0 if there is none."""
    return np.maximum.accumulate(np.where(have > 0, np.arange(len(have)), 0))


def _fill(gap: int, have: np.ndarray, exact: bool) -> tuple[int, ...]:
    """One, two or three available lengths with the largest sum up to ``gap``; fewest first.

    With ``exact``, only a sum of ``gap`` counts.
    """
    if have[gap]:
        return (gap,)
    down = _at_most(have)
    lengths = np.flatnonzero(have[: gap + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return ()
    best: tuple[int, ...] = (int(lengths[-1]),)
    # Pairs: the partner is the largest length that still fits; equal lengths need two pieces.
    partner = down[gap - lengths]
    twice = (partner == lengths) & (have[lengths] < 2)
    partner = np.where(twice, down[np.maximum(partner - 1, 0)], partner)
    sums = np.where(partner > 0, lengths + partner, 0)
    k = int(sums.argmax())
    if sums[k] > sum(best):
        best = (int(lengths[k]), int(partner[k]))
    if sum(best) < gap and len(lengths):
        room = gap - lengths[:, None] - lengths[None, :]
        third = np.where(room > 0, down[np.maximum(room, 0)], 0)
        need = (lengths[:, None] == lengths[None, :]).astype(int) + 1
        first = need + (third == lengths[:, None])
        second = need + (third == lengths[None, :])
        lacks = (have[lengths][:, None] < first) | (have[lengths][None, :] < second)
        sums3 = np.where((third > 0) & ~lacks, lengths[:, None] + lengths[None, :] + third, 0)
        i, j = divmod(int(sums3.argmax()), len(lengths))
        if sums3[i, j] > sum(best):
            best = (int(lengths[i]), int(lengths[j]), int(third[i, j]))
    return best if not exact or sum(best) == gap else ()


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts[length]`` pieces of each length: exact complements first, then best fit."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        have[length] = n
    used, out = np.zeros(capacity + 1, dtype=np.int64), Plan()

    def consume(parts: list[int]) -> None:
        """As many sequences of these parts as the counts allow."""
        times = int(min(have[p] // n for p, n in Counter(parts).items()) or 0)
        offset = 0
        for p, n in sorted(Counter(parts).items(), reverse=True):
            for _ in range(n):
                out.runs.append((p, int(used[p]), times, out.sequences, offset))
                used[p] += times
                offset += p
            have[p] -= n * times
        out.sequences += times

    def free(parts: list[int]) -> np.ndarray:
        rest = have.copy()
        for p in parts:
            rest[p] -= 1
        return rest

    for length in range(capacity, 0, -1):
        while have[length]:
            gap = capacity - length
            rest = _fill(gap, free([length]), exact=True) if gap else ()
            if gap and not rest:
                break
            consume([length, *rest])
    for length in range(capacity, 0, -1):
        while have[length]:
            parts = [length]
            while (gap := capacity - sum(parts)) and (more := _fill(gap, free(parts), exact=False)):
                parts += more
            consume(parts)
    return out


def pack(df: DataFrame, capacity: int = 1024) -> DataFrame:
    """Place the rows of ``df`` by their ``length`` (1 to ``capacity``) into sequences.

    Adds ``sequence_id`` (from 0) and ``offset``, gapless from 0 within a sequence; columns of these names are replaced.
    Every row is placed, repeated rows too; an empty table gives an empty table; all other columns pass through,
    whatever their names.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("sequence_id", "offset")]
    # The caller's columns travel in one, so theirs and ours don't meet.
    rows = df.select(F.struct(*(df[c] for c in own)).alias("row"), df["length"].cast("long").alias("length"), F.monotonically_increasing_id().alias("uid"))
    rows = stage(rows.withColumn("part", F.shiftright("uid", 33)), "pieces")
    local = rows.withColumn("k", F.row_number().over(Window.partitionBy("part", "length").orderBy("uid")) - 1)
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    made = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    runs = spark.createDataFrame(
        made.runs, "run_length long, rank long, times long, sequence long, offset long")
    ranked = local.join(bases, ["part", "length"]).withColumn("r", F.col("k") + F.col("base"))
    # At most a few entries per length: bounded by the capacity, not by the rows.
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("r") >= F.col("rank"))
                         & (F.col("r") < F.col("rank") + F.col("times")))
    return placed.select(*(F.col("row").getField(c).alias(c) for c in own), (F.col("sequence") + F.col("r") - F.col("rank")).alias("sequence_id"), "offset")
