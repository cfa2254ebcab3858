"""Benchmark decontamination by broadcast hash sets of normalised n-grams.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of everything beyond ASCII. Each benchmark item gives
its windows of ``WINDOW`` words, or one shorter window if it has fewer. The windows' 64-bit hashes, their SHA-256 and the
ids of their items make up hash sets of a proven size, which are broadcast one after the other. Documents are scanned
in place: the hashes of all their word windows are computed on the text's bytes and looked up in the set; a hit counts
once the SHA-256 of its words agrees. Only contaminated texts leave the scan, as spans and item ids, so nothing but
short rows is shuffled, and a text that occurs a million times is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetrail.llm.common import grams, hashed_words, small_batches
from lodgetrail.session import stage

WINDOW = 10
#: Bytes of one broadcast set. A benchmark with more windows is scanned for in several rounds.
PART_BYTES = 64 << 20
#: Bytes a window takes besides its item's id: hash, length, SHA-256, place of the id.
ENTRY_BYTES = 64
#: Bits of the table looked into first.
_FIRST_BITS = 20

# Lower-cased letters, digits and bytes of characters beyond ASCII stay; everything else separates words.
_PLAIN = np.full(256, 0x20, dtype=np.uint8)
_PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
#: The same rule for Spark's regular expressions, on texts that aren't lower-cased.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

_SPANS = "array<struct<start:int,end:int>>"


def normalised(column: pa.Array) -> pa.Array:
    """A string column without nulls, lower-cased, with a space for each character that is in no word."""
    validity, places, blob = column.buffers()
    if blob is None:
        return column
    data = pa.py_buffer(_PLAIN[np.frombuffer(blob, dtype=np.uint8)])
    return pa.Array.from_buffers(column.type, len(column), [None, places, data], offset=column.offset)


def _rows(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each value, not copied."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, blob = column.buffers()
    ends = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1]
    data = memoryview(blob) if blob is not None else memoryview(b"")
    for a, b in zip(ends, ends[1:], strict=False):
        yield data[a:b]


def _window_digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def item_windows(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """``length``, ``hash``, ``digest`` and ``item`` (id as a string) of every different window of every item.

    Null and empty texts and texts without a word give none; an item of fewer words than ``window`` gives one.
    """
    small_batches(items.sparkSession)
    rows = items.select(items[key].cast("string").alias("item"), F.coalesce(items[text], F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = normalised(batch.column("text"))
            for item, raw, hashes in zip(batch.column("item").to_pylist(), _rows(column), hashed_words(column), strict=True):
                words = bytes(raw).split()
                size = min(window, len(words))
                if not size:
                    continue
                found = grams(hashes, size).view(np.int64)
                digests = [_window_digest(words[k : k + size]) for k in range(len(found))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), size, dtype=np.int32)), pa.array(found), pa.array(digests, pa.binary()), pa.array([item] * len(found), pa.string())],
                    ["length", "hash", "digest", "item"])

    return rows.mapInArrow(cut, "length int, hash long, digest binary, item string").distinct()


@dataclass(frozen=True)
class WindowSet:
    """A hash set of windows with their items; rows lie in order of (length, hash)."""

    lengths: tuple[int, ...]
    edges: tuple[int, ...]
    hashes: np.ndarray
    digests: np.ndarray
    items: pa.Array
    first: tuple[np.ndarray, ...]

    @classmethod
    def of(cls, rows: pa.Table) -> WindowSet:
        """The set of a table of windows."""
        length = rows.column("length").to_numpy()
        hashes = rows.column("hash").to_numpy().view(np.uint64)
        order = np.lexsort((hashes, length))
        length, hashes = length[order], hashes[order]
        digests = np.frombuffer(b"".join(rows.column("digest").to_pylist()), dtype="V32")[order]
        items = rows.column("item").combine_chunks().take(pa.array(order))
        sizes, starts = np.unique(length, return_index=True)
        edges = (*starts.tolist(), len(length))
        first = []
        for a, b in zip(edges, edges[1:], strict=False):
            table = np.zeros(1 << _FIRST_BITS, dtype=bool)
            table[hashes[a:b] >> np.uint64(64 - _FIRST_BITS)] = True
            first.append(table)
        return cls(tuple(sizes.tolist()), edges, hashes, digests, items, tuple(first))

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Windows of a text whose hash is in the set: place, length, and the range of equal hashes."""
        for k, size in enumerate(self.lengths):
            own = grams(words, size)
            at = np.flatnonzero(self.first[k][own >> np.uint64(64 - _FIRST_BITS)])
            if not len(at):
                continue
            a, b = self.edges[k], self.edges[k + 1]
            low = a + np.searchsorted(self.hashes[a:b], own[at], "left")
            high = a + np.searchsorted(self.hashes[a:b], own[at], "right")
            for p, x, y in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                if x < y:
                    yield p, size, x, y

    def hits(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:
        """Spans of a text's words inside verified windows, overlapping ones merged, and the items of the windows."""
        places, rows = [], {}
        for p, size, x, y in self.candidates(hashes):
            digest = _window_digest(words[p : p + size])
            if digest not in rows:
                own = np.void(digest)
                rows[digest] = [r for r in range(x, y) if self.digests[r] == own]
            if rows[digest]:
                places.append((p, p + size))
        items = {self.items[r].as_py() for found in rows.values() for r in found} - {None}
        return merged(places), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(windows: DataFrame, part_bytes: int) -> tuple[DataFrame, int]:
    """The windows dealt into parts whose measured size fits, and the number of parts.

    A window's items are dealt too, so one that very many items share is no exception.
    """
    size = F.length("item") + ENTRY_BYTES
    n = max(1, -(-(windows.agg(F.sum(F.coalesce(size, F.lit(ENTRY_BYTES)))).first()[0] or 0) // part_bytes))
    while True:
        dealt = windows.withColumn("part", F.pmod(F.xxhash64("digest", "item"), F.lit(n)))
        largest = dealt.groupBy("part").agg(F.sum(F.coalesce(size, F.lit(ENTRY_BYTES))).alias("size")).agg(F.max("size")).first()[0] or 0
        if largest <= part_bytes or n > 1 << 20:
            return dealt, n
        n += -(-n // 4)


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The contaminated texts among ``docs``, one row per different text.

    Returns ``text_sha256`` (of the whole text), ``spans`` (array of start and end word, the end outside; merged, in
    order) and ``items`` (ids as strings, in order). Rows of other texts don't appear. A null item id hits like any other
    but is not listed. Each set is broadcast, scanned for and given up before the next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows, n = _parts(stage(item_windows(items, window, item, item_text), "windows"), part_bytes)
    rows = docs.select(F.coalesce(docs[text], F.lit("")).alias("text"))
    found = None
    for k in range(n):
        shared = spark.sparkContext.broadcast(WindowSet.of(windows.where(F.col("part") == k).select("length", "hash", "digest", "item").toArrow()))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                raw, plain = batch.column("text"), normalised(batch.column("text"))
                out: list[tuple] = []
                for whole, own, hashes in zip(_rows(raw), _rows(plain), hashed_words(plain), strict=True):
                    if next(known.candidates(hashes), None) is None:
                        continue
                    spans, ids = known.hits(bytes(own).split(), hashes)
                    if spans:
                        out.append((hashlib.sha256(whole).digest(), [{"start": a, "end": b} for a, b in spans], ids))
                yield _hit_batch(out)

        part = rows.mapInArrow(scan, f"text_sha256 binary, spans {_SPANS}, items array<string>")
        part = stage(part.groupBy("text_sha256").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    both = found.groupBy("text_sha256").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, spans, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                one = merged([(s["start"], s["end"]) for s in spans])
                out.append((name, [{"start": a, "end": b} for a, b in one], sorted(set(ids))))
            yield _hit_batch(out)

    return stage(both.mapInArrow(join, f"text_sha256 binary, spans {_SPANS}, items array<string>"), "contaminated")


def _hit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["text_sha256", "spans", "items"])


def _text_sha256(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def contamination(docs: DataFrame, hits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_hit``, ``spans`` and ``items`` of every row of ``docs``.

    Null and empty texts have no words. Rows that repeat are each judged; a null key is kept. Clean rows have empty arrays.
    Other columns are not looked at. An empty table gives an empty table, an empty benchmark no hits.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("_key"), F.regexp_count(whole, F.lit(_WORD)).cast("long").alias("n_words"), _text_sha256(docs[text]).alias("text_sha256"))
    joined = rows.join(hits, "text_sha256", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return joined.select(
        F.col("_key").alias(key), "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_documents(docs: DataFrame, hits: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts hold no window of the benchmark; all columns as they were."""
    names = docs.columns
    marked = docs.withColumn("_dc_sha256", _text_sha256(docs[text]))
    return marked.join(hits.select(F.col("text_sha256").alias("_dc_sha256")), "_dc_sha256", "left_anti").select(*names)


def remove_spans(docs: DataFrame, hits: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs``, the hit words and what lies between them cut out of their texts; columns as they were.

    What stands before and after a cut stays as it is, down to white space and punctuation. Null texts stay null.
    """
    names = docs.columns
    marked = docs.withColumn("_dc_sha256", _text_sha256(docs[text]))
    own = hits.select(F.col("text_sha256").alias("_dc_sha256"), F.col("spans").alias("_dc_spans"))
    hit = marked.join(own, "_dc_sha256")
    at = hit.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            spans = batch.column(batch.num_columns - 1).to_pylist()
            out = [_without(bytes(raw), own) for raw, own in zip(_rows(column), spans, strict=True)]
            columns = [batch.column(k) for k in range(batch.num_columns)]
            columns[at] = pa.array(out, pa.binary()).cast(column.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    small_batches(docs.sparkSession)
    cleaned = hit.mapInArrow(cut, hit.schema).select(*names)
    return drop_documents(docs, hits, text).unionByName(cleaned)


def _without(raw: bytes, spans: list[dict]) -> bytes:
    """A text's bytes without its words ``start`` to ``end`` of each span."""
    plain = _PLAIN[np.frombuffer(raw, dtype=np.uint8)] != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, plain, False].astype(np.int8)))
    start, stop = edges[::2], edges[1::2]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : start[s["start"]]])
        at = int(stop[s["end"] - 1])
    return b"".join([*kept, raw[at:]])
