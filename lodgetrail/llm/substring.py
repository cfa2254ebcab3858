"""Removing word sequences that occur earlier, by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words; a word goes if a window over it starts earlier in the corpus too. Windows that
are equal choose the same anchor, the 8-word run with the smallest hash in them, so all occurrences of a window
meet under its anchor. Anchors that occur once can't hold a repeat and drop out. What is left are stretches of text
(windows with one anchor); equal stretches collapse to their first occurrence, and the distinct ones, dealt by anchor,
are the reference shards. Each shard becomes a suffix automaton whose states know where their word sequence starts
first, and the stretches are streamed through it: wherever the matching statistic reaches the window length, the state
tells whether this is the first occurrence. Windows that are not go.

A shard holds a bounded number of words, so an automaton has a proven size and is only needed in the one task it is
made in. Anchors with very many different stretches are dealt by whole windows instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetrail.llm.common import grams, hashed_words, small_batches
from lodgetrail.session import stage

WINDOW = 20
ANCHOR = 8
#: Words of a reference shard on average.
SHARD_WORDS = 40_000
#: Different stretches of an anchor from which on they are dealt by whole windows.
HEAVY = 1000


class SuffixAutomaton:
    """All word sequences of some stretches, each with the place where it ends first."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [_NEVER]

    def _state(self, length: int, link: int, moves: dict, first: tuple[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """The state for what ``p`` and ``word`` spell, cut off from the longer sequences of ``q``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), _NEVER)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[str], doc: int, start: int) -> None:
        """Add a stretch that begins at word ``start`` of ``doc``."""
        last = 0
        for k, word in enumerate(words):
            at = (doc, start + k)
            q = self.next[last].get(word)
            if q is not None:  # another stretch begins alike
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                if at < self.first[last]:
                    self.first[last] = at
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {}, at)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)

    def close(self) -> None:
        """Hand first ends on from longer to shorter sequences."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0 and self.first[v] < self.first[up]:
                self.first[up] = self.first[v]

    def first_ends(self, words: list[str], window: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """Places where the matching statistic of ``words`` reaches the window, with the window's first end."""
        v, matched = 0, 0
        for k, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            v = self.next[v].get(word, 0)
            matched = matched + 1 if v else 0
            if matched >= window:
                while self.length[self.link[v]] >= window:
                    v = self.link[v]
                    matched = min(matched, self.length[v])
                yield k, self.first[v]


_NEVER = (1 << 70, 0)


def anchors_of(words: np.ndarray, window: int) -> np.ndarray:
    """For each window the place of its anchor."""
    runs = grams(words, ANCHOR)
    if len(words) < window:
        return np.zeros(0, dtype=np.int64)
    reach = window - ANCHOR + 1
    return np.lib.stride_tricks.sliding_window_view(runs, reach).argmin(axis=1) + np.arange(len(words) - window + 1)


def stretches(words: np.ndarray, places: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """Runs of windows with one anchor out of ``places``: the anchor's hash, the first window and their number."""
    chosen = anchors_of(words, window)
    if not len(chosen):
        return
    runs = grams(words, ANCHOR).view(np.int64)
    edge = np.flatnonzero(np.diff(chosen)) + 1
    for a, b in zip([0, *edge], [*edge, len(chosen)], strict=True):
        if chosen[a] in places:
            yield int(runs[chosen[a]]), int(a), int(b - a)


def _class_of(joined: bytes) -> tuple[str, int]:
    """The SHA-256 of a document's words and a 64-bit name of its class made from it."""
    digest = hashlib.sha256(joined).digest()
    return digest.hex(), int.from_bytes(digest[:8], "little", signed=True)


def _words(text: bytes) -> list[bytes]:
    return text.split()  # bytes split at exactly the six ASCII white-space characters


def _binary(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _described(docs: DataFrame, window: int) -> DataFrame:
    """Per row ``doc``, ``n_words``, ``words_sha256``, ``class``, and its windows' ``anchors`` with their ``places``, in one pass."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, name, own, at = [], [], [], [], []
            for text, words in zip(_binary(batch), hashed_words(batch.column("text")), strict=True):
                digest, kind = _class_of(b" ".join(_words(text)))
                chosen = np.unique(anchors_of(words, window))
                n.append(len(words))
                sha.append(digest)
                name.append(kind)
                own.append(grams(words, ANCHOR).view(np.int64)[chosen])
                at.append(chosen.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
            flat = [np.concatenate([*x, np.zeros(0, dtype=kind)]) for x, kind in ((own, np.int64), (at, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(name, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)],
                ["doc", "n_words", "words_sha256", "class", "anchors", "places"])

    return docs.mapInArrow(describe, "doc long, n_words long, words_sha256 string, class long, anchors array<long>, places array<int>")


def _repeated_places(described: DataFrame) -> DataFrame:
    """``class`` and ``place`` of all anchors that occur in two classes or places; ``described`` is staged, as it is read twice.

    Anchors are sorted by hash over ranges of (hash, class, place), so a frequent one spreads over tasks; a task reads
    its rows in order and holds one. The first and last row of a task are passed on unseen: they may have a partner in the
    next task, and a place too many only costs a later look.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row so far
        held_on, first = False, True

        def rows(x: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[1][keep]), pa.array(x[2][keep])], ["class", "place"])

        for batch in batches:
            x = [batch.column(k).to_numpy() for k in range(3)]
            if not len(x[0]):
                continue
            if held is not None:
                x = [np.concatenate([h, y]) for h, y in zip(held, x, strict=True)]
            new = np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]) | (x[2][1:] != x[2][:-1])]
            x = [y[new] for y in x]
            alike = x[0][1:] == x[0][:-1]
            keep = np.r_[held_on or first, alike] | np.r_[alike, False]
            held, held_on, first = [y[-1:] for y in x], bool(keep[-1]), False
            keep[-1] = False
            yield rows(x, keep)
        if held is not None:
            yield rows(held, np.array([True]))

    each = described.select("class", F.explode(F.arrays_zip("anchors", "places")).alias("a"))
    sorted_rows = each.select(F.col("a.anchors").alias("anchor"), "class", F.col("a.places").alias("place"))
    sorted_rows = sorted_rows.repartitionByRange("anchor", "class", "place").sortWithinPartitions("anchor", "class", "place")
    return sorted_rows.mapInArrow(repeated, "class long, place int")


def _first_windows(candidates: DataFrame, window: int) -> DataFrame:
    """``class``, ``start`` and ``own``: bits of the windows of a stretch that occur there for the first time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(k).to_pylist() for k in ("doc", "class", "places"))
            for doc, name, places, text, hashes in zip(*columns, _binary(batch), hashed_words(batch.column("text")), strict=True):
                words = _words(text)
                if _class_of(b" ".join(words))[1] != name:
                    continue  # another text under the same key
                for anchor, start, n in stretches(hashes, set(places), window):
                    out.append((anchor, b" ".join(words[start : start + n + window - 1]), doc, start, name))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            arrays[1] = arrays[1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "words", "doc", "start", "class"])

    found = candidates.select("doc", "class", "text", "places").mapInArrow(cut, "anchor long, words string, doc long, start int, class long")
    distinct = stage(found.groupBy("anchor", "words").agg(F.min(F.struct("doc", "start", "class")).alias("at")).select("anchor", "words", "at.*"), "stretches")
    heavy = stage(distinct.groupBy("anchor").count().where(F.col("count") > HEAVY).select("anchor"), "heavy-anchors")
    total = distinct.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    light = distinct.join(heavy, "anchor", "left_anti").select(F.pmod("anchor", F.lit(shards)).alias("shard"), "words", "doc", "start", "class", F.lit(0).alias("from"))
    parts = F.split("words", " ")
    single = F.transform(F.sequence(F.lit(0), F.size(parts) - window), lambda k: F.struct(k.alias("from"), F.array_join(F.slice(parts, k + 1, window), " ").alias("words")))
    whole = distinct.join(heavy, "anchor").select("doc", "start", "class", F.explode(single).alias("w")).select("doc", "start", "class", "w.from", "w.words")
    whole = whole.groupBy("words").agg(F.min(F.struct("doc", (F.col("start") + F.col("from")).alias("place"), "start", "from", "class")).alias("at"))
    whole = whole.select(F.pmod(F.xxhash64("words"), F.lit(shards)).alias("shard"), "words", "at.doc", "at.start", "at.class", "at.from")

    def match(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        automaton, read = SuffixAutomaton(), []
        for r in rows:
            words = r["words"].split(" ")
            automaton.add(words, r["doc"], r["start"] + r["from"])
            read.append(words)
        automaton.close()
        own = []
        for r, words in zip(rows, read, strict=True):
            bits = 0
            for k, end in automaton.first_ends(words, window):
                if end == (r["doc"], r["start"] + r["from"] + k):
                    bits |= 1 << (k - window + 1 + r["from"])
            own.append(bits)
        return pa.table({"class": table.column("class"), "start": table.column("start"), "own": pa.array(own, pa.int64())})

    owned = light.unionByName(whole).groupBy("shard").applyInArrow(match, "class long, start int, own long").where("own <> 0")
    return owned.groupBy("class", "start").agg(F.bit_or("own").alias("own"))


def find_repeats(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Find the words covered by windows that start earlier too (smaller key, or earlier in the same text).

    Returns, per row, ``key``, ``n_words``, ``n_removed``, ``spans`` (array of start and end word, the end outside),
    ``kept_text`` (kept words joined by one space; null where nothing goes) and ``words_sha256`` (of all words joined by
    one space). Words are runs of other characters than ASCII white space. Windows are judged on the input. Null
    and empty texts and texts shorter than a window keep what they have. Of rows with equal words, all but the first key
    go whole. ``key`` is a whole number; rows that repeat key and text are one document judged once, and of different texts under one key
    each is judged by its own words. An empty table gives
    an empty table; other columns are not looked at.
    """
    if not ANCHOR <= window < ANCHOR + 63:
        raise ValueError(f"windows of {ANCHOR} to {ANCHOR + 62} words are possible")
    small_batches(df.sparkSession)
    docs = df.select(df[key].cast("long").alias("doc"), F.coalesce(df[text], F.lit("")).alias("text"))

    described = stage(_described(docs, window), "word-facts")
    facts = described.select("doc", "n_words", "words_sha256", "class")
    firsts = stage(facts.where(F.col("n_words") >= window).groupBy("class").agg(F.min("doc").alias("first")), "word-classes")
    places = _repeated_places(described).groupBy("class").agg(F.collect_set("place").alias("places"))
    wanted = stage(places.join(firsts, "class").select(F.col("first").alias("doc"), "class", "places"), "places")
    candidates = stage(docs.join(wanted, "doc").select("doc", "class", "text", "places"), "candidates")
    owned = _first_windows(candidates, window).groupBy("class").agg(F.collect_list(F.struct("start", "own")).alias("owned"))
    owned = stage(owned, "first-windows")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(k).to_pylist() for k in ("class", "places", "owned"))
            for name, places, owned, text, hashes in zip(*columns, _binary(batch), hashed_words(batch.column("text")), strict=True):
                words = _words(text)
                if _class_of(b" ".join(words))[1] != name:
                    continue  # another text under the same key
                first = {r["start"]: r["own"] for r in owned or ()}
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                for _, start, n in stretches(hashes, set(places), window):
                    bits = first.get(start, 0)
                    for k in range(n):
                        if not bits >> k & 1:
                            gone[start + k] += 1
                            gone[start + k + window] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                if gone.any():
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode("utf-8", "surrogatepass")
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    out.append((name, int(gone.sum()), spans, kept))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["class", "removed", "spans", "kept_text"])

    changed = candidates.join(owned, "class", "left").mapInArrow(remove, "class long, removed long, spans array<struct<start:int,end:int>>, kept_text string")
    changed = stage(changed.dropDuplicates(["class"]), "changed")
    known = stage(firsts.join(changed, "class", "left"), "word-verdicts")
    out = facts.join(known, "class", "left")
    later = F.col("first") < F.col("doc")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return out.select(
        F.col("doc").alias(key), "n_words", F.when(later, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(later, whole).otherwise(F.col("spans")).alias("spans"), F.when(later, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"), "words_sha256")
