"""BPE encoding with forced boundaries, and decoding.

A merge makes a token of the vocabulary, and that token holds every pair of neighbouring symbols it was made from.
So where two neighbouring symbols occur side by side inside no token, no merge can ever cross: a certain cut. A
pre-token is split at its certain cuts, the fragments are encoded on their own (and remembered), and their ids are
put one after the other.

Normalisation and pre-tokenisation are the tokenizer file's own. They never look across white space, so they run once
per distinct run of other characters; a bounded memory of those runs serves the rest of the text. Runs of Latin-1
characters, the bulk of European texts, take the same rules as regular expressions.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodgetrail.llm.common import byte_symbols, small_batches, texts

#: Runs, words and fragments remembered per task; past it a memory is emptied and filled anew. Results don't depend on it.
MEMORY = 500_000
#: Words and fragments of more symbols are not remembered.
LONGEST = 256
#: Fragments of more symbols are merged with a heap, in n log n steps; for shorter ones a scan is faster.
SHORT = 48
# Every tokenizer here treats these as white space.
_SOLID = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# Latin-1 without controls and spaces, and the file's pattern for lower-cased Latin-1.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


_BYTES = byte_symbols()
_ID_BITS = 24
_ID_MASK, _NEVER = (1 << _ID_BITS) - 1, 1 << 62


class ForcedBoundaryBpe:
    """The BPE model of a tokenizers file whose pre-tokenizer drops white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kind = spec["pre_tokenizer"] or {}
        drops = any(p.get("type") == "Split" and p.get("behavior") == "Removed" for p in kind.get("pretokenizers", [kind]))
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or not drops:
            raise ValueError("a plain BPE file whose pre-tokenizer drops white space is needed")
        library = Tokenizer.from_file(path)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        patterns = [p["pattern"].get("Regex") for p in kind.get("pretokenizers", []) if p["type"] == "Split"]
        self._plain = steps == ["NFC", "Replace", "Lowercase"] and patterns == [_FILE_PATTERN]
        self._normal, self._cut = library.normalizer, library.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Rank and resulting token of a pair, in one number.
        self.rank = {(self.vocab[a], self.vocab[b]): n << _ID_BITS | self.vocab[a + b] for n, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        names = {n: t for t, n in self.vocab.items()} | {n: t for t, n in self.special.items()}
        self.names = np.array([names.get(n, "") for n in range(max(names) + 1)], dtype=object)
        # Pairs of neighbouring symbols inside some token; all others are certain cuts.
        self.inside = {pair for token in self.vocab for pair in self._pairs(self._symbols(token))}
        self._fragments: dict[tuple[str, ...], list[int]] = {}
        self._words: dict[str, list[int]] = {}
        self.runs: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _symbols(self, token: str) -> list[str]:
        """The symbols of a vocabulary token; the last one carries the word end, if the token has it."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            stem = token[: -len(self.suffix)]
            return [*stem[:-1], stem[-1] + self.suffix]
        return list(token)

    @staticmethod
    def _pairs(symbols: list[str]) -> Iterator[tuple[str, str]]:
        return zip(symbols, symbols[1:], strict=False)

    def fragments(self, word: str) -> list[list[str]]:
        """A pre-token cut wherever its neighbouring symbols stand side by side in no token."""
        symbols = list(word)
        symbols[-1] += self.suffix
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:], strict=False), 1) if pair not in inside]
        if not cuts:
            return [symbols]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]

    def _merge(self, symbols: list[str]) -> list[int]:
        """Merge by rank, leftmost first, until no pair has a rank."""
        rank, vocab = self.rank.get, self.vocab
        ids = [vocab[s] for s in symbols if s in vocab]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        ranks = [rank(pair, _NEVER) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i] = best & _ID_MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for many symbols: pairs wait in a heap by rank and place, neighbours are linked."""
        rank, n = self.rank.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            best, i, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = best & _ID_MASK, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (r := rank((ids[a], ids[b]))) is not None:
                    heappush(heap, (r, a, ids[a], ids[b]))
        return [t for t in ids if t >= 0]

    def _word(self, word: str) -> list[int]:
        known = self._words.get(word)
        if known is not None:
            return known
        ids: list[int] = []
        for fragment in self.fragments(word):
            key = tuple(fragment)
            part = self._fragments.get(key)
            if part is None:
                part = self._merge(fragment)
                if len(key) < len(word) and len(key) <= LONGEST:  # a whole word is remembered as such
                    if len(self._fragments) >= MEMORY:
                        self._fragments.clear()
                    self._fragments[key] = part
            ids.extend(part)
        if len(word) <= LONGEST:
            if len(self._words) >= MEMORY:
                self._words.clear()
            self._words[word] = ids
        return ids

    def words(self, part: str) -> list[str]:
        """The pre-tokens of a run, one character per byte."""
        if self._plain and _PLAIN.fullmatch(part):
            found = _PLAIN_WORDS.findall(part.lower())
            return found if part.isascii() else [w if w.isascii() else "".join([_BYTES[b] for b in w.encode()]) for w in found]
        plain = self._normal.normalize_str(part) if self._normal else part
        return [w for w, _ in self._cut.pre_tokenize_str(plain)]

    def run(self, run: str) -> bytes:
        """Ids of a run without white space, as little-endian 32-bit numbers."""
        ids: list[int] = []
        end = 0
        for found in [*(self._special.finditer(run) if "<" in run else ()), None]:
            part = run[end : found.start() if found else len(run)]
            if part:
                for word in self.words(part):
                    ids.extend(self._word(word))
            if found:
                ids.append(self.special[found[0]])
                end = found.end()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit numbers."""
        found = _SOLID.findall(text)
        out = [*map(self.runs.get, found)]
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    out[i] = self._remembered(found[i])
        return b"".join(out)

    def _remembered(self, run: str) -> bytes:
        """Ids of a run that is not among the recent ones; runs met before stay, the others go in turn."""
        known = self.runs.get(run)
        if known is None:
            known = self._older.get(run)
            if known is None:
                known = self.run(run)
            if len(run) <= 64:
                if len(self.runs) >= MEMORY // 2:
                    self._older, self.runs = self.runs, {}
                self.runs[run] = known
        return known

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by a space, which is what a file without a decoder asks for."""
        return " ".join(self.names[ids])


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBpe:
    """The model of a file, read once per worker."""
    return ForcedBoundaryBpe(path)


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text of ``df``, and decode the ids again.

    Returns ``key``, ``ids`` (array of int) and ``decoded``. Null and empty texts have no ids and decode to the empty
    string; repeated rows are each encoded; other columns are not looked at. ``path`` must be readable on every
    executor. The work is one pass over the rows without a shuffle.
    """
    small_batches(df.sparkSession)
    rows = df.select(df[key].alias(key), df[text].alias("text"))
    schema = T.StructType([
        T.StructField(key, rows.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("decoded", T.StringType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            coded = [model.encode(t) for t in texts(batch, "text")]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
            flat = np.frombuffer(b"".join(coded), dtype="<i4")
            decoded = [model.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], [key, "ids", "decoded"])

    return rows.mapInArrow(encode, schema)
