import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import docs
from tokenizers import Tokenizer

from lodgetrail.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_hold_the_library_ids(spark):
    texts = ["short", "", None, " \n\n  spaces \t x ", "many words " * 900, "<|endoftext|> in it", "naïve 日本語\xa0 x", "short"]
    table = docs(spark, texts).withColumnRenamed("lang", "piece").withColumnRenamed("source", "ids")
    library = Tokenizer.from_file(PATH)
    got = {}
    for r in packing.pieces(table, PATH, 1024).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        parts = sorted(got[i], key=lambda r: r.piece)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist()
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert all(r.length == 1024 for r in parts[1:]) and 1 <= parts[0].length <= 1024


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice((8, 50, 100))
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity))}
    made = packing.plan(counts, capacity)
    seen, room = {}, {}
    for length, rank, times, sequence, offset in made.runs:
        for k in range(times):
            assert (length, rank + k) not in seen
            seen[length, rank + k] = sequence + k
            room.setdefault(sequence + k, []).append((offset, length))
    assert len(seen) == sum(counts.values()) and {(n, k) for n, c in counts.items() for k in range(c)} == set(seen)
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(room) == made.sequences >= -(-sum(n * c for n, c in counts.items()) // capacity)


def test_exact_complements_fill_whole_sequences():
    for counts in ({600: 5, 424: 5}, {700: 3, 200: 3, 124: 3}, {500: 2, 300: 2, 200: 2, 24: 2}):
        made = packing.plan(counts, 1024)
        assert made.sequences == sum(n * c for n, c in counts.items()) // 1024


def test_packed_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(["word"] * rng.randrange(0, 400)) for _ in range(120)] + ["same text"] * 60
    cut = packing.pieces(docs(spark, texts), PATH, 256)
    rows = packing.pack(cut, 256).collect()
    assert len(rows) == cut.count() and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) >= 0
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 256
    assert len(held) <= 1.02 * sum(r.length for r in rows) / 256 + 1


def test_no_rows_and_too_long_pieces(spark):
    assert packing.pack(packing.pieces(docs(spark, []), PATH), 1024).count() == 0
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_columns_of_any_name_pass_through(spark):
    from pyspark.sql import functions as F

    names = ["uid", "part", "k", "row", "base", "r", "rank", "times", "run_length", "sequence", "_uid", "_part", "_k", "_r"]
    table = spark.range(50).select((F.col("id") % 9 + 1).alias("length"), *(F.concat(F.lit(n), "id").alias(n) for n in names),
                                   F.lit("mine").alias("offset"), F.lit("mine").alias("sequence_id"))
    out = packing.pack(table, 10)
    assert out.columns == ["length", *names, "sequence_id", "offset"]
    rows = out.collect()
    assert sorted(r.uid for r in rows) == sorted(f"uid{i}" for i in range(50))
    assert {r.uid[3:]: r.rank[4:] for r in rows} == {str(i): str(i) for i in range(50)}
    taken = {}
    for r in rows:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 10
