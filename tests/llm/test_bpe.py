import public_tokenizers
import pytest
from helpers_llm import docs
from tokenizers import Tokenizer

from lodgetrail.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, and don't they'll 1234!", "", None, "  \t\n ", "Ünïcödé naïve ÉCOLE straße ½ µm", "日本語のテキスト 한국어 Ελληνικά ΣΊΣΥΦΟΣ",
    "a<|endoftext|>b <|startoftext|> <|x|>", "é ẹ́ ́x \x1cab\x85cd\xa0ef gh", "x" * 3000, "İstanbul ǅ ﬁ", "🙂🙂 ‍ zero", "\x00\x01", "same same same",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_equal_the_library(spark, library):
    table = docs(spark, [*TEXTS, "same same same"]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(table, PATH).collect()}
    for i, text in enumerate([*TEXTS, "same same same"]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False)), text


def test_real_documents_equal_the_library(spark, library):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in bpe.encode_decode(table, PATH).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_cuts_are_certain_and_fragments_make_the_word():
    model = bpe.load(PATH)
    for word in ("hello", "ofthe", "qzxjvkw", "ñandúqj", "12ab"):
        word = "".join(bpe._BYTES[b] for b in word.encode())
        parts = model.fragments(word)
        assert "".join(s for p in parts for s in p) == word + model.suffix
        for left, right in zip(parts, parts[1:]):
            assert (left[-1], right[0]) not in model.inside


def test_forgetting_changes_nothing(monkeypatch):
    text = " ".join(f"word{i} again" for i in range(300))
    whole = bpe.ForcedBoundaryBpe(PATH).encode(text)
    monkeypatch.setattr(bpe, "MEMORY", 4)
    assert bpe.ForcedBoundaryBpe(PATH).encode(text) == whole


def test_long_runs_equal_the_library(library):
    import random
    import time

    model = bpe.ForcedBoundaryBpe(PATH)
    rng = random.Random(8)
    start = time.perf_counter()
    for text in ("a" * 1_000_000, "abc" * 5000, "".join(rng.choice("aeiost") for _ in range(60_000)), "é" * 9000 + "x", "".join(rng.choice("0a.") for _ in range(5000))):
        import numpy as np

        assert np.frombuffer(model.encode(text), dtype="<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert time.perf_counter() - start < 60
    assert all(len(w) <= bpe.LONGEST for w in model._words) and all(len(f) <= bpe.LONGEST for f in model._fragments)


def test_both_ways_of_merging_agree():
    import random

    model, rng = bpe.ForcedBoundaryBpe(PATH), random.Random(9)
    for _ in range(3000):
        symbols = [rng.choice("etaoinshr") for _ in range(rng.randrange(1, 40))]
        assert model._merge(symbols) == model._merge_long([model.vocab[x] for x in symbols])


def test_no_rows(spark):
    assert bpe.encode_decode(docs(spark, []), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.ForcedBoundaryBpe(public_tokenizers.path("byte_bpe_50k.json"))
