import hashlib
import random

import pytest
from helpers_llm import docs, without_repeats

from lodgetrail.llm import substring

EDGES = ["", None, "  ", "short text", "x " * 200, " ".join(f"n{i}" for i in range(19))]


def passages(seed, n=40):
    rng = random.Random(seed)
    shared = [[f"p{k}w{i}" for i in range(rng.randrange(15, 60))] for k in range(5)]
    out = []
    for d in range(n):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"d{d}u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))]
            if rng.random() < 0.6:
                part = rng.choice(shared)
                words += part[: rng.randrange(10, len(part) + 1)]
        out.append("  \n".join(words))
    return out + [out[3], out[5], out[3]]


def check(spark, texts, window=20):
    table = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    words, kept = without_repeats(table, window)
    rows = substring.find_repeats(docs(spark, texts).withColumnRenamed("lang", "class").withColumnRenamed("source", "words"), window).collect()
    assert len(rows) == len(table)
    for r in rows:
        w, k = words[r.doc_id], kept[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(w), len(w) - len(k)), r.doc_id
        assert (" ".join(k) if len(k) < len(w) else None) == r.kept_text
        assert r.words_sha256 == hashlib.sha256(" ".join(w).encode()).hexdigest()
        inside = {p for s in r.spans or () for p in range(s.start, s.end)}
        assert [x for p, x in enumerate(w) if p not in inside] == k


@pytest.mark.parametrize("seed", range(2))
def test_removed_words_equal_brute_force(spark, seed):
    check(spark, passages(seed) + EDGES)


def test_few_different_words(spark):
    rng = random.Random(4)
    check(spark, [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))) for _ in range(12)], window=9)


def test_heavy_anchors_go_by_window(spark, monkeypatch):
    monkeypatch.setattr(substring, "HEAVY", 2)
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    check(spark, passages(9, 25))


def test_ids_may_be_sparse_and_repeat(spark):
    text = " ".join(f"w{i}" for i in range(30))
    check(spark, [(-5, text), (2**40, "a b " + text), (7, text)])
    rows = substring.find_repeats(docs(spark, [(1, text), (1, text)])).collect()
    assert [r.n_removed for r in rows] == [0, 0]


def test_different_texts_under_one_key_are_judged_by_their_own_words(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    texts = [(5, f"{a} x"), (5, f"y y y {b}"), (9, f"z {a} {b}"), (2, "unrelated " * 3)]
    rows = substring.find_repeats(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rows) == [(2, 3, 0), (5, 41, 0), (5, 43, 0), (9, 81, 80)]


def test_no_rows(spark):
    assert substring.find_repeats(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring.find_repeats(docs(spark, []), window=5)


@pytest.mark.parametrize("seed", range(20))
def test_automaton_knows_first_ends(seed):
    rng = random.Random(seed)
    parts = [([rng.choice("abc") for _ in range(rng.randrange(1, 12))], rng.randrange(5), 100 * k) for k in range(6)]
    automaton = substring.SuffixAutomaton()
    for words, doc, start in parts:
        automaton.add(words, doc, start)
    automaton.close()
    first = {}
    for words, doc, start in parts:
        for i in range(len(words) - 2):
            at = (doc, start + i + 2)
            first[tuple(words[i : i + 3])] = min(first.get(tuple(words[i : i + 3]), at), at)
    probe = [rng.choice("abcd") for _ in range(60)]
    want = {k: first[tuple(probe[k - 2 : k + 1])] for k in range(2, 60) if tuple(probe[k - 2 : k + 1]) in first}
    assert dict(automaton.first_ends(probe, 3)) == want
