import random

from helpers_llm import WORD, docs

from lodgetrail.llm import quality

EDGES = [None, "", " \n\n ", "one", "a b c d e a b c d e", "a a a a a a a a a a a", "line\nline\nother\nline\n", "#*$ %&| <>", "x" * 50_000, "é ü ñ 日本 \x85 \xa0 z", "same", "same"]


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def texts():
    rng = random.Random(1)
    return EDGES + ["".join(rng.choice(["a ", "b ", "c\n", "dd ", "# ", "\t"]) for _ in range(rng.randrange(200))) for _ in range(40)]


def test_measurements_equal_brute_force(spark):
    table = docs(spark, texts())
    rows = {r.doc_id: r for r in quality.ledger(table.withColumnRenamed("lang", "n_words")).collect()}
    for i, t in enumerate(texts()):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(t), t
        assert bool(r.failed & 1) == (r.n_words < 10) and bool(r.failed & 2) == (100 * r.n_repeat_words > 20 * r.n_words)


def test_policies_only_read_their_bits(spark):
    book = quality.ledger(docs(spark, texts()))
    one = quality.Policy("one", 2, ("symbols",))
    for r in quality.apply_policy(book, one).collect():
        assert r.kept == (not r.failed & 4)
    assert quality.STANDARD.mask == 31 and quality.BASE.mask == 3


def test_ablations_equal_counting(spark):
    book = quality.ledger(docs(spark, texts()))
    bits = [r.failed for r in book.collect()]
    for r in quality.ablations(book, quality.STANDARD).collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r.rule)
        assert r.policy == "standard/1"
        assert (r.failed, r.alone) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))
        assert r.kept_without == sum(not b & ~bit for b in bits)
    assert {r.failed for r in quality.ablations(quality.ledger(docs(spark, [])), quality.BASE).collect()} == {0}


def test_only_native_work(spark):
    plan = quality.ledger(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
