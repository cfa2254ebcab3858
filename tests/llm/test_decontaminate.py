import hashlib
import random
import re

from helpers_llm import docs

from lodgetrail.llm import decontaminate as dc

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, items, window=10):
    """Hit places and items with an occurring window, window by window."""
    own, hit, found = words(text), set(), set()
    for item, t in items:
        ws = words(t)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1) if n else ():
            for p in range(len(own) - n + 1):
                if own[p : p + n] == ws[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(own), hit, sorted(str(i) for i in found if i is not None)


def cases():
    rng = random.Random(5)
    fresh = lambda n: [rng.choice(["a", "B1", "é", "日本", "x9", "Zz"]) + rng.choice("pqrst") for _ in range(n)]
    items = [(1, " ".join(fresh(30))), (2, " ".join(fresh(14))), (3, "Only, four: words -- here"), (10, "one"), (4, ""), (5, None), (6, "... !"), (7, " ".join(fresh(10)))]
    items += [(8, items[1][1]), (None, " ".join(fresh(12))), (1, " ".join(fresh(11)))]
    texts = [None, "", "?!", "one", "ONE. two", "nothing of it", "x " * 30_000 + items[0][1] + " y" * 30_000, items[3][1] + " " + items[2][1].upper()]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            ws = words(rng.choice(items)[1])
            a = rng.randrange(len(ws) + 1)
            parts += ws[a : a + rng.randrange(20)] + fresh(rng.randrange(4))
        texts.append(rng.choice([" ", "\n- ", ", "]).join(parts))
    return items, texts + texts[10:14]


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string").repartition(2)


def check(spark, part_bytes):
    items, texts = cases()
    table = docs(spark, texts).withColumnRenamed("lang", "spans").withColumnRenamed("source", "n_words")
    hits = dc.find_hits(table, items_table(spark, items), part_bytes=part_bytes)
    rows = {r.doc_id: r for r in dc.contamination(table, hits).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, hit, found = by_hand(t, items)
        r = rows[i]
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), found), t
        assert {p for s in r.spans for p in range(s["start"], s["end"])} == hit
        assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:], strict=False))
    return table, hits, items, texts


def test_hits_equal_brute_force(spark):
    check(spark, dc.PART_BYTES)


def test_rounds_dont_matter(spark):
    check(spark, 700)


def test_removal(spark):
    table, hits, items, texts = check(spark, dc.PART_BYTES)
    clean = {i for i, t in enumerate(texts) if not by_hand(t, items)[1]}
    left = dc.drop_documents(table, hits)
    assert {r.doc_id for r in left.collect()} == clean and left.columns == table.columns
    cut = dc.remove_spans(table, hits)
    assert cut.columns == table.columns
    rows = {r.doc_id: r for r in cut.collect()}
    for i, t in enumerate(texts):
        _, hit, _ = by_hand(t, items)
        assert words(rows[i].text) == [w for k, w in enumerate(words(t)) if k not in hit]
        assert i not in clean or rows[i].text == t


def test_no_items_no_documents(spark):
    none = items_table(spark, [(1, None)]).where("item_id = 2")
    some = docs(spark, ["a b", None])
    assert [(r.n_hit, r.spans, r["items"]) for r in dc.contamination(some, dc.find_hits(some, none)).collect()] == [(0, [], [])] * 2
    empty = docs(spark, [])
    assert dc.contamination(empty, dc.find_hits(empty, items_table(spark, [(1, "a b")]))).count() == 0


def test_a_hash_alone_is_no_hit(spark):
    windows = dc.item_windows(items_table(spark, [(1, "alpha beta")])).toArrow()
    wrong = windows.set_column(windows.column_names.index("digest"), "digest", [[hashlib.sha256(b"other").digest()]])
    from lodgetrail.llm.common import hashed_words
    import pyarrow as pa

    column = pa.array(["alpha beta"])
    hashes = next(hashed_words(column))
    assert dc.WindowSet.of(windows).hits([b"alpha", b"beta"], hashes) == ([(0, 2)], ["1"])
    assert dc.WindowSet.of(wrong).hits([b"alpha", b"beta"], hashes) == ([], [])


def test_repeated_rows_and_null_keys(spark):
    table = docs(spark, [(None, "only four words here"), (3, "only four words here"), (3, "only four words here")])
    found = dc.contamination(table, dc.find_hits(table, items_table(spark, [(9, "only four words here")]))).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in found) == [(0, 4), (3, 4), (3, 4)]
