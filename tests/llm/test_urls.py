import pytest
from pyspark.sql import functions as F

from lodgetrail.llm import urls

LABELS = "doc_id long, quality int"


def pages(spark, found):
    return spark.createDataFrame([(i, u, "en") for i, u in enumerate(found)], "page_id long, url string, host string").repartition(3)


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.Example.NET/de/x?y#z", "a.example.net", "/de/x", "net/", "block"),
    ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://example.com/de", "example.com", "/de", None, "allow"),
    ("https://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.net?a=/b", "x.net", "", None, "allow"),
    ("x.net/path", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("a://b://c.net/d", "b:", "//c.net/d", None, "allow"), ("://ÄX.NET/q", "Äx.net", "/q", "net/", "block"), ("http://net/", "net", "/", "net/", "block"),
])
def test_fixed_rules(spark, url, host, path, rule, verdict):
    labels = spark.createDataFrame([], LABELS)
    r = urls.judge(pages(spark, [url]), labels).first()
    assert (r.host, r.path, r.rule, r.verdict, r.mined_rule) == (host, path, rule, verdict, None)


def test_a_combination_is_mined_and_matched(spark):
    found = []
    for i in range(200):
        bad = i % 4 == 0
        host = "spam.test" if bad or i % 4 == 1 else f"h{i % 7}.test"
        found.append(f"http://{host}/{'win' if bad or i % 4 == 2 else 'news'}/{i}")
    found += ["http://spam.test/win/9999?x=1", "http://spam.test/news/9999", "http://h1.test/win/77", "http://spam.test/win/9999?x=1"]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(160)] + [(None, 0), (3, None)], LABELS)
    got = {r.page_id: r for r in urls.judge(pages(spark, found), labels).collect()}
    assert len(got) == len(found)
    for i in range(200):
        assert got[i].verdict == ("block" if i % 4 == 0 else "allow")
    assert [got[i].verdict for i in range(200, 204)] == ["block", "allow", "allow", "block"]
    assert got[200].mined_rule == "host:spam path:win"


def test_matching_equals_looking_at_every_rule(spark):
    baskets = [["a", "b", "c"], ["b"], ["a", "c"], [], ["d", "e"]]
    rules = [(["a", "b"], 0.7), (["c"], 0.9), (["d", "f"], 0.8)]
    df = spark.createDataFrame([(b,) for b in baskets], "tokens array<string>")
    table = spark.createDataFrame([(t, c, 3.0, 0.1) for t, c in rules], "rule_tokens array<string>, confidence double, lift double, support double")
    got = {tuple(r.tokens): r.mined_rule for r in urls.match(df, table).collect()}
    want = {}
    for b in baskets:
        fits = [(c, " ".join(t)) for t, c in rules if set(t) <= set(b)]
        if fits:
            want[tuple(b)] = max(fits)[1]
    assert got == want


def labelled(spark, rows):
    return spark.createDataFrame([(f"u{k}", sorted(t), low) for k, (t, low) in enumerate(rows)], "url string, tokens array<string>, low boolean").repartition(3)


def rules_by_hand(spark, rows):
    """Every token subset of the mined rows that the rule form allows, counted one by one."""
    from itertools import combinations

    df = labelled(spark, rows).select("tokens", "low", (F.pmod(F.xxhash64("url"), F.lit(3)) == 1).alias("held"))
    split = [(frozenset(r.tokens), r.low, r.held) for r in df.collect()]
    mined, held = [(t, low) for t, low, h in split if not h], [(t, low) for t, low, h in split if h]
    n, all_low = len(mined), sum(low for _, low in mined)
    least = max(urls.MIN_ROWS, urls.MIN_SUPPORT * n)
    fits = lambda s, rows: [low for t, low in rows if s <= t]
    names = {x for t, _ in mined for x in t if len(fits({x}, mined)) >= least}
    rules = {}
    for size in range(1, len(names) + 1):
        for s in map(frozenset, combinations(sorted(names), size)):
            own = fits(s, mined)
            if sum(own) >= least and sum(own) / len(own) >= urls.MIN_CONFIDENCE and sum(own) / len(own) >= urls.MIN_LIFT * all_low / n:
                if not any(o < s and c >= sum(own) / len(own) for o, c in rules.items()):
                    rules[s] = sum(own) / len(own)
    proof = {s: fits(s, held) for s in rules}
    return {tuple(sorted(s)): (round(c, 9), len(proof[s]), round(sum(proof[s]) / len(proof[s]), 9)) for s, c in rules.items()
            if len(proof[s]) >= urls.MIN_HELD_OUT and sum(proof[s]) >= urls.MIN_CONFIDENCE * len(proof[s])}


def test_rules_equal_counting(spark):
    import random

    rng = random.Random(4)
    rows = []
    for _ in range(900):
        t = {x for x in "abcdef" if rng.random() < 0.4} | {f"u{rng.randrange(400)}"}
        rows.append((t, rng.random() < (0.9 if {"a", "b"} <= t else 0.8 if {"c", "d", "e"} <= t else 0.1)))
    got = {tuple(r.rule_tokens): (round(r.confidence, 9), r.held_out_rows, round(r.held_out_precision, 9)) for r in urls.mine(labelled(spark, rows)).collect()}
    assert got == rules_by_hand(spark, rows) and ("a", "b") in got
    report = urls.held_out_report(urls.mine(labelled(spark, rows))).first()
    assert report.rules == len(got) and report.precision > 0.7


@pytest.mark.parametrize("listed", [14, 0])
def test_urls_of_many_frequent_tokens_lose_no_rule(spark, monkeypatch, listed):
    """Nine tokens go with low quality as well, but only ``y`` and ``z`` together say it surely."""
    import random

    monkeypatch.setattr(urls, "FP_TOKENS", listed)
    rng = random.Random(5)
    rows = []
    for k in range(1200):
        low = k % 4 == 0
        t = {x for x in "abcdefghi" if rng.random() < (0.95 if low else 0.75)} | {f"u{rng.randrange(400)}"}
        rows.append((t | ({"y", "z"} if low else {"y"} if k % 2 else {"z"} if rng.random() < 0.97 else {"y", "z"}), low))
    got = {tuple(r.rule_tokens): (round(r.confidence, 9), r.held_out_rows, round(r.held_out_precision, 9)) for r in urls.mine(labelled(spark, rows)).collect()}
    assert ("y", "z") in got and got == rules_by_hand(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_grown_rules_equal_counting(spark, monkeypatch, seed):
    """Tokens that always come together, tokens in every URL of good quality, and rules without an exception."""
    import random

    monkeypatch.setattr(urls, "FP_TOKENS", 0)
    rng = random.Random(seed)
    rows = []
    for _ in range(700):
        t = {x for x in "abcdef" if rng.random() < 0.5} | {f"u{rng.randrange(300)}"}
        t |= ({"A", "B"} if "a" in t else set()) | ({"s"} if {"c", "d"} <= t else set())
        low = {"a", "b"} <= t or {"c", "d", "e"} <= t and rng.random() < 0.8 or rng.random() < 0.05
        rows.append((t if low else t | {"g"}, low))
    got = {tuple(r.rule_tokens): (round(r.confidence, 9), r.held_out_rows, round(r.held_out_precision, 9)) for r in urls.mine(labelled(spark, rows)).collect()}
    assert got == rules_by_hand(spark, rows) and {("A", "b"), ("B", "b"), ("a", "b")} <= set(got)


def test_labels_that_say_nothing_make_no_rules(spark):
    import random

    rng = random.Random(6)
    rows = [({rng.choice("abcdefgh"), rng.choice("ijklmnop"), f"u{k}"}, rng.random() < 0.3) for k in range(1500)]
    assert urls.mine(labelled(spark, rows)).count() == 0


def test_few_rows_and_long_urls_end_soon(spark):
    import time

    start = time.perf_counter()
    path = "/".join(f"word{k}" for k in range(200))
    some = pages(spark, [f"http://h.test/{path}", "http://h.test/a"])
    assert [r.verdict for r in urls.judge(some, spark.createDataFrame([(0, 0), (1, 1)], LABELS)).collect()] == ["allow", "allow"]
    # The same 200 words in many labelled URLs, of which some differ in a few.
    rows = [({f"w{k}" for k in range(200)} - {f"w{k % 7}"}, k % 2 == 0) for k in range(120)] + [({f"x{k % 9}", f"y{k}"}, False) for k in range(400)]
    urls.mine(labelled(spark, rows)).collect()
    assert time.perf_counter() - start < 40


def test_no_rows(spark):
    assert urls.judge(pages(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    assert urls.mine(labelled(spark, [(["a"], True)]).where("url IS NULL")).where(F.lit(True)).count() == 0
