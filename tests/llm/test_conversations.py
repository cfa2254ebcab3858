import hashlib
import heapq
import random
import re
import zlib

import pytest

from lodgetrail.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(turns):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        kind = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(turns):
    """Cost, audit and repaired turns: uniform-cost search over whole repaired conversations."""
    kinds = faults(turns)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, made = heapq.heappop(heap)
        state = "start" if not shape else shape[-1]
        if (i, state, shape[:1] == "s") in done:
            continue
        done.add((i, state, shape[:1] == "s"))
        if i == len(turns) and state in ("start", "a"):
            return cost, audit, list(made)
        put = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[put]
        heapq.heappush(heap, (cost + 3, audit + "I", i, shape + put, (*made, (name, ""))))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, shape, made))
            if kinds[i] in ("", "truncated"):
                more = 3 if kinds[i] else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, shape + put, (*made, (name, text))))
                if role[:1] and role[:1] == (put if state != "start" else role[:1] if role[:1] in "su" else "") :
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, shape + role[:1], (*made, (role, text))))
    raise AssertionError


def by_hand(turns):
    """Verdict on turns as (turn, role, text), in order."""
    pairs = [(r, t) for _, r, t in turns]
    kinds = faults(pairs)
    known = [n for n, _, _ in turns if n is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, made = cheapest(pairs)
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    """Rows (conv, turn, role, text) as the operator takes them."""
    clean = [(n, " " if r is None else r, " " if t is None else t) for _, n, r, t in rows]
    return sorted(clean, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))


def check(spark, rows, partitions=3):
    found = {r[0]: tuple(r[1:]) for r in c.repair(spark.createDataFrame(rows, SCHEMA).repartition(partitions)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(found) == set(groups)
    for k, own in groups.items():
        assert found[k] == by_hand(in_order(own)), own


def conversations(seed, n, roles, texts, most):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        turn = 0
        for _ in range(rng.randrange(1, most)):
            turn += rng.choice((0, 1, 1, 1, 2, 4))
            rows.append((k, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts)))
    return rows


def test_equal_brute_force(spark):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "uh"]
    texts = ["Hi.", "Yes!", "no end", "What?  \n", "", " \t", None, "é.", "5", "日本。", "Ok.", "Fine."]
    check(spark, conversations(1, 150, roles, texts, 12))


def test_long_conversations_cross_tasks_and_pieces(spark):
    rng = random.Random(2)
    rows = [(1, n, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"{n}.", f"{n}!", ""])) for n in range(1500)]
    rows += [(2, n, "user" if n % 2 == 0 else "assistant", f"{n}.") for n in range(700)]
    rows += conversations(3, 20, ["user", "assistant"], ["A.", "B.", "c"], 6)
    check(spark, [(k + 3 if i >= 2200 else k, *r) for i, (k, *r) in enumerate(rows)], 5)


def test_edges(spark):
    check(spark, [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, None, "user", "Hi."), (1, None, "assistant", "A."), (2, 5, "system", "S."),
                  (3, 1, "user", "x. " * 60_000), (3, 1, "user", "x. " * 60_000), (3, 1, "user", "x. " * 60_000), (4, 1, None, None), (5, 1, "user", "a\nb:c.")])
    assert c.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_copies_still_answer(spark):
    rows = [(1, 1, "user", "Hi.", 0), (2, 1, "user", "Hi.", 2), (2, 2, "assistant", "Yes.", None), (1, 9, "user", "x", None)]
    table = spark.createDataFrame(rows, SCHEMA + ", copies long")
    found = {r.conv_id: r for r in c.repair(table, copies="copies").collect()}
    assert tuple(found[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert tuple(found[2])[1:] == by_hand([(1, "user", "Hi."), (1, "user", "Hi.")])


def test_other_columns_pass_by(spark):
    from pyspark.sql import functions as F

    rows = [(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")]
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("key", "code", "h", "first", "fault", "kind", "body")})
    assert [r.audit for r in c.repair(odd).collect()] == ["KK"]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_chain_to_the_whole(seed):
    rng = random.Random(seed)
    for _ in range(150):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(12)))
        cut = rng.randrange(len(codes) + 1)
        whole = c.piece_table(codes)
        assert c.chain(c.piece_table(codes[:cut]), c.piece_table(codes[cut:])) == whole


def test_the_search_is_linear_on_ties():
    import time

    start = time.perf_counter()
    for code in (c.USER * 4, c.OTHER * 4, c.SYSTEM * 4, c.ASSISTANT * 4 + c.CUT_OFF):
        assert c.search(bytes([code]) * 2000, c.START, c.ENDS) is not None
    assert time.perf_counter() - start < 5


def test_damage_follows_the_rule(spark):
    rows = [(k, n, "assistant", "A. b! c?") for k in range(30) for n in range(4)] + [(None, 1, "x", "y."), (1, None, "x", "y.")]
    for r in c.damage(spark.createDataFrame(rows, SCHEMA)).collect():
        shown = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        z = zlib.crc32(shown.encode()) % 20
        was = "y." if r.role == "x" or shown in (" :1", "1: ") else "A. b! c?"
        assert r.copies == {0: 0, 3: 2}.get(z, 1)
        assert r.text == {1: "", 2: re.sub("[.!?]", "", was)}.get(z, was)
        assert (r.role == "user") == (z == 4)
