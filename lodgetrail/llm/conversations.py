"""Repairing the structure of conversations at the least cost, by depth-first branch-and-bound.

A conversation is an optional system turn and then user and assistant in turn, ``(s?(ua)+)?``. Turns may be kept, given
another role, deleted, or put in; the cheapest edits count, and of equally cheap ones those whose initials are least. The
search walks an explicit stack of prefixes. Suffix lower bounds (least cost of what remains, per place and grammar
state) cut a prefix that can't reach the incumbent (cost, audit) any more; a dominance table per node drops every prefix that
comes to it dearer or with a greater audit. When the stack is empty, the incumbent is proved.

What decides is one code per turn, so texts stay where they are until the repaired ones are written: short rows are sorted
by conversation and turn over ranges, and each task reads its ranges in order. A conversation that crosses tasks is
solved in pieces, for every pair of grammar states at its ends, and the pieces are chained; no task ever needs all turns
of one conversation in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetrail.llm.common import small_batches
from lodgetrail.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns solved at once; longer conversations are chained.
PIECE = 256

# A turn's code: four times the class of its role's initial, plus its first fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
# What the grammar has seen: nothing, a system turn, a user's turn, an assistant's turn.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES, ENDS = (START, AFTER_S, AFTER_U, AFTER_A), (START, AFTER_A)
#: State after the one role that may be put in or given.
_PUT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: State after a turn of a class, where the grammar allows it.
_TAKE = ({SYSTEM: AFTER_S, USER: AFTER_U}, {USER: AFTER_U}, {ASSISTANT: AFTER_A}, {USER: AFTER_U})
_NEVER = 1 << 60


def _edits(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """The edits of a turn in a state: initial, cost and state after it."""
    yield "D", DELETE, state
    role, fault = divmod(code, 4)
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT_OFF else 0
    if role in _TAKE[state]:
        yield "K", KEEP + more, _TAKE[state][role]
    yield "R", REROLE + more, _PUT[state]


_EDITS = {(code, state): tuple(_edits(code, state)) for code in range(16) for state in STATES}


def suffix_bounds(codes: bytes, ends: tuple[int, ...]) -> list[list[int]]:
    """The least cost from each place and state to one of ``ends`` behind the last turn."""

    def with_inserts(row: list[int]) -> list[int]:
        for _ in range(2):
            row = [min(row[q], INSERT + row[_PUT[q]]) for q in STATES]
        return row

    bounds = [with_inserts([0 if q in ends else _NEVER for q in STATES])]
    for code in reversed(codes):
        after = bounds[-1]
        bounds.append(with_inserts([min(cost + after[to] for _, cost, to in _EDITS[code, q]) for q in STATES]))
    return bounds[::-1]


def search(codes: bytes, start: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """The cheapest edits of some turns from a grammar state to one of ``ends``: cost, audit (the least), state reached.

    Branch-and-bound over an explicit stack; None if no edits lead there.
    """
    bounds = suffix_bounds(codes, ends)
    best: tuple[int, str, int] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        floor = cost + bounds[at][state]
        if floor >= _NEVER:
            continue
        if best is not None and (floor, audit) > (best[0], best[1][: len(audit)]):
            continue
        node = (at, state)
        if node in reached and reached[node] <= (cost, audit):
            continue
        reached[node] = (cost, audit)
        if at == len(codes) and state in ends and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, state)
        steps = [(cost + INSERT, "I", at, _PUT[state])]
        if at < len(codes):
            steps += [(cost + c, letter, at + 1, to) for letter, c, to in _EDITS[codes[at], state]]
        # The most promising child is popped first, of equals the one with the least initial.
        steps.sort(key=lambda s: (s[0] + bounds[s[2]][s[3]], s[1]), reverse=True)
        stack.extend((i, q, c, audit + letter) for c, letter, i, q in steps)
    return best


@lru_cache(maxsize=100_000)
def _solved(codes: bytes) -> tuple[int, str, int]:
    """The repair of a whole short conversation."""
    return search(codes, START, ENDS)


def piece_table(codes: bytes) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits of a piece of a conversation from each state to each state."""
    found = {}
    for a in STATES:
        for b in STATES:
            best = search(codes, a, (b,))
            if best is not None:
                found[a, b] = best[:2]
    return found


def chain(first: dict, second: dict) -> dict[tuple[int, int], tuple[int, str]]:
    """The table of two pieces one behind the other.

    Of two prefixes with equal cost neither goes on from the other (what they differ by would cost), so the lesser one
    stays the lesser whatever follows.
    """
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for (a, b), (cost, audit) in first.items():
        for (c, d), (more, rest) in second.items():
            if b == c and ((a, d) not in out or (cost + more, audit + rest) < out[a, d]):
                out[a, d] = (cost + more, audit + rest)
    return out


def table_of(codes: bytes) -> dict[tuple[int, int], tuple[int, str]]:
    """The table of turns of any number, chained in pairs, pairs of pairs and so on."""
    tables = [piece_table(codes[k : k + PIECE]) for k in range(0, len(codes), PIECE)] or [piece_table(b"")]
    while len(tables) > 1:
        tables = [chain(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return tables[0]


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _initial(role: F.Column) -> F.Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


_PART = "key string, part long, counts array<long>, low long, high long, turns long, first int, last int, paths array<struct<a:int,b:int,cost:long,audit:string>>"
_VERDICT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (``key``, ``turn``, ``code``, ``copies``) to one row per conversation and task."""
    task = TaskContext.get().partitionId() << 32
    out: list[tuple] = []
    key, codes, low, high, turns, runs = None, bytearray(), None, None, 0, 0

    def close(whole: bool) -> None:
        found = bytes(codes)
        faults = [0, 0, 0, 0]
        roles = bytes(c >> 2 for c in found)
        for c in set(found):
            faults[c & 3] += found.count(c)
        illegal = sum(not _legal(a, b) for a, b in zip(roles, roles[1:], strict=False))
        if whole and len(found) <= PIECE:
            cost, audit, end = _solved(found)
            paths = [{"a": START, "b": end, "cost": cost, "audit": audit}]
        else:
            paths = [{"a": a, "b": b, "cost": c, "audit": t} for (a, b), (c, t) in table_of(found).items()]
        ends = (roles[0], roles[-1]) if roles else (None, None)
        out.append((key, task + runs, [*faults[1:], illegal], low, high, turns, *ends, paths))

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                 pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))
        names = ["key", "part", "counts", "low", "high", "turns", "first", "last", "paths"]
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
        out.clear()
        return made

    for batch in batches:
        for own, turn, code, copies in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if own != key:
                if key is not None:
                    close(whole=runs > 1)
                key, codes, low, high, turns, runs = own, bytearray(), None, None, 0, runs + 1
            if copies:
                codes.append(code)
                if copies > 1:  # equal turns: all but the first repeat it, unless they are blank
                    codes.extend(bytes([code if code & 3 in (BLANK, DUPLICATE) else (code & ~3) | DUPLICATE]) * (copies - 1))
                if turn is not None and turn != high:
                    low, high, turns = (turn if low is None else low), turn, turns + 1
        yield batch_of()
    if key is not None:
        close(whole=False)
        yield batch_of()


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_read_parts`, sorted by conversation and part, to one verdict per conversation."""
    held: dict | None = None

    def start(r: dict) -> dict:
        return {"key": r["key"], "counts": [0] * 4, "low": None, "high": None, "turns": 0, "last": None, "ways": {START: (0, "")}}

    def add(r: dict) -> None:
        held["counts"] = [x + y for x, y in zip(held["counts"], r["counts"], strict=True)]
        if r["first"] is not None:
            if held["last"] is not None and not _legal(held["last"], r["first"]):
                held["counts"][3] += 1
            held["last"] = r["last"]
        if r["low"] is not None:
            held["turns"] += r["turns"] - (held["high"] == r["low"])
            held["low"], held["high"] = (r["low"] if held["low"] is None else held["low"]), r["high"]
        ways: dict[int, tuple[int, str]] = {}
        for p in r["paths"]:
            if p["a"] in held["ways"]:
                cost, audit = held["ways"][p["a"]]
                way = (cost + p["cost"], audit + p["audit"])
                if p["b"] not in ways or way < ways[p["b"]]:
                    ways[p["b"]] = way
        held["ways"] = ways

    def row() -> tuple:
        gaps = 0 if held["low"] is None else held["high"] - held["low"] + 1 - held["turns"]
        cost, audit = min(held["ways"][q] for q in ENDS if q in held["ways"])
        return (held["key"], gaps, *held["counts"], cost, audit)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), *[pa.int64()] * 6, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", *_VERDICT, "audit"])

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held is None or r["key"] != held["key"]:
                if held is not None:
                    out.append(row())
                held = start(r)
            add(r)
        yield batch_of(out)
    if held is not None:
        yield batch_of([row()])


class _Repair:
    """One conversation's repaired turns, taken in order and hashed."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _put(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.any else b"") + role + b":")
        self.hash.update(text)
        self.any = True

    def _given(self) -> bytes:
        self.state = _PUT[self.state]
        return b"user" if self.state == AFTER_U else b"assistant"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(self._given(), b"")
            self.at += 1

    def turn(self, role: bytes, text: bytes) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _TAKE[self.state][{b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}[role[:1]]]
            self._put(role, text)
        elif edit == "R":
            self._put(self._given(), text)


def _write_repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's verdict followed by its turns, in order, to the verdict with the digest of the repair."""
    held, repair = None, None

    def row() -> tuple:
        repair.inserts()
        return (*held, repair.hash.hexdigest())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), *[pa.int64()] * 6, pa.string(), pa.string())
        names = ["key", *_VERDICT, "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    for batch in batches:
        out = []
        roles, bodies = (batch.column(n).cast(pa.binary()).to_pylist() for n in ("role", "body"))
        verdicts = [batch.column(n).to_pylist() for n in _VERDICT]
        for k, (key, kind, copies) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("key", "kind", "copies")), strict=True)):
            if kind == 0:
                if held is not None:
                    out.append(row())
                repair = _Repair(bodies[k].decode())
                held = (key, *(v[k] for v in verdicts), repair.audit)
            else:
                for _ in range(copies):
                    repair.turn(roles[k], bodies[k])
        yield batch_of(out)
    if held is not None:
        yield batch_of([row()])


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """Faults and the cheapest repair of every conversation.

    Turns are taken by ``turn`` (null first), then role, then the SHA-256 of the text. ``copies`` names a column of how often each row
    stands there (null or 0: not at all; its conversation is still answered). A null key is a conversation of its own; a null role or
    text counts as one space, so such a text is blank. A role's first character decides what it is. Equal rows are one
    row with more copies. Returns ``key``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256`` (of the repaired ``role:text``, joined by line feeds). A conversation without turns has zeros, an
    empty audit and the hash of the empty string; an empty table gives an empty table; other columns are not looked at.
    """
    small_batches(rows.sparkSession)
    own = rows.select(
        F.coalesce(F.concat(F.lit("="), rows[key].cast("string")), F.lit("-")).alias("key"), rows[turn].cast("long").alias("turn"),
        F.coalesce(rows[role], F.lit(" ")).alias("role"), F.coalesce(rows[text], F.lit(" ")).alias("body"),
        (F.coalesce(rows[copies], F.lit(0)) if copies else F.lit(1)).cast("long").alias("copies"))
    named = own.withColumn("h", F.unhex(F.sha2("body", 256)))

    last = F.regexp_extract("body", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)
    turns = named.select("key", "turn", "role", "h", fault.alias("fault"), "copies").groupBy("key", "turn", "role", "h").agg(
        F.first("fault").alias("fault"), F.sum("copies").alias("copies"))
    turns = stage(turns, "turns")
    # Text seen earlier under the role: all turns but the first that is there.
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = turns.where("copies > 0").groupBy("key", "role", "h").agg(F.min(place).alias("first"))
    marked = turns.join(first, ["key", "role", "h"], "left")
    again = (F.col("fault") != BLANK) & F.col("first").isNotNull() & (F.col("first") != place)
    code = (4 * _initial(F.col("role")) + F.when(again, DUPLICATE).otherwise(F.col("fault"))).cast("int")
    coded = stage(marked.select("key", "turn", code.alias("code"), "copies", "role", "h"), "turn-codes")
    order = ["key", "turn", "role", "h"]
    parts = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "code", "copies").mapInArrow(_read_parts, _PART)
    joined = parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(
        _join_parts, "key string, " + ", ".join(f"{c} long" for c in _VERDICT) + ", audit string")

    empty = F.lit(None)
    heads = joined.select(
        "key", F.lit(0).alias("kind"), empty.cast("long").alias("turn"), F.lit("").alias("role"), empty.cast("binary").alias("h"),
        F.col("audit").alias("body"), F.lit(0).cast("long").alias("copies"), *_VERDICT)
    texts = named.where("copies > 0").select("key", F.lit(1).alias("kind"), "turn", "role", "h", "body", "copies", *(empty.cast("long").alias(c) for c in _VERDICT))
    both = stage(heads, "verdicts").unionByName(texts)
    done = both.repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "h").drop("h", "turn").mapInArrow(
        _write_repairs, "key string, " + ", ".join(f"{c} long" for c in _VERDICT) + ", audit string, repaired_sha256 string")
    back = F.when(F.col("key") != "-", F.substr("key", F.lit(2))).cast(rows.schema[key].dataType)
    return done.select(back.alias(key), *_VERDICT, "audit", "repaired_sha256")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", into: str = "copies") -> DataFrame:
    """Planted faults, by the CRC-32 of ``key:turn`` (null: one space) modulo 20.

    0 drops a row (no copies), 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 makes two
    copies, 4 sets the role to user; others stay. A column named ``into`` is replaced; the others pass through.
    """
    shown = [F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in (key, turn)]
    what = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    return rows.withColumns({
        into: F.when(what == 0, 0).when(what == 3, 2).otherwise(1).cast("long"),
        text: F.when(what == 1, F.lit("")).when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)),
        role: F.when(what == 4, F.lit("user")).otherwise(F.col(role)),
    })
