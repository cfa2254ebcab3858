"""Small tables and brute-force rules the operator tests share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=SCHEMA):
    """A documents table; ids from 0 unless pairs are given."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, schema).repartition(3)


def near_copies(seed, groups=6, copies=9, words=60):
    """Groups of texts with a few changed words each, and unrelated ones."""
    rng = random.Random(seed)
    fresh = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(groups):
        base = [fresh() for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                own[rng.randrange(words)] = fresh()
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def components(nodes, links):
    """The smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_components(table, threshold=85):
    sets = {d: shingles(t) for d, t in table}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, components(sets, links)


def without_repeats(table, window=20):
    """Kept words of each document by the rule, window by window."""
    first, words = {}, {d: WORD.findall(t or "") for d, t in table}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    kept = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone |= set(range(i, i + window))
        kept[d] = [x for k, x in enumerate(w) if k not in gone]
    return words, kept
