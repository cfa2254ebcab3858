import hashlib
import zlib

import pytest
from helpers_llm import SCHEMA
from pyspark.sql import functions as F

from lodgetrail.llm import manifest as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree(leaves):
    """The root, and each leaf's siblings by level as (before, after)."""
    paths, level, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, over = [], []
        for k in range(0, len(level), 16):
            run = level[k : k + 16]
            for s in range(len(run)):
                for i in owners[k + s]:
                    paths[i].append(("".join(run[:s]), "".join(run[s + 1 :])))
            up.append(h(*run))
            over.append([i for o in owners[k : k + 16] for i in o])
        level, owners = up, over
    return level[0], paths


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof) of each row, in any order."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below[s] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([below[s][1] for s in names])
    out = []
    for s, more in zip(names, above, strict=True):
        own, subroot, paths = below[s]
        for r, path in zip(own, paths, strict=True):
            out.append((r[0], leaf(r), subroot, root, h(*(a + b for a, b in path + more))))
    return out


def rows_of(n, source):
    return [(i, f"Text {i} é", "en", source(i), i % 7) for i in range(n)]


CASES = {
    "one row": [(1, "a", "en", "s", 1)],
    "one source of 16": rows_of(16, lambda i: "s"),
    "one source of 17": rows_of(17, lambda i: "s"),
    "three levels": rows_of(300, lambda i: "s"),
    "a hot source": rows_of(290, lambda i: "hot" if i % 3 else f"é{i % 40:02}"),
    "many sources": rows_of(40, lambda i: f"s{i}"),
    "nulls, repeats, ties": [(None, "a", None, None, None), (None, "a", None, None, None), (1, None, "", "", 0), (1, "", None, "", 0), (2, "x", "en", None, 3), (2, "x", "en", None, 3), (3, "-", "-", "-", 1), (0, "y", "en", "z", None)],
    "a long text": [(i, "Wörd " * 100_000, "en", "a", 1) for i in range(2)],
}


@pytest.mark.parametrize("name", CASES)
def test_equal_brute_force(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = m.manifest(docs)
    p = F.col("path")
    got = found.proofs.select("doc_id", "leaf", "subroot", F.lit(found.root), m.siblings_digest(p), m.fold(F.col("leaf"), p).alias("folded")).collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(by_hand(rows), key=key)
    assert {r.folded for r in got} == {found.root}
    per_source = {r.source: (r["rows"], r.subroot) for r in found.sources.collect()}
    assert {s: n for s, (n, _) in per_source.items()} == {s: sum(r[3] == s for r in rows) for s in {r[3] for r in rows}}


def test_tampering_is_found(spark):
    rows = rows_of(120, lambda i: f"s{i % 2}")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    other = m.leaf_of([F.upper("text") if f == "text" else F.col(f) for f in m.FIELDS])
    found = m.manifest(docs, carry={"other": F.when(F.col("doc_id") % 5 == 0, other)})
    folded = found.proofs.select("doc_id", m.fold(F.coalesce("other", "leaf"), F.col("path")).alias("r")).collect()
    assert all((r.r == found.root) == (r.doc_id % 5 != 0) for r in folded)


def test_other_columns_and_order_dont_matter(spark):
    rows = rows_of(50, lambda i: f"s{i % 3}")
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = docs.repartition(5).withColumns({c: F.lit(7) for c in ("grp", "i", "n", "digest", "path", "place", "s0")})
    assert m.manifest(docs).root == m.manifest(odd).root


def test_an_empty_table_has_no_root(spark):
    found = m.manifest(spark.createDataFrame([], SCHEMA))
    assert found.root is None and found.proofs.count() == 0 and found.sources.count() == 0


def test_the_query_touches_a_fifth(spark, tmp_path):
    from lodgetrail.llm.queries import QUERIES

    rows = [(i, "ABC" if i % 2 else "abc", "en", "s", 3) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op12_manifest"](spark, str(tmp_path)).collect():
        touched = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2 == 1
        assert r.verified == (not touched) and (r.folded_root == r.root) == r.verified
