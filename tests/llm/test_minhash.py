import numpy as np
import pytest
from helpers_llm import components, docs, near_components, near_copies
from pyspark.sql import functions as F

from lodgetrail.llm import graph, minhash

EDGES = ["", None, "one two", "One TWO", " \t\n", "a b c d e", "a b c d e", "A B C D E f", "x " * 5000, "É b c d e", "é b c d e"]


def check(spark, texts):
    table = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    n, component = near_components(table)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts).withColumnRenamed("lang", "doc").withColumnRenamed("source", "n")).collect()}
    assert set(got) == set(n)
    for d in n:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (n[d], component[d], component[d] == d), d


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, seed):
    check(spark, near_copies(seed) + EDGES)


def test_members_that_only_link_beside_the_hub(spark):
    """The smallest member of the buckets is far from two texts that are close to each other."""
    base = [f"w{i}" for i in range(120)]
    near = lambda *at: " ".join("new%d" % k if k in at else w for k, w in enumerate(base))
    check(spark, [near(), near(10, 30, 50, 70, 90), near(10, 30, 50, 70, 90, 110), near(5, 25, 45, 65, 85, 105), near(5, 25, 45, 65, 85, 105, 118)])


def test_large_stars_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STAR", 3)
    check(spark, near_copies(7, groups=2, copies=20))


def test_no_rows(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_min_and_max_come_from_one_evaluation():
    found = np.unique(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    assert len(minhash.band_keys(found)) == minhash.BANDS == 24
    assert (minhash.band_keys(found) == minhash.band_keys(found[::-1].copy())).all()


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 3), (3, 5), (9, 8), (8, 5), (2, 1)]])
def test_graph_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.component for r in graph.components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, [x for x in links if x[0] != x[1]])
    assert graph.components(df).groupBy("node").count().where(F.col("count") > 1).count() == 0
