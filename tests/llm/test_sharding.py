import random
import zlib

import pytest
from helpers_llm import docs

from lodgetrail.llm import sharding


def smallest(sizes, shards):
    """The minimax capacity over contiguous ranges, by dynamic programming."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min([best[j]] + [max(best[i], sums[j] - sums[i]) for i in range(j)]) for j in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed,shards,trials", [(1, 4, 4096), (2, 16, 3), (3, 3, 2), (4, 5, 4096)])
def test_capacity_is_minimax(spark, monkeypatch, seed, shards, trials):
    monkeypatch.setattr(sharding, "TRIALS", trials)
    rng = random.Random(seed)
    sizes = [rng.choice((1, 2, 9, 30, 400)) for _ in range(rng.randrange(3, 40))]
    groups = spark.createDataFrame([(f"{i:04d}", s) for i, s in enumerate(sizes)], "group string, bytes long").repartition(3)
    cut = sharding.partition(groups, shards)
    assert cut.capacity == smallest(sizes, shards)
    bounds = [int(g) + 1 for g in cut.last_groups]
    loads = [sum(sizes[a:b]) for a, b in zip([0, *bounds], [*bounds, len(sizes)])]
    assert len(loads) <= shards and max(loads) <= cut.capacity and sum(loads) == sum(sizes)


def test_rows_slots_and_groups(spark):
    rng = random.Random(5)
    texts = [None, "", "é" * 10, "x" * 5000] + ["hot text"] * 60 + ["".join(rng.choice("abc ") for _ in range(rng.randrange(200))) for _ in range(90)]
    table = docs(spark, texts).withColumnRenamed("lang", "shard").withColumnRenamed("source", "size")
    rows = sharding.shard(table, 4).collect()
    assert len(rows) == len(texts)
    shard_of = {}
    for r in rows:
        blob = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(blob) + 1, zlib.crc32(blob), "bytes", None)
        assert shard_of.setdefault(blob, r.shard) == r.shard
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert {r.shard for r in rows} <= set(range(4))


def test_a_large_group_leaves_the_rest_even(spark):
    texts = ["y" * 3000] * 10 + [f"{i} " + "z" * 97 for i in range(300)]
    rows = sharding.shard(docs(spark, texts), 8).collect()
    loads = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert max(loads) == 30010 and min(loads) > 0


def test_one_group_and_no_rows(spark):
    assert {r.shard for r in sharding.shard(docs(spark, ["a", "a"]), 16).collect()} <= set(range(16))
    assert sharding.shard(docs(spark, []), 16).count() == 0
