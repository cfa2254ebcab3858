from pathlib import Path

import numpy as np
import pytest
from helpers_llm import components

from lodgetrail.llm import embeddings
from lodgetrail.session import work_root

NAN, INF = float("nan"), float("inf")


def table(spark, vectors, kind="double"):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, unit string").repartition(3)


def brute(vectors, threshold=0.9):
    fine = {i: np.array(v, float) for i, v in enumerate(vectors) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    width = max((len(v) for v in fine.values()), default=0)
    unit = {i: np.pad(v, (0, width - len(v))) for i, v in fine.items()}
    unit = {i: v / np.abs(v).max() for i, v in unit.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= threshold]
    counts = dict.fromkeys(range(len(vectors)), 0)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return counts, components(range(len(vectors)), links)


def check(spark, vectors, kind="double"):
    counts, component = brute(vectors)
    rows = embeddings.near_duplicates(table(spark, vectors, kind)).collect()
    assert len(rows) == len(vectors)
    for r in rows:
        assert (r.n_links, r.component_id, r.kept) == (counts[r.vec_id], component[r.vec_id], component[r.vec_id] == r.vec_id), r.vec_id


def clusters(seed, dims, n=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = [c + rng.normal(size=dims) * s for c in centres for s in rng.choice((0.1, 0.3, 0.5), n // 6)]
    return [v.tolist() for v in out] + [out[0].tolist(), out[0].tolist(), out[7].tolist()]


@pytest.mark.parametrize("tile,dims", [(2048, 64), (16, 64), (7, 40), (16, 3)])
def test_links_equal_brute_force(spark, monkeypatch, tile, dims):
    monkeypatch.setattr(embeddings, "TILE", tile)
    check(spark, clusters(tile + dims, dims))


def test_odd_vectors_link_with_nothing(spark):
    check(spark, [None, [], [0, 0, 0], [1, None, 2], [NAN, 1, 1], [INF, 1, 1], [-INF, 0, 0], [1, 2, 3], [2, 4, 6], [1e300, 2e300, 3e300], [1e-300, 2e-300, 3e-300], [1, 2], [1, 2, 0], [-1, -2, -3]])


def test_all_equal_and_no_rows(spark):
    check(spark, [[1.0, 1.0]] * 9)
    check(spark, [[0.0]] * 3)
    assert embeddings.near_duplicates(table(spark, [])).count() == 0


def test_one_usable_vector(spark):
    check(spark, [None, [0, 0, 0], [1, 2, 3], [NAN, 1, 1], []])
    check(spark, [[1, 2]])


def test_single_precision_input(spark):
    check(spark, [np.float32(v).tolist() for v in clusters(3, 20)], "float")


def test_stopping_early_loses_no_pair():
    rng = np.random.default_rng(2)
    a, b = (embeddings.unit(rng.normal(size=(300, 64))) for _ in range(2))
    b[:40] = embeddings.unit(a[:40] + rng.normal(size=(40, 64)) * 0.06)
    axes, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    i, j = embeddings._linked(a, b, axes, 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.9))))


def on_disk(spark):
    """The files Spark has in its work folder and its own folders, with their sizes."""
    own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: f.stat().st_size for top in (work_root(spark), *own) for f in Path(top).rglob("*") if f.is_file()}


def test_disk_grows_with_the_vectors_not_with_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng, used = np.random.default_rng(8), {}
    for n in (1000, 4000):
        df = table(spark, rng.normal(size=(n, 64)).astype(np.float32).tolist(), "float")
        df.count()
        before = on_disk(spark)
        assert len(embeddings.near_duplicates(df).collect()) == n
        used[n] = sum(size for f, size in on_disk(spark).items() if f not in before)
    assert used[4000] < 5 * used[1000]
    assert used[4000] < 4 * 4000 * 64 * 4


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_parts_far_apart_lose_no_pair(monkeypatch, parts):
    monkeypatch.setattr(embeddings, "_ROWS", parts)
    rng = np.random.default_rng(parts)
    a = embeddings.unit(np.repeat(rng.normal(size=(5, 64)), 30, axis=0) + rng.normal(size=(150, 64)) * 0.3)
    b = embeddings.unit(a[::-1] + rng.normal(size=(150, 64)) * 0.03)
    axes, _ = np.linalg.qr(np.linalg.eigh(a.T @ a)[1][:, ::-1])
    order = np.argsort(a @ axes[:, 0]), np.argsort(b @ axes[:, 0])
    a, b = a[order[0]], b[order[1]]
    one, other = (embeddings.Tile(np.arange(150), np.ones(150, dtype=int), x, axes) for x in (a, b))
    assert parts == 64 or not embeddings._near(one, other, 0.9).all()
    i, j = embeddings._pairs(one, other, 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.9))))


def test_copies_and_links_across_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 4)
    monkeypatch.setattr(embeddings, "BLOCK_TILES", 2)
    with embeddings._setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "5"):
        vectors = clusters(11, 40)
        check(spark, vectors + [vectors[3]] * 40 + [[2 * x for x in vectors[9]]] * 9)


def test_merged_findings():
    ids, links, roots = embeddings._merged([([5, 7], [1, 1], [5, 5]), ([7, 9], [2, 2], [7, 7]), ([1, 3], [1, 1], [1, 1])])
    assert (ids.tolist(), links.tolist(), roots.tolist()) == ([1, 3, 5, 7, 9], [1, 1, 1, 3, 2], [1, 1, 5, 5, 5])
