"""Deep pages and map boxes: same rows as the plain query, fewer files read."""

import random

import pytest
from pyspark.sql import functions as F

from lodgetrail.operators import filters
from lodgetrail.plans.paging import MapIndex, RankIndex, morton


def files_read(df):
    """Files a query without shuffle opened, from its scan's metrics."""
    df.collect()
    todo, files = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        elif plan.metrics().contains("numFiles"):
            files += plan.metrics().get("numFiles").get().value()
        else:
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
    return files


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(40)]), rng.choice("abc"), i % 11 == 0) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "id long, price long, kind string, rare boolean").repartition(5)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    return RankIndex.build(table[1], [F.col("price").desc_nulls_last(), F.col("id").desc()], str(tmp_path_factory.mktemp("rank")), rows_per_range=250)


def in_order(rows):
    return [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), -r[0]))]


@pytest.mark.parametrize("limit,offset", [(50, 0), (50, 225), (250, 1000), (1, 3999), (100, 3950), (10, 9000)])
def test_pages_equal_sorting_all(table, index, limit, offset):
    page = index.page(limit, offset)
    assert [r.id for r in page.collect()] == in_order(table[0])[offset : offset + limit]
    assert page.columns == ["id", "price", "kind", "rare", "place"]


def test_a_deep_page_reads_two_ranges_at_most(index):
    assert files_read(index.page(50, 3325)) == 1
    assert files_read(index.page(50, 3225)) == 2


@pytest.mark.parametrize("condition,keep", [("kind = 'a'", lambda r: r[2] == "a"), ("rare", lambda r: r[3]), ("kind = 'z'", lambda r: False), ("price IS NULL", lambda r: r[1] is None)])
def test_conditions(table, index, condition, keep):
    want = in_order([r for r in table[0] if keep(r)])
    for limit, offset in ((20, 0), (20, 90), (300, 31), (5, len(want) - 2 if want else 3), (5, 5000)):
        assert [r.id for r in index.page(limit, offset, F.expr(condition)).collect()] == want[offset : offset + limit]
    # Page after page, every row comes once.
    seen, place = [], 0
    while rows := index.page_after(place, 97, F.expr(condition)).collect():
        seen += [r.id for r in rows]
        place = rows[-1].place
    assert seen == want


def test_continuing_without_a_condition(table, index):
    want = in_order(table[0])
    assert [r.id for r in index.page_after(240, 20).collect()] == want[240:260]
    assert [r.id for r in index.page_after(3990, 20).collect()] == want[3990:]
    assert index.page_after(4000, 20).count() == 0


def test_empty_index(spark, tmp_path):
    empty = RankIndex.build(spark.range(0), [F.col("id").asc()], str(tmp_path / "e"))
    assert empty.page(10).count() == 0 and empty.page(10, 0, F.col("id") > 1).count() == 0 and empty.page_after(0, 5).count() == 0
    with pytest.raises(ValueError):
        empty.page(0)


@pytest.fixture(scope="module")
def map_rows(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, rng.gauss(13.7, 0.01), rng.gauss(100.5, 0.01)) for i in range(1000)]  # one busy city
    rows += [(i, rng.uniform(5, 20), rng.uniform(97, 106)) for i in range(1000, 3000)]
    rows += [(3000, None, 100.0), (3001, 13.0, float("nan")), (3002, 90.0, 180.0), (3003, -90.0, -180.0), (3004, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double").withColumn("part", F.lit("x")).repartition(4)
    return df, MapIndex.build(df, str(tmp_path_factory.mktemp("map")), rows_per_part=100)


@pytest.mark.parametrize("box", [(-90, 90, -180, 180), (13.69, 13.71, 100.49, 100.51), (8, 9, 98, 99), (0, 0, 0, 0), (89, 90, 179, 180), (30, 40, 10, 20)])
def test_boxes_equal_the_plain_filter(map_rows, box):
    df, index = map_rows
    want = df.filter(filters.located() & filters.in_viewport(*box))
    assert sorted(r.id for r in index.viewport(*box).collect()) == sorted(r.id for r in want.collect())


def test_files_read_fall_with_the_box(map_rows):
    _, index = map_rows
    whole, city, spot = (files_read(index.viewport(*b)) for b in ((-90, 90, -180, 180), (13.6, 13.8, 100.4, 100.6), (8, 8.5, 98, 98.5)))
    assert whole == 31 and city <= 18 and 1 <= spot <= 4
    assert files_read(index.viewport(30, 40, 10, 20)) == 0


def test_near_points_have_near_cells(spark):
    got = spark.sql("SELECT 13.7D lat, 100.5D lon UNION ALL SELECT 13.7001D, 100.5001D UNION ALL SELECT -40D, 20D").select(morton(F.col("lat"), F.col("lon")).alias("m")).collect()
    a, b, c = (r.m for r in got)
    assert abs(a - b) < abs(a - c) and len({a, c}) == 2
