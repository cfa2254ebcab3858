import pytest
from pyspark.sql import functions as F

from lodgetrail.llm.common import smallest


@pytest.mark.parametrize("n,k,distinct", [(0, 5, 1), (3, 5, 3), (5000, 20, 5000), (5000, 2000, 5000), (5000, 300, 7), (5000, 10, 1)])
def test_smallest_equals_sorting_all(spark, n, k, distinct):
    df = spark.range(n).select("id", (F.col("id") % distinct).alias("kind")).repartition(4)
    by = F.xxhash64("kind")
    want = [r.id for r in df.withColumn("h", by).orderBy("h", "id").limit(k).collect()]
    assert [r.id for r in smallest(df, by, ["id"], k).collect()] == want
