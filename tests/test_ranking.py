import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of
from tidemark.operators.ranking import tile_starts, with_ntile


def test_tile_starts():
    assert tile_starts(10, 5) == [2, 4, 6, 8]
    assert tile_starts(12, 5) == [3, 6, 8, 10]
    assert tile_starts(3, 5) == [1, 2]
    assert tile_starts(0, 5) == []


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 1003])
@pytest.mark.parametrize("distinct", [1, 3, 100000])
def test_matches_the_window_function(spark, n, distinct):
    # seven in ten rows share the lowest value
    score = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") * 7919 % distinct)
    frame = spark.range(n, numPartitions=3).select(F.col("id").alias("uid"), score.alias("x"))
    got = with_ntile(frame, ["x", "uid"], 5, "tile")
    want = frame.withColumn("tile", F.ntile(5).over(Window.orderBy("x", "uid")))
    assert sorted(got.collect()) == sorted(want.collect())


def test_needs_no_shuffle_of_the_scored_frame(spark):
    frame = spark.range(1000).select(F.col("id").alias("uid"), (F.col("id") % 7).alias("x"))
    plan = plan_of(with_ntile(frame, ["x", "uid"], 5, "tile"))
    assert "Exchange" not in plan and "Window" not in plan
