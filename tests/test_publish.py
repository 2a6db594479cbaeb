import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.sources import publish


def tables(spark, value):
    one = spark.createDataFrame([(value, "a"), (None, "b")], "n int, name string")
    return {"one": one, "two": one.groupBy("name").agg(F.count("n").alias("known"))}


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_versions_follow_one_another(spark, tmp_path, fmt):
    path = str(tmp_path)
    assert [publish.publish(tables(spark, k), path, fmt) for k in (1, 2)] == [1, 2]
    found = publish.read_published(spark, path)
    assert sorted(rows(found["one"]), key=str) == [{"n": 2, "name": "a"}, {"n": None, "name": "b"}]
    assert found["two"].columns == ["name", "known"]
    assert {r["n"] for r in rows(publish.read_published(spark, path, 1)["one"])} == {1, None}


def test_a_run_that_fails_half_way_leaves_the_earlier_result(spark, tmp_path):
    path = str(tmp_path)
    publish.publish(tables(spark, 1), path)
    broken = tables(spark, 2)
    broken["two"] = broken["two"].withColumn("known", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        publish.publish(broken, path)
    found = publish.read_published(spark, path)
    assert {r["n"] for r in rows(found["one"])} == {1, None} and found["two"].count() == 2
    assert publish.publish(tables(spark, 3), path) == 2


def test_the_slower_of_two_runs_publishes_nothing(spark, tmp_path):
    path = str(tmp_path)
    publish.publish(tables(spark, 1), path)
    number, _ = publish.latest(spark, path)
    publish.put_manifest(spark, path, {"tables": {}}, number)
    with pytest.raises(publish.Outrun):
        publish.put_manifest(spark, path, {"tables": {"late": {}}}, number)
    assert publish.latest(spark, path) == (2, {"tables": {}})


def test_old_versions_can_go(spark, tmp_path):
    path = str(tmp_path)
    for k in range(4):
        publish.publish(tables(spark, k), path)
    assert publish.drop_versions(spark, path, keep=1) == [1, 2, 3]
    assert {r["n"] for r in rows(publish.read_published(spark, path)["one"])} == {3, None}
    assert sorted(p.name for p in tmp_path.iterdir() if "-" in p.name)[0].startswith("0000000004-")


def test_nothing_published_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, str(tmp_path))
    with pytest.raises(ValueError):
        publish.publish({}, str(tmp_path))
