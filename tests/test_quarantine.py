import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.sources.quarantine import UNREADABLE, load_table
from tidemark.sources.tables import read_table

HEADER = "order_id,user_id,order_ts,gmv,rating,is_late,status\n"
LINES = [
    "1,10,2026-01-01 10:00:00,100.00,4.5,0,delivered",
    "2,10,2026-01-02 10:00:00,-5.00,4.5,0,delivered",
    "3,11,soon,100.00,4.5,0,delivered",
    "4,11,2026-01-02 10:00:00,100.00,9,2,lost",
    "5,12",
    "6,12,2026-01-02 10:00:00,100.00,4.5,0,delivered,and,more",
    ",12,2026-01-02 10:00:00,100.00,,,cancelled",
    "8,,2026-01-02 10:00:00,,,,",
    "9,12,,100.00,3.0,1,delivered",
]


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(HEADER + "\n".join(LINES) + "\n")
    return str(path)


def test_lines_are_set_aside_with_their_reasons(spark, csv):
    found = load_table(spark, "orders", csv, "csv")
    assert sorted(r["order_id"] for r in rows(found.good)) == [1, 8]
    assert found.good.schema == read_table(spark, "orders", csv, "csv", view=False).schema
    reasons = {tuple(sorted(r["reasons"])) for r in rows(found.rejected)}
    assert reasons == {
        ("negative gmv",), (UNREADABLE,), ("no order_id",), ("no order_ts",),
        ("is_late is not 0 or 1", "rating is not within 1 and 5", "unknown status"),
    }
    raw = {r["raw"] for r in rows(found.rejected) if r["reasons"] == [UNREADABLE]}
    assert raw == {LINES[2], LINES[4], LINES[5]}
    assert found.counts["rows"] == 9 and found.counts["rejected"] == 7 and found.counts[UNREADABLE] == 3
    assert found.counts["negative gmv"] == found.counts["unknown status"] == 1
    assert "negative discount" not in found.counts  # the source has no such column


def test_a_self_describing_source(spark, tmp_path):
    path = str(tmp_path / "users")
    spark.createDataFrame(
        [("1", "Pune", 1), ("two", "Pune", 0), (None, "Goa", 1), ("4", None, 7), ("5", "Goa", None)], "user_id string, city string, is_gold int"
    ).write.parquet(path)
    found = load_table(spark, "users", path)
    assert sorted((r["user_id"], r["is_member"]) for r in rows(found.good) if r["user_id"] == 1) == [(1, 1)]
    assert {r["user_id"] for r in rows(found.good)} == {1, 5}
    assert {(r["raw"], *r["reasons"]) for r in rows(found.rejected)} == {
        ('{"user_id":"two","city":"Pune","is_member":0}', UNREADABLE),
        ('{"city":"Goa","is_member":1}', "no user_id"),
        ('{"user_id":"4","is_member":7}', "is_member is not 0 or 1"),
    }
    assert found.counts == {"rows": 5, "rejected": 3, UNREADABLE: 1, "no user_id": 1, "is_member is not 0 or 1": 1}


def test_rules_of_ones_own(spark, csv):
    found = load_table(spark, "orders", csv, "csv", rules={"cheap": "gmv < 100", "no such column": "discount > 3"})
    assert found.counts["cheap"] == 1 and "no such column" not in found.counts
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        load_table(spark, "orders", csv, "csv", rules={"broken": "gmv <"})


def test_a_table_without_rows(spark, make, tmp_path):
    path = str(tmp_path / "orders")
    make.orders().write.parquet(path)
    found = load_table(spark, "orders", path)
    assert found.good.count() == found.rejected.count() == found.counts["rows"] == 0


def test_all_rows_are_good_or_rejected(spark, make, tmp_path):
    path = str(tmp_path / "orders")
    orders = make.orders(*[{"user_id": k, "order_ts": "2026-01-01 10:00:00", "rating": float(k % 8)} for k in range(80)])
    orders.write.parquet(path)
    found = load_table(spark, "orders", path)
    assert found.good.count() == 50 == orders.filter(F.col("rating").between(1, 5)).count()
    assert found.rejected.count() == found.counts["rejected"] == 30
