import datetime as dt
import json
from decimal import Decimal

import pytest

from conftest import one, rows
from tidemark.__main__ import main
from tidemark.plans.report import full_report, weekly_run
from tidemark.sources import scratch
from tidemark.sources.results import write_results
from tidemark.sources.tables import TABLES, read_table, read_tables

# The header lines are the format. The rows are made up.
USERS_CSV = """user_id,signup_date,city,platform,acquisition_channel,is_gold
41,2026-02-11,Oslo,Android,organic,0
77,2026-05-20,Bergen,iOS,referral,1
"""
ORDERS_CSV = """order_id,user_id,order_ts,order_seq,city,platform,cuisine,gmv,discount,delivery_fee,promised_minutes,delivery_minutes,is_late,rating,status
900,41,2026-06-02 12:30:00,1,Oslo,Android,Soup,310.0,10.0,25,32.0,44.0,1,2.5,delivered
901,77,2026-05-21 19:05:00,1,Bergen,iOS,Bread,290.0,0.0,45,32.0,20.5,0,,delivered
"""
EVENTS_CSV = """session_id,user_id,event_ts,event_name,step_no,platform,city
5001,41,2026-06-02 12:11:09,app_open,1,Android,Oslo
"""
ARMS_CSV = """user_id,first_order_id,assigned_ts,variant,repeat_within_14d,second_order_aov,second_order_cancelled,coupon_cost
41,900,2026-06-02 12:30:00,control,0,,,0.0
77,901,2026-05-21 19:05:00,treatment,1,275.5,0.0,75.0
"""


@pytest.fixture
def csv_folder(tmp_path):
    texts = (USERS_CSV, ORDERS_CSV, EVENTS_CSV, ARMS_CSV)
    for name, text in zip(TABLES, texts):
        (tmp_path / f"{name}.csv").write_text(text)
    return tmp_path


def test_csv_tables_are_typed(spark, csv_folder):
    tables = read_tables(spark, str(csv_folder), "csv")
    for name, table in tables.items():
        assert [(f.name, f.dataType) for f in table.schema] == [
            (f.name, f.dataType) for f in TABLES[name].fields
        ]
    orders = rows(tables["orders"], "order_id")
    assert orders[900]["order_ts"] == dt.datetime(2026, 6, 2, 12, 30)
    assert orders[900]["gmv"] == Decimal("310.00") and orders[901]["rating"] is None
    assert rows(tables["users"], "user_id")[77]["is_member"] == 1
    assert rows(tables["ab_test_assignments"], "user_id")[41]["second_order_aov"] is None
    assert spark.sql("SELECT COUNT(*) AS n FROM app_events").first()["n"] == 1


def test_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "users.csv"
    path.write_text("city,user_id,unknown\nPune,7,x\n")
    row = one(read_table(spark, "users", str(path), "csv", view=False))
    assert row == {"user_id": 7, "city": "Pune"}


def test_files_with_another_header_fail(spark, tmp_path):
    folder = tmp_path / "users.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("user_id,city\n1,Pune\n")
    (folder / "b.csv").write_text("city,user_id\nPune,2\n")
    with pytest.raises(Exception, match="header|HEADER"):
        read_table(spark, "users", str(folder), "csv", view=False).collect()


def test_parquet_is_cast_where_types_differ(spark, tmp_path):
    path = str(tmp_path / "users.parquet")
    spark.createDataFrame([(1, "2026-01-02", 1)], "user_id int, signup_date string, is_gold long") \
        .write.parquet(path)
    table = read_table(spark, "users", path)
    assert dict(table.dtypes) == {"user_id": "bigint", "signup_date": "date", "is_member": "int"}
    assert one(table)["signup_date"] == dt.date(2026, 1, 2)


def test_json_results_keep_nulls(spark, tmp_path):
    frame = spark.createDataFrame([(1, None)], "period_index int, retention_pct double")
    paths = write_results({"cohort": frame}, str(tmp_path / "out"), "json")
    (line,) = [row["value"] for row in spark.read.text(paths["cohort"]).collect()]
    assert json.loads(line) == {"period_index": 1, "retention_pct": None}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_results_overwrite_older_ones(spark, tmp_path, fmt):
    out = str(tmp_path / "out")
    for n in (3, 2):
        paths = write_results({"numbers": spark.range(n)}, out, fmt)
    assert spark.read.format(fmt).option("header", True).load(paths["numbers"]).count() == 2


def test_parked_tables_lie_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    parked = scratch.park(spark.range(5), "five")
    assert parked.count() == 5
    assert root in parked.inputFiles()[0]


class Settings(dict):
    """A session with these settings."""

    conf = property(lambda self: self)
    sparkContext = property(lambda self: self)
    applicationId = "app-7"


def test_scratch_is_shared_storage():
    assert scratch.scratch_root(Settings({"spark.checkpoint.dir": "hdfs://x/c/"})) == "hdfs://x/c/tidemark-app-7"
    assert scratch.scratch_root(Settings({"spark.sql.warehouse.dir": "s3a://w"})) == "s3a://w/tidemark-app-7"


def test_full_report_and_weekly_run(spark, csv_folder, tmp_path):
    tables = read_tables(spark, str(csv_folder), "csv")
    report = full_report(tables, "2026-06-30")
    paths = write_results(report, str(tmp_path / "out"))
    assert len(paths) == 34
    impact = one(spark.read.parquet(paths["impact"]))
    assert impact["aov_used"] == 300.0 and len(impact["lateness_worst_cells"]) == 2
    run = weekly_run(tables["orders"], tables["app_events"], "2026-06-01")
    found = rows(run["report"], "metric")
    assert found["Orders"]["this_week"] == 1.0 and found["Avg delivery (min)"]["status"] == "RED"
    assert found["Orders"]["overall"] == "RED"
    assert rows(run["drilldown"]) == [
        {"city": "Oslo", "late_rate_pct": 100.0, "avg_min": 44.0, "orders": 1}
    ]


def test_command_line(spark, csv_folder, tmp_path):
    out = str(tmp_path / "out")
    common = [str(csv_folder), out, "--format", "csv", "--out-format", "json"]
    assert main(["weekly", *common, "--week", "2026-06-01"]) == 1
    assert spark.read.json(f"{out}/drilldown").first()["city"] == "Oslo"
    assert main(["weekly", *common, "--week", "2020-01-06"]) == 0
