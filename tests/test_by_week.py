import datetime as dt

import pytest
from conftest import plan_of, rows

from tidemark.operators import monitor
from tidemark.plans.report import weekly_run
from tidemark.sources.by_week import WEEK, read_by_week, write_by_week
from tidemark.sources.tables import ORDERS

MONDAY = dt.date(2026, 6, 22)


@pytest.fixture
def table(make, tmp_path):
    path = str(tmp_path / "orders")
    made = [
        {"user_id": k, "order_ts": str(dt.datetime(2026, 5, 4, 12) + dt.timedelta(days=k)), "is_late": int(k > 48 or k % 7 == 0), "city": "AB"[k % 2]}
        for k in range(60)
    ]
    write_by_week(make.orders(*made), path)
    return made, path


def test_a_table_comes_back_whole(spark, table):
    made, path = table
    found = read_by_week(spark, path, ORDERS)
    assert found.count() == len(made) and found.columns == [*ORDERS.names, WEEK]
    assert all(r[WEEK].weekday() == 0 and 0 <= (r["order_ts"].date() - r[WEEK]).days < 7 for r in found.collect())


def test_one_week_is_one_folder(spark, table):
    made, path = table
    found = read_by_week(spark, path, ORDERS, weeks=[MONDAY])
    assert len(found.collect()) == 7
    assert folders_read(found) == [1]


def test_the_drill_down_reads_the_reported_week_only(spark, table):
    made, path = table
    orders = read_by_week(spark, path, ORDERS)
    plain = monitor.late_drilldown(spark.read.schema(ORDERS).parquet(path), MONDAY)
    pruned = monitor.late_drilldown(orders, MONDAY, week_column=WEEK)
    assert rows(pruned, "city") == rows(plain, "city")
    report = spark.createDataFrame([(MONDAY, "RED")], "week_start date, status string")
    found = monitor.late_drilldown(orders, report=report, week_column=WEEK)
    assert rows(found, "city") == rows(plain, "city")
    found.collect()
    plan = plan_of(found)
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert f"{WEEK}#" in filters and "Subquery" in filters
    assert folders_read(found) == [1]


def folders_read(frame):
    """How many folders each file scan of the plan that ran has read."""
    found, waiting = [], [frame._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            found.append(node.metrics().apply("numPartitions").value())
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        if name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_the_weekly_run_with_a_partitioned_table(spark, table):
    _, path = table
    by_week, plain = read_by_week(spark, path, ORDERS), spark.read.schema(ORDERS).parquet(path)
    one, other = weekly_run(by_week, week=MONDAY, week_column=WEEK), weekly_run(plain, week=MONDAY)
    for name in ("report", "drilldown"):
        assert sorted(map(repr, rows(one[name]))) == sorted(map(repr, rows(other[name])))
    assert one["drilldown"].count() == 2


def test_only_touched_weeks_are_replaced(spark, make, table):
    made, path = table
    write_by_week(make.orders({"user_id": 7, "order_ts": "2026-06-23 10:00:00"}), path, only_touched=True)
    counts = {r[WEEK]: r["count"] for r in rows(read_by_week(spark, path, ORDERS).groupBy(WEEK).count())}
    assert counts[MONDAY] == 1 and sum(counts.values()) == len(made) - 7 + 1


def test_a_clash_of_names_is_an_error(make, tmp_path):
    with pytest.raises(ValueError):
        write_by_week(make.orders().selectExpr("*", "1 AS order_week"), str(tmp_path / "x"))
