"""The four source tables, bound to a customer/orders/lineitem/events star schema.

That schema has no deliveries, sessions or experiments, so fixed rules derive
them from keys and dates. Joins that only some columns need are switched on by
the caller, because Catalyst cannot drop an outer join it does not know to be
one-to-one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.first_orders import first_n_orders

# The event types that make up the funnel, in step order.
FUNNEL_STEPS = ("signup", "view", "click", "purchase")
PROMISED_MINUTES = 32.0
LATE_AFTER_DAYS = 1600


# Declared, so that no job has to look at a file before a plan exists.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_extendedprice double, l_discount double, "
    "l_shipdate timestamp_ntz",
    "events": "ts timestamp_ntz, user_id bigint, event_type string",
}


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def _platform(key: str) -> str:
    return f"IF({key} % 7 < 5, 'Android', 'iOS') AS platform"


def users_of(spark: SparkSession, directory: str) -> DataFrame:
    nations = _table(spark, directory, "nation").join(
        _table(spark, directory, "region"), F.expr("n_regionkey = r_regionkey")
    )
    return (
        _table(spark, directory, "customer")
        .join(nations, F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            "c_custkey AS user_id",
            "r_name AS city",
            _platform("c_custkey"),
            "c_mktsegment AS acquisition_channel",
            "IF(c_acctbal > 7500, 1, 0) AS is_member",
        )
    )


def orders_of(
    spark: SparkSession,
    directory: str,
    *,
    city: bool = False,
    delivery: bool = False,
    only: DataFrame | None = None,
    users: DataFrame | None = None,
) -> DataFrame:
    """Orders; ``city`` adds the user's city (from ``users`` where they are at hand), ``delivery`` the columns that come
    from line items: discount, delivery_minutes and is_late. ``only`` holds the
    user_id and order_ts of the orders wanted, and thins out orders and line items
    before those joins."""
    columns = [
        "order_id",
        "user_id",
        "order_ts",
        "platform",
        "gmv",
        "promised_minutes",
        "rating",
        "status",
    ]
    orders = _table(spark, directory, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS user_id",
        "o_orderdate AS placed_on",
        "o_orderdate + make_dt_interval(0, int(o_custkey % 24)) AS order_ts",
        _platform("o_custkey"),
        "CAST(o_totalprice AS DECIMAL(18,2)) AS gmv",
        f"double({PROMISED_MINUTES}) AS promised_minutes",
        "double(substring(o_orderpriority, 1, 1)) AS rating",
        "IF(o_orderkey % 40 = 7, 'cancelled', 'delivered') AS status",
    )
    if only is not None:
        orders = orders.join(only, ["user_id", "order_ts"], "left_semi")
    if delivery:
        wanted = None if only is None else orders.select("order_id")
        orders = orders.join(_shipments(spark, directory, wanted), "order_id", "left")
        columns += [
            "discount",
            "2D + datediff(last_ship, placed_on) / 40D AS delivery_minutes",
            f"int(datediff(last_ship, placed_on) > {LATE_AFTER_DAYS}) AS is_late",
        ]
    if city:
        users = users_of(spark, directory) if users is None else users
        cities = users.select("user_id", "city")
        orders = orders.join(cities, "user_id", "left")
        columns.append("city")
    return orders.selectExpr(*columns)


def _shipments(
    spark: SparkSession, directory: str, wanted: DataFrame | None = None
) -> DataFrame:
    """Last shipping date and exact discount per order, of the ``wanted`` orders if given: line
    items of others go before they are grouped. Cents times hundredths are summed as longs,
    ten-thousandths of the currency unit."""
    items = _table(spark, directory, "lineitem").withColumnRenamed("l_orderkey", "order_id")
    if wanted is not None:
        items = items.join(wanted, "order_id", "left_semi")
    units = F.expr("sum(bigint(rint(l_extendedprice * 100D)) * bigint(rint(l_discount * 100D)))")
    return (
        items.groupBy("order_id")
        .agg(F.max("l_shipdate").alias("last_ship"), units.alias("units"))
        .selectExpr(
            "order_id",
            "last_ship",
            "CAST(CAST(units AS DECIMAL(20,0)) * 0.0001BD AS DECIMAL(18,4)) AS discount",
        )
    )


def events_of(spark: SparkSession, directory: str) -> DataFrame:
    steps = ", ".join(f"'{name}'" for name in FUNNEL_STEPS)
    return (
        _table(spark, directory, "events")
        .filter(f"event_type IN ({steps})")
        .selectExpr(
            "user_id * 100 + dayofmonth(ts) AS session_id",
            "user_id",
            "ts AS event_ts",
            "event_type AS event_name",
            f"int(array_position(array({steps}), event_type)) AS step_no",
            _platform("user_id"),
        )
    )


def variants_of(spark: SparkSession, directory: str) -> DataFrame:
    """Every customer's arm: even keys are control."""
    return _table(spark, directory, "customer").selectExpr(
        "c_custkey AS user_id", "IF(c_custkey % 2 = 0, 'control', 'treatment') AS variant"
    )


def first_two_orders_of(spark: SparkSession, directory: str) -> DataFrame:
    return first_n_orders(orders_of(spark, directory), 2)
