"""Schemas and typed readers of the four source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(18, 2)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


USERS = _schema(
    ("user_id", LongType()),
    ("signup_date", DateType()),
    ("city", StringType()),
    ("platform", StringType()),
    ("acquisition_channel", StringType()),
    ("is_member", IntegerType()),
)

ORDERS = _schema(
    ("order_id", LongType()),
    ("user_id", LongType()),
    ("order_ts", TimestampNTZType()),
    ("order_seq", IntegerType()),
    ("city", StringType()),
    ("platform", StringType()),
    ("cuisine", StringType()),
    ("gmv", MONEY),
    ("discount", MONEY),
    ("delivery_fee", IntegerType()),
    ("promised_minutes", DoubleType()),
    ("delivery_minutes", DoubleType()),
    ("is_late", IntegerType()),
    ("rating", DoubleType()),
    ("status", StringType()),
)

APP_EVENTS = _schema(
    ("session_id", LongType()),
    ("user_id", LongType()),
    ("event_ts", TimestampNTZType()),
    ("event_name", StringType()),
    ("step_no", IntegerType()),
    ("platform", StringType()),
    ("city", StringType()),
)

AB_TEST_ASSIGNMENTS = _schema(
    ("user_id", LongType()),
    ("first_order_id", LongType()),
    ("assigned_ts", TimestampNTZType()),
    ("variant", StringType()),
    ("repeat_within_14d", IntegerType()),
    ("second_order_aov", DoubleType()),
    ("second_order_cancelled", DoubleType()),
    ("coupon_cost", DoubleType()),
)

TABLES = {
    "users": USERS,
    "orders": ORDERS,
    "app_events": APP_EVENTS,
    "ab_test_assignments": AB_TEST_ASSIGNMENTS,
}

# Columns that some exports name differently.
ALIASES = {"is_gold": "is_member"}


def csv_schema(spark: SparkSession, name: str, path: str) -> StructType:
    """The declared types in the order of the first file's header."""
    declared = {field.name: field for field in TABLES[name].fields}
    header = spark.read.option("header", True).csv(path).columns
    return StructType(
        [
            StructField(column, declared[known].dataType if known in declared else StringType())
            for column in header
            for known in [ALIASES.get(column, column)]
        ]
    )


def read_table(
    spark: SparkSession, name: str, path: str, fmt: str = "parquet", view: bool = True
) -> DataFrame:
    """Read one table with its declared types.

    Columns are matched by name. A text source takes its types from the declared
    schema while it is parsed, so nothing is inferred from the rows, and every
    file's header has to agree with the first one's; a self-describing source is
    cast where its types differ. Columns that the source lacks are left out.
    """
    if fmt == "csv":
        source = (
            spark.read.schema(csv_schema(spark, name, path))
            .option("header", True)
            .option("enforceSchema", False)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
            .option("mode", "FAILFAST")
            .csv(path)
        )
    else:
        source = spark.read.format(fmt).load(path)
    for old, new in ALIASES.items():
        if old in source.columns and new not in source.columns:
            source = source.withColumnRenamed(old, new)
    table = source.select(
        [
            F.col(field.name)
            if source.schema[field.name].dataType == field.dataType
            else F.col(field.name).cast(field.dataType)
            for field in TABLES[name].fields
            if field.name in source.columns
        ]
    )
    if view:
        table.createOrReplaceTempView(name)
    return table


def read_tables(
    spark: SparkSession, directory: str, fmt: str = "parquet", view: bool = True
) -> dict[str, DataFrame]:
    """Read all four tables from ``directory/<name>.<fmt>``, each as a temp view too."""
    return {
        name: read_table(spark, name, f"{directory}/{name}.{fmt}", fmt, view) for name in TABLES
    }
