from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.sources.tables import (  # noqa: E402
    AB_TEST_ASSIGNMENTS,
    APP_EVENTS,
    ORDERS,
    USERS,
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "America/Los_Angeles")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


class Builder:
    """Makes source tables from partial rows; unnamed columns get a default."""

    def __init__(self, spark):
        self.spark = spark

    def _frame(self, schema, rows, defaults):
        known = [{**defaults, **row} for row in rows]
        return self.spark.createDataFrame(
            [tuple(row.get(field.name) for field in schema.fields) for row in known], schema
        )

    def users(self, *rows):
        defaults = {
            "signup_date": dt.date(2026, 1, 1),
            "city": "Pune",
            "platform": "Android",
            "acquisition_channel": "organic",
            "is_member": 0,
        }
        return self._frame(USERS, rows, defaults)

    def orders(self, *rows):
        defaults = {
            "city": "Pune",
            "platform": "Android",
            "cuisine": "Burgers",
            "gmv": Decimal("100"),
            "discount": Decimal("10"),
            "delivery_fee": 0,
            "promised_minutes": 32.0,
            "delivery_minutes": 30.0,
            "is_late": 0,
            "rating": 4.0,
            "status": "delivered",
        }
        filled = []
        for number, row in enumerate(rows, 1):
            row = {"order_id": number, **row}
            if isinstance(row["order_ts"], str):
                row["order_ts"] = ts(row["order_ts"])
            if "gmv" in row:
                row["gmv"] = Decimal(str(row["gmv"]))
            filled.append(row)
        return self._frame(ORDERS, filled, defaults)

    def events(self, *rows):
        """Rows of (session_id, step_no, platform, event_ts)."""
        names = "app_open search restaurant_view add_to_cart checkout_start payment_success"
        filled = [
            {
                "session_id": session,
                "user_id": session,
                "step_no": step,
                "event_name": names.split()[step - 1],
                "platform": platform,
                "event_ts": ts(when),
            }
            for session, step, platform, when in rows
        ]
        return self._frame(APP_EVENTS, filled, {"city": "Pune"})

    def assignments(self, *rows):
        return self._frame(
            AB_TEST_ASSIGNMENTS, rows, {"repeat_within_14d": 0, "coupon_cost": 0.0}
        )


@pytest.fixture(scope="session")
def make(spark):
    return Builder(spark)


def rows(frame, *keys):
    """Rows as dicts, by key columns if given."""
    collected = [row.asDict() for row in frame.collect()]
    if not keys:
        return collected
    return {
        row[keys[0]] if len(keys) == 1 else tuple(row[key] for key in keys): row
        for row in collected
    }


def one(frame):
    (row,) = rows(frame)
    return row


def half_up(value: float, places: int) -> float:
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
