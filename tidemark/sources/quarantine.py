"""Loading a table of which some rows can't be used.

Every row is parsed and checked in one pass over the source. Rows that can't be parsed or break a rule are set
aside with all their reasons, the others load with their declared types. How many there are of
each kind is observed in the same pass.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.sources.scratch import scratch_path
from tidemark.sources.tables import ALIASES, TABLES, csv_schema

UNREADABLE = "unreadable"
RAW = "_raw_line"

#: By table, what is wrong with a row for which the condition holds. An unknown (NULL) condition does not hold.
RULES: dict[str, dict[str, str]] = {
    "users": {
        "no user_id": "user_id IS NULL",
        "is_member is not 0 or 1": "is_member NOT IN (0, 1)",
    },
    "orders": {
        "no order_id": "order_id IS NULL",
        "no order_ts": "order_ts IS NULL",
        "negative gmv": "gmv < 0",
        "negative discount": "discount < 0",
        "negative delivery_fee": "delivery_fee < 0",
        "negative delivery_minutes": "delivery_minutes < 0",
        "negative promised_minutes": "promised_minutes < 0",
        "rating is not within 1 and 5": "rating NOT BETWEEN 1 AND 5",
        "is_late is not 0 or 1": "is_late NOT IN (0, 1)",
        "unknown status": "status NOT IN ('delivered', 'cancelled')",
    },
    "app_events": {
        "no session_id": "session_id IS NULL",
        "no event_ts": "event_ts IS NULL",
        "step_no is not within 1 and 6": "step_no NOT BETWEEN 1 AND 6",
    },
    "ab_test_assignments": {
        "no user_id": "user_id IS NULL",
        "no variant": "variant IS NULL",
        "repeat_within_14d is not 0 or 1": "repeat_within_14d NOT IN (0, 1)",
    },
}


@dataclass(frozen=True)
class Loaded:
    """``good``: rows with their declared types. ``rejected``: raw, the row as it was read (the line of
    a text source, else JSON), and reasons. ``counts``: rows read, rejected, and per reason."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def load_table(
    spark: SparkSession, name: str, path: str, fmt: str = "parquet", rules: Mapping[str, str] | None = None
) -> Loaded:
    """Load one table and set aside what can't be used, see :class:`Loaded`.

    ``rules`` (reason to SQL condition) replace those of :data:`RULES`; a rule that names a declared column which the
    source lacks is left out. A text line with too few or too many fields, or with a field that is not of its
    type, is unreadable; so is a value of another source that can't be cast. A row with several
    faults has all their reasons; an unreadable one is not checked further. The result is written once, and
    both frames are scans of it.
    """
    known = {field.name: field for field in TABLES[name].fields}
    if fmt == "csv":
        schema = csv_schema(spark, name, path)
        source = (
            spark.read.schema(StructType([*schema.fields, StructField(RAW, StringType())]))
            .option("header", True)
            .option("enforceSchema", False)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", RAW)
            .csv(path)
        )
    else:
        source = spark.read.format(fmt).load(path)
    for old, new in ALIASES.items():
        if old in source.columns and new not in source.columns:
            source = source.withColumnRenamed(old, new)
    columns = [c for c in known if c in source.columns]
    if fmt == "csv":
        typed = source.select(*columns, F.col(RAW).alias("raw"), F.col(RAW).isNotNull().alias("unreadable"))
        raw = F.coalesce("raw", F.to_json(F.struct(*columns)))
    else:
        cast = {c: F.col(c).try_cast(known[c].dataType) for c in columns}
        lost = F.exists(F.array(*[F.col(c).isNotNull() & cast[c].isNull() for c in columns]), lambda x: x)
        typed = source.select(
            *[cast[c].alias(c) for c in columns], F.to_json(F.struct(*columns)).alias("raw"), lost.alias("unreadable")
        )
        raw = F.col("raw")
    checks = {
        reason: F.expr(condition)
        for reason, condition in (RULES[name] if rules is None else rules).items()
        if not (set(re.findall(r"\w+", condition)) & known.keys()) - set(columns)
    }
    broken = F.filter(
        F.array(*[F.when(condition, F.lit(reason)) for reason, condition in checks.items()], F.lit(None).cast("string")),
        lambda reason: reason.isNotNull(),
    )
    judged = typed.withColumn(
        "reasons", F.when(F.col("unreadable"), F.array(F.lit(UNREADABLE))).otherwise(broken)
    ).withColumn("is_rejected", F.size("reasons") > 0)
    counted = {"rows": F.count("*"), "rejected": F.count_if("is_rejected")} | {
        reason: F.count_if(F.array_contains("reasons", reason)) for reason in (UNREADABLE, *checks)
    }
    observation = Observation(f"load {name}")
    target = scratch_path(spark, f"load-{name}")
    rejected = F.col("is_rejected")
    # good rows need no copy of themselves
    kept = judged.observe(observation, *[value.alias(what) for what, value in counted.items()]).select(
        *columns, F.when(rejected, raw).alias("raw"), F.when(rejected, F.col("reasons")).alias("reasons"), "is_rejected"
    )
    kept.write.partitionBy("is_rejected").parquet(target)
    fields = [known[c] for c in columns]
    stored = spark.read.schema(
        StructType([*fields, *kept.select("raw", "reasons", "is_rejected").schema.fields])
    ).parquet(target)
    good = stored.filter(~F.col("is_rejected")).select(*columns)
    return Loaded(good, stored.filter("is_rejected").select("raw", "reasons"), observation.get)

