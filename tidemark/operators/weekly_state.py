"""The weekly metrics as a state that new rows are merged into.

Per week the state keeps sums that add up, and the members of its distinct counts: users, and sessions that
reached a step. A run reads its batch and, of the state, the members of the weeks that the batch
touches, late weeks among them; what it writes are these weeks, in a folder of its own, and the small
table of sums. A manifest, published last, says which run holds which week. So a run that fails
leaves the state as it was, a batch that comes again changes nothing, and of two runs at a time one wins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_start
from tidemark.functions.numeric import percent, ratio, scaled
from tidemark.operators.first_orders import delivered
from tidemark.sources.publish import latest, put_manifest
from tidemark.sources.scratch import park

MONEY = "decimal(38,2)"
UNITS = 10**4
USERS, STARTED, FINISHED = "users", "started", "finished"
KINDS = (USERS, STARTED, FINISHED)
SUMS = ("orders", "gmv", "gmv_n", "discount", "late", "late_n", "minutes", "minutes_n", "rating", "rating_n")


def sums() -> dict[str, Column]:
    """What is summed over a week's delivered orders. A later batch's sums are added."""
    values = [
        F.count("*"),
        F.sum("gmv").cast(MONEY),
        F.count("gmv"),
        F.sum("discount").cast("decimal(38,4)"),
        F.sum("is_late").cast("long"),
        F.count("is_late"),
        F.sum(scaled("delivery_minutes")),
        F.count("delivery_minutes"),
        F.sum(scaled("rating")),
        F.count("rating"),
    ]
    return dict(zip(SUMS, values, strict=True))


def metric_values(of_events: bool) -> dict[str, Column]:
    """The default metrics by label, from the sums and the sizes of the member sets."""
    if of_events:
        return {"Session→order conv (%)": percent(FINISHED, STARTED)}
    return {
        "Orders": F.col("orders"),
        "Active users": F.col(USERS),
        "GMV (₹)": F.col("gmv"),
        "AOV (₹)": ratio("gmv", "gmv_n"),
        "Late-delivery rate (%)": F.lit(100.0) * ratio("late", "late_n"),
        "Avg delivery (min)": ratio("minutes", F.col("minutes_n") * F.lit(UNITS)),
        "Avg rating": ratio("rating", F.col("rating_n") * F.lit(UNITS)),
        "Discount % of GMV": percent("discount", "gmv"),
    }


def week_sums(orders: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """week_start, the sums, and the number of events; what a week lacks is NULL."""
    found = delivered(orders).groupBy(week_start("order_ts").alias("week_start")).agg(
        *[value.alias(name) for name, value in sums().items()]
    )
    if events is None:
        return found.withColumn("events", F.lit(None).cast("long"))
    seen = events.groupBy(week_start("event_ts").alias("week_start")).agg(F.count("*").alias("events"))
    return found.join(seen, "week_start", "full").select("week_start", *SUMS, "events")


def week_members(
    orders: DataFrame, events: DataFrame | None = None, first_step: int = 1, last_step: int = 6
) -> DataFrame:
    """week_start, kind, id: the distinct users and sessions of each week."""
    parts = [
        delivered(orders)
        .filter("user_id is not null")
        .select(week_start("order_ts").alias("week_start"), F.lit(USERS).alias("kind"), F.col("user_id").alias("id"))
    ]
    if events is not None:
        for kind, step in ((STARTED, first_step), (FINISHED, last_step)):
            parts.append(
                events.filter(F.col("step_no") == step).select(
                    week_start("event_ts").alias("week_start"), F.lit(kind).alias("kind"), F.col("session_id").alias("id")
                )
            )
    return reduce(DataFrame.unionAll, parts).distinct()


def _sums_of(spark: SparkSession, state: str, manifest: Mapping) -> DataFrame | None:
    if not manifest:
        return None
    return spark.read.parquet(f"{state}/{manifest['sums']}")


def touched_members(spark: SparkSession, state: str, manifest: Mapping, weeks: list[str]) -> DataFrame | None:
    """The state's members of ``weeks``, each read from its folder in the run that holds it."""
    runs = defaultdict(list)
    for week in weeks:
        if week in manifest.get("weeks", {}):
            run = manifest["weeks"][week]
            runs[run].append(f"{state}/{run}/week_start={week}")
    schema = "kind string, id long, week_start date"
    parts = [
        spark.read.schema(schema).option("basePath", f"{state}/{run}").parquet(*own).select("week_start", "kind", "id")
        for run, own in sorted(runs.items())
    ]
    return reduce(DataFrame.unionAll, parts) if parts else None


def advance(
    spark: SparkSession,
    state: str,
    batch: str,
    orders: DataFrame,
    events: DataFrame | None = None,
    first_step: int = 1,
    last_step: int = 6,
) -> list[str]:
    """Merge a batch of new orders and events into the state at the path ``state``; the weeks touched.

    ``batch`` names the rows: a name that the state has seen is not merged again. Rows may belong to any
    weeks. Those without a time belong to none and are left out, as are cancelled orders. Steps of the
    funnel are those of the first batch's run and must not change. The driver receives the touched weeks, and the manifest
    grows by a line per week and per batch.
    """
    if not re.fullmatch(r"[\w.:+-]+", batch):
        raise ValueError("a batch is named by letters, digits and . : + - _")
    number, manifest = latest(spark, state)
    steps = [first_step, last_step]
    if manifest and manifest["steps"] != steps:
        raise ValueError(f"the state counts steps {manifest['steps']}")
    if batch in manifest.get("batches", []):
        return []
    run = f"run-{number + 1:010d}-{batch}"
    orders = orders.filter("order_ts is not null")
    events = None if events is None else events.filter("event_ts is not null")
    new = park(week_sums(orders, events), "week-sums")
    weeks = sorted(str(row[0]) for row in new.select("week_start").collect())
    members = week_members(orders, events, first_step, last_step)
    old = touched_members(spark, state, manifest, weeks)
    merged = park(members if old is None else members.unionAll(old).distinct(), "week-members")
    folder = f"{run}/members"
    # each week is one folder; a week of very many members is split over several files
    merged.hint("rebalance", F.col("week_start")).write.mode("overwrite").partitionBy("week_start").parquet(f"{state}/{folder}")
    sizes = merged.groupBy("week_start").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(kind) for kind in KINDS]
    )
    before = _sums_of(spark, state, manifest)
    added = [*SUMS, "events"]
    if before is None:
        summed, sizes_before = new, None
    else:
        kinds = dict(before.dtypes)
        both = before.select("week_start", *added).unionByName(new)
        summed = both.groupBy("week_start").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in added])
        sizes_before = before.select("week_start", *KINDS)
    touched = new.select("week_start", F.lit(True).alias("touched"))
    after = summed.join(touched, "week_start", "left").join(sizes, "week_start", "left")
    if sizes_before is None:
        after = after.select("week_start", *added, *[F.coalesce(k, F.lit(0)).alias(k) for k in KINDS])
    else:
        earlier = sizes_before.select("week_start", *[F.col(k).alias(f"{k}_before") for k in KINDS])
        size = lambda k: F.when(F.col("touched"), F.coalesce(k, F.lit(0))).otherwise(F.col(f"{k}_before"))
        after = after.join(earlier, "week_start", "left").select("week_start", *added, *[size(k).alias(k) for k in KINDS])
    after.coalesce(1).write.mode("overwrite").parquet(f"{state}/{run}/sums")  # a row per week
    filled = {str(row[0]): folder for row in merged.select("week_start").distinct().collect()}
    content = {
        "steps": steps,
        "sums": f"{run}/sums",
        "weeks": {**manifest.get("weeks", {}), **filled},
        "batches": [*manifest.get("batches", []), batch],
    }
    put_manifest(spark, state, content, number)
    return weeks


def weekly_metrics(spark: SparkSession, state: str) -> DataFrame:
    """metric, week_start, value, as :func:`tidemark.operators.monitor.weekly_metrics` computes them from all rows. Only
    the table of sums is read."""
    _, manifest = latest(spark, state)
    kept = _sums_of(spark, state, manifest)
    if kept is None:
        raise FileNotFoundError(f"no batch has been merged into {state}")
    parts = []
    for of_events in (False, True):
        found = kept.filter(F.col("events" if of_events else "orders").isNotNull())
        values = metric_values(of_events)
        wide = found.select("week_start", *[v.cast("double").alias(label) for label, v in values.items()])
        parts.append(wide.unpivot("week_start", [f"`{label}`" for label in values], "metric", "value"))
    return reduce(DataFrame.unionAll, parts).select("metric", "week_start", "value")
