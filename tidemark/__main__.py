"""Run a whole report, or the weekly monitor, over a folder of source tables.

    python -m tidemark report TABLES OUT --as-of 2026-06-30
    python -m tidemark weekly TABLES OUT [--week 2026-06-22]

``weekly`` exits with 1 if some metric is red, so that a scheduler can see it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.operators.monitor import RED
from tidemark.plans.report import full_report, weekly_run
from tidemark.plans.session import tuned
from tidemark.sources.results import write_results
from tidemark.sources.scratch import clean_up
from tidemark.sources.tables import read_tables


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("report", "weekly"):
        command = commands.add_parser(name)
        command.add_argument("tables", help="folder that holds the source tables")
        command.add_argument("out", help="folder for the results")
        command.add_argument("--format", default="parquet", help="of the source tables")
        command.add_argument("--scratch", help="shared folder for intermediate tables; default: the session's")
        command.add_argument("--out-format", default="parquet", choices=("parquet", "json"))
    commands.choices["report"].add_argument("--as-of", required=True, help="data cut-off")
    commands.choices["weekly"].add_argument("--week", help="a Monday; default: last full week")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    options = arguments(argv)
    spark = tuned(SparkSession.builder.appName("tidemark").getOrCreate())
    if options.scratch:
        spark.conf.set("spark.checkpoint.dir", options.scratch)
    try:
        return run(spark, options)
    finally:
        clean_up(spark)


def run(spark: SparkSession, options: argparse.Namespace) -> int:
    tables = read_tables(spark, options.tables, options.format)
    if options.command == "report":
        write_results(full_report(tables, options.as_of), options.out, options.out_format)
        return 0
    results = weekly_run(tables["orders"], tables["app_events"], options.week)
    write_results(results, options.out, options.out_format)
    worst = results["report"].select("overall").first()
    return int(worst is not None and worst["overall"] == RED)


if __name__ == "__main__":
    sys.exit(main())
