"""Persist operator results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_results(
    results: Mapping[str, DataFrame], directory: str, fmt: str = "parquet"
) -> dict[str, str]:
    """Write every named frame to ``directory/<name>`` and return the paths.

    JSON keeps NULL fields as ``null``: a missing cell stays visible, and the
    file stays valid JSON.
    """
    paths = {}
    for name, frame in results.items():
        paths[name] = f"{directory}/{name}"
        writer = frame.write.mode("overwrite")
        if fmt == "json":
            writer = writer.option("ignoreNullFields", False)
        elif fmt == "csv":
            writer = writer.option("header", True).option(
                "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
            )
        writer.format(fmt).save(paths[name])
    return paths
