"""Results published as one unit.

Tables go to a folder of a new version; a numbered manifest that names them is written last. Readers follow
the highest manifest, so they see all tables of one version or all of the one before, also while a run is
writing and after a run has failed half-way. A version without a manifest is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.sources.results import write_results

MANIFESTS = "_manifests"


class Outrun(RuntimeError):
    """Another run has published since this one looked."""


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _numbers(spark: SparkSession, directory: str) -> list[int]:
    files, folder = _file_system(spark, f"{directory}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def latest(spark: SparkSession, directory: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; 0 and nothing where there is none."""
    numbers = _numbers(spark, directory)
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{directory}/{MANIFESTS}/{numbers[-1]:010d}.json", wholetext=True).first()[0]
    return numbers[-1], json.loads(text)


def put_manifest(spark: SparkSession, directory: str, content: dict, after: int) -> int:
    """Publish ``content`` as the manifest behind number ``after``. It is written under another name and
    renamed when it is whole; if the number has been taken meanwhile nothing is published."""
    number = after + 1
    files, target = _file_system(spark, f"{directory}/{MANIFESTS}/{number:010d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{MANIFESTS}/.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise Outrun(f"manifest {number} of {directory} is there already")
    return number


def publish(frames: Mapping[str, DataFrame], directory: str, fmt: str = "parquet") -> int:
    """Write all frames, then publish them together; the number of the version."""
    if not frames:
        raise ValueError("there is nothing to publish")
    spark = next(iter(frames.values())).sparkSession
    after, _ = latest(spark, directory)
    paths = write_results(frames, f"{directory}/{after + 1:010d}-{uuid.uuid4().hex}", fmt)
    tables = {
        name: {"path": paths[name].removeprefix(f"{directory}/"), "format": fmt, "schema": frame.schema.jsonValue()}
        for name, frame in frames.items()
    }
    return put_manifest(spark, directory, {"tables": tables}, after)


def read_published(spark: SparkSession, directory: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of the newest version, or of an earlier one, with the types they were written with."""
    if version is None:
        version, content = latest(spark, directory)
    else:
        text = spark.read.text(f"{directory}/{MANIFESTS}/{version:010d}.json", wholetext=True).first()[0]
        content = json.loads(text)
    if not version:
        raise FileNotFoundError(f"nothing is published in {directory}")
    found = {}
    for name, table in content["tables"].items():
        reader = spark.read.schema(StructType.fromJson(table["schema"])).format(table["format"])
        if table["format"] == "csv":
            reader = reader.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        found[name] = reader.load(f"{directory}/{table['path']}")
    return found


def drop_versions(spark: SparkSession, directory: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions that :func:`publish` made, manifests first; their numbers."""
    if keep < 1:
        raise ValueError("the newest version stays")
    gone = _numbers(spark, directory)[:-keep]
    files, root = _file_system(spark, directory)
    for number in gone:
        files.delete(_file_system(spark, f"{directory}/{MANIFESTS}/{number:010d}.json")[1], False)
    for status in files.listStatus(root) if files.exists(root) else []:
        name = status.getPath().getName()
        if name.partition("-")[0].isdigit() and int(name.partition("-")[0]) in gone:
            files.delete(status.getPath(), True)
    return gone
