"""Finding a document again: a key of its doc_id and text, and filters by such keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key() -> Column:
    """A 64-bit key of (doc_id, text). Repeated rows share it and are treated alike."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull())


def spare(name: str, *frames: DataFrame) -> str:
    """``name``, behind as many underscores as it takes to be the name of no column of the frames."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def replaced(docs: DataFrame, dropped: str | None = None, **columns: Column) -> list[Column]:
    """All columns of ``docs`` but ``dropped``, those named with their new values."""
    kept = [c for c in docs.columns if dropped is None or c.lower() != dropped.lower()]
    return [columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in kept]


def without(docs: DataFrame, keys: DataFrame, key: str = "row_key") -> DataFrame:
    """The rows of ``docs`` whose key is not in ``keys``; columns as they were, whatever their names."""
    own = spare("key", docs)
    gone = keys.select(F.col(key).alias(own)).distinct()
    return docs.withColumn(own, row_key()).join(gone, own, "left_anti").select(*replaced(docs))
