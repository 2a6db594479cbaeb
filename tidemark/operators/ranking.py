"""Global NTILE without a single-partition sort.

``ntile(k) over (order by ...)`` sends every row to one task. A tile, though, is
decided by no more than k - 1 rows: those at which the next tile starts. So only
the ordering columns are range-partitioned and sorted, each partition numbering
its own rows; partition sizes then say in which partition, and at which place,
every tile starts. The frame itself gets its tile by comparing against those few
keys, with neither a shuffle nor a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import park

# monotonically_increasing_id() keeps the partition above this bit, the row below.
_ROW_BITS = 33


def tile_starts(rows: int, tiles: int) -> list[int]:
    """Zero-based ranks at which tiles 2..k start: the first ``rows % tiles``
    tiles hold one row more. Tiles beyond the last row never start."""
    size, longer = divmod(rows, tiles)
    starts = (tile * size + min(tile, longer) for tile in range(1, tiles))
    return [start for start in starts if start < rows]


def tile_boundaries(frame: DataFrame, keys: Sequence[str], tiles: int) -> list[tuple]:
    """The keys of the first row of tiles 2..k. ``keys`` must be unique, not NULL
    and ascending.

    The numbered keys are parked in a scratch table, because range boundaries are
    sampled: the sizes and the lookups have to see one and the same partitioning.
    The driver receives one count per partition and k - 1 keys.
    """
    numbered = park(
        frame.select(*keys)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("place", F.monotonically_increasing_id()),
        "ranked",
    )
    partition = F.shiftright("place", _ROW_BITS)
    sizes = numbered.groupBy(partition.alias("part")).count().orderBy("part").collect()
    starts = tile_starts(sum(size["count"] for size in sizes), tiles)
    places, passed = [], 0
    for size in sizes:
        inside = [start - passed for start in starts if 0 <= start - passed < size["count"]]
        places += [(size["part"] << _ROW_BITS) + row for row in inside]
        passed += size["count"]
    if not places:
        return []
    rows = numbered.filter(F.col("place").isin(places)).orderBy("place").collect()
    return [tuple(row[key] for key in keys) for row in rows]


def with_ntile(
    frame: DataFrame, keys: Sequence[str], tiles: int, name: str
) -> DataFrame:
    """``frame`` plus ``ntile(tiles) over (order by keys)`` as column ``name``."""
    tile = F.lit(1)
    for boundary in tile_boundaries(frame, keys, tiles):
        tile = tile + F.when(_at_or_after(frame, keys, boundary), 1).otherwise(0)
    return frame.withColumn(name, tile)


def _at_or_after(frame: DataFrame, keys: Sequence[str], boundary: tuple) -> Column:
    """Row comparison ``(key, key, ...) >= boundary``."""
    first, *rest = keys
    bound = F.lit(str(boundary[0])).cast(frame.schema[first].dataType)
    if not rest:
        return F.col(first) >= bound
    return (F.col(first) > bound) | (
        (F.col(first) == bound) & _at_or_after(frame, rest, boundary[1:])
    )
