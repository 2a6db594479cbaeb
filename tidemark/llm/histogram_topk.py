"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, block against block, as a matrix product. No score is
kept: a pass only counts scores into a histogram per query. The histograms' sum says which
bin holds the k-th score; the next pass splits that bin, until a bin is a single score. A last
pass scores again and keeps what lies above, and of those equal to the k-th the smallest ids.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import park, tasks_import

BINS = 256
SCORES = 1 << 21  # held by a task at a time
LONGEST = (1 << 63) - 1


def _floor(x: Column) -> Column:
    far = F.lit(float(1 << 63))
    return F.when(x >= far, F.lit(LONGEST)).when(x <= -far, F.lit(-LONGEST)).otherwise(F.floor(x).cast("long"))


def quantized(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double, no farther from 0 than a long and its negative go; null if any
    component is null or not finite."""
    limit = float("inf")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == limit))
    return F.when(
        F.col(vector).isNotNull() & ~bad,
        F.transform(vector, lambda x: _floor(F.lit(scale).cast("double") * x.cast("double"))),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _kind(bound: int) -> type:
    """A type in which sums of products up to ``bound`` are exact; float products are the fastest."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def _scored(batches, block):
    """(ids of some vectors, their scores with all queries of the block); a query's own vector is marked."""
    ids, queries, kind = block
    own = np.argsort(ids, kind="stable")
    rows = max(1, (SCORES if kind is not object else SCORES // 16) // max(1, len(ids)))
    transposed = np.ascontiguousarray(queries.T.astype(kind))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            vec_ids = part.column(0).to_numpy(zero_copy_only=False)
            scores = _matrix(part.column(1), queries.shape[1]).astype(kind) @ transposed
            scores = scores.astype(np.int64) if kind is not object else np.clip(scores, -LONGEST, LONGEST)
            place = np.searchsorted(ids[own], vec_ids)
            mine = np.zeros(scores.shape, dtype=bool)
            stop = np.searchsorted(ids[own], vec_ids, side="right")
            for row in np.flatnonzero(stop > place):
                mine[row, own[place[row] : stop[row]]] = True
            yield vec_ids, scores, mine


def _count(batches, block, low, width):
    """Per query: how many scores lie in each of BINS bins of ``width`` from ``low`` upwards."""
    low, shift = low.value, width.bit_length() - 1
    counts = np.zeros((len(low), BINS), dtype=np.int64)
    base = np.arange(len(low), dtype=np.int64) * BINS
    for _, scores, mine in _scored(batches, block.value):
        bins = (scores - low) >> shift
        keep = (bins >= 0) & (bins < BINS) & ~mine
        counts += np.bincount((bins + base)[keep].astype(np.int64), minlength=counts.size).reshape(counts.shape)
    query, place = np.nonzero(counts)
    yield pa.record_batch(
        [pa.array(query, pa.int32()), pa.array(place, pa.int32()), pa.array(counts[query, place], pa.int64())], ["q", "bin", "n"]
    )


def _above(batches, block, kth, k):
    """Scores above each query's k-th, and of those equal to it the k smallest ids of the task."""
    kth, ids = kth.value, block.value[0]
    equal = [[] for _ in ids]
    schema = ["query_id", "vec_id", "score"]
    for vec_ids, scores, mine in _scored(batches, block.value):
        row, query = np.nonzero((scores > kth) & ~mine)
        if len(row):
            yield pa.record_batch([pa.array(ids[query]), pa.array(vec_ids[row]), pa.array(scores[row, query], pa.int64())], schema)
        row, query = np.nonzero((scores == kth) & ~mine)
        order = np.argsort(query, kind="stable")
        row, query = row[order], query[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else []
        for a, b in zip(starts, [*starts[1:], len(query)]):
            held = np.sort(np.r_[np.asarray(equal[query[a]], dtype=np.int64), vec_ids[row[a:b]]])
            equal[query[a]] = held[:k]
    sizes = [len(e) for e in equal]
    if sum(sizes):
        query = np.repeat(np.arange(len(ids)), sizes)
        yield pa.record_batch(
            [pa.array(ids[query]), pa.array(np.concatenate([np.asarray(e, dtype=np.int64) for e in equal])), pa.array(kth[query], pa.int64())], schema
        )


def _search(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, largest: int, k: int) -> DataFrame:
    """Top k of one block of queries."""
    context = vectors.sparkSession.sparkContext
    dim = queries.shape[1]
    reach = int(np.abs(queries).max(initial=0)) * largest * dim
    kind = _kind(max(reach, int(np.abs(queries).max(initial=0)), largest))
    block = context.broadcast((ids, queries, kind))
    reach = min(reach, LONGEST)
    low = np.full(len(ids), -reach, dtype=object if kind is object else np.int64)
    # widths fall by a factor of BINS each pass, to 1
    width = 1
    while width * BINS < 2 * reach + 1:
        width *= BINS
    wanted = np.full(len(ids), k, dtype=np.int64)  # the rank of the k-th score among those of the bin
    while True:
        found = (
            vectors.mapInArrow(
                partial(_count, block=block, low=context.broadcast(low), width=width), "q int, bin int, n long"
            )
            .groupBy("q", "bin")
            .agg(F.sum("n").alias("n"))
        )
        # the bin that holds the wanted rank, counted from the top, and what lies above it
        top = Window.partitionBy("q").orderBy(F.col("bin").desc())
        above = F.sum("n").over(top) - F.col("n")
        placed = found.select("q", "bin", "n", above.alias("above"), F.row_number().over(Window.partitionBy("q").orderBy("bin")).alias("lowest"))
        limits = vectors.sparkSession.createDataFrame(
            pa.table({"q": pa.array(range(len(ids)), pa.int32()), "wanted": pa.array(wanted)})
        )
        chosen = (
            placed.join(F.broadcast(limits), "q")
            .filter("above < wanted and (above + n >= wanted or lowest = 1)")
            .select("q", "bin", "above")
            .toArrow()
        )
        q, place, before = (chosen.column(c).to_numpy() for c in ("q", "bin", "above"))
        low[q] += place.astype(low.dtype) * width
        wanted[q] -= before
        if width == 1:
            break
        width //= BINS
    return vectors.mapInArrow(
        partial(_above, block=block, kth=context.broadcast(low), k=k), "query_id long, vec_id long, score long"
    )


def top_k(rows: DataFrame, queries: Column, k: int = 20, block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest integer inner products, all if fewer.

    ``rows``: vec_id, vector (array<long>); rows with a null id or vector take no part. ``queries`` says
    which rows are queries; each is compared with every row of its dimension whose vec_id is
    another. Ties go to the smaller vec_id. Queries are taken ``block`` at a time, in order of
    vec_id, so what is broadcast or gathered is bounded: a block's vectors, and a bin per query.
    A score beyond a long is the nearest of -(2^63 - 1) and 2^63 - 1, and ties with others there.
    Repeated rows count each; the result lists repeated queries once. An empty table gives no rows.
    """
    spark = rows.sparkSession
    tasks_import(spark)
    kept = park(rows.filter("vec_id is not null and vector is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector", queries.alias("is_query")), "vectors")
    magnitude = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    dims = kept.groupBy(F.size("vector").alias("dim")).agg(F.max(magnitude).alias("largest"), F.count_if("is_query").alias("n")).collect()
    parts = []
    for kind in sorted(dims, key=lambda r: r["dim"]):
        if not kind["n"] or not kind["dim"]:
            continue
        vectors = kept.filter(F.size("vector") == kind["dim"]).select("vec_id", "vector")
        asked = kept.filter((F.size("vector") == kind["dim"]) & F.col("is_query"))
        after = None
        while True:
            rest = asked if after is None else asked.filter(F.col("vec_id") > after)
            taken = rest.dropDuplicates(["vec_id"]).orderBy("vec_id").limit(block).select("vec_id", "vector").toArrow()
            if not taken.num_rows:
                break
            ids = taken.column(0).to_numpy()
            matrix = _matrix(taken.column(1).combine_chunks(), kind["dim"])
            parts.append(park(_search(vectors, ids, matrix, kind["largest"] or 0, k), "top-k"))
            after = int(ids[-1])
            if taken.num_rows < block:
                break
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
