"""Token counts of documents in flat token files, found by their end-of-document ids.

A flat file is nothing but ids of fixed width, each document's ended by a separator. Files
are read in blocks by independent tasks. What a block can't know, where the document that
reaches into it began and how many ended before, comes from a prefix scan over the blocks'
summaries.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import input_file, output_file, park, scratch_path, slices, tasks_import
from tidemark.llm.tokens import text_encoder

FAN = 4096  # blocks that one task of the scan takes together


def _flatten(batches, tokenizer: str, separator: int, folder: str):
    encoder = text_encoder(tokenizer, plain_specials=True)
    end = np.asarray([separator], dtype=encoder.dtype).tobytes()
    part, path, target, n = TaskContext.get().partitionId(), None, None, 0
    for batch in slices(batches, 512):
        if target is None:
            path, target = output_file(folder, f"tokens-{part:06d}")
        for raw in encoder.encode(batch.column(1)):
            target.write(raw + end)
        rows = batch.num_rows
        yield pa.record_batch(
            [pa.array([path] * rows), pa.array(range(n, n + rows), pa.int64()), batch.column(0)],
            ["path", "doc_no", "doc_id"],
        )
        n += rows
    encoder.forget()
    if target is not None:
        target.close()


def write_flat(docs: DataFrame, tokenizer: str, separator: int) -> DataFrame:
    """Encode every text where it is read and append it, with the separator, to a flat file of
    its task; returns which document went where: path, doc_no, doc_id.

    Text that spells a special token is encoded as ordinary text, so that the separator ends
    documents only. A null text is empty. Rows are written in the order they are read.
    """
    spark = docs.sparkSession
    tasks_import(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = scratch_path(spark, "flat-tokens")
    written = rows.mapInArrow(
        partial(_flatten, tokenizer=tokenizer, separator=separator, folder=folder),
        "path string, doc_no long, doc_id long",
    )
    return park(written, "flat-token-rows")


def _sizes(batches):
    for batch in batches:
        sizes = []
        for path in batch.column(0).to_pylist():
            with input_file(path) as source:
                sizes.append(source.size())
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])


def _search(batches, separator: int, width: int):
    for batch in batches:
        for row in batch.to_pylist():
            with input_file(row["path"]) as source:
                source.seek(row["first"] * width)
                ids = np.frombuffer(source.read(row["n"] * width), dtype=f"<u{width}")
            ends = np.flatnonzero(ids == separator).astype(np.int64) + row["first"]
            yield pa.RecordBatch.from_pylist(
                [row | {"ends": ends.tolist(), "n_ends": len(ends), "last": int(ends[-1]) if len(ends) else -1}],
                pa.schema(
                    [("path", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64())]
                    + [("final", pa.bool_()), ("ends", pa.list_(pa.int64())), ("n_ends", pa.int64()), ("last", pa.int64())]
                ),
            )


def count_tokens(paths: DataFrame, separator: int, width: int = 2, block_ids: int = 1 << 22) -> DataFrame:
    """One row per document of the flat files in ``paths`` (column path): path, doc_no (from 0),
    start (ids before it in the file), n_tokens (without the separator), ended.

    ``ended`` is false for ids behind a file's last separator. Two separators in a row make a
    document of no tokens; an empty file has no document. Bytes beyond a whole number of ids
    are an error. Memory: one block per task, whatever the length of a file or a document.
    """
    tasks_import(paths.sparkSession)
    tasks = paths.sparkSession.sparkContext.defaultParallelism
    sized = paths.select("path").distinct().repartition(tasks).mapInArrow(_sizes, "path string, bytes long")
    checked = sized.withColumn(
        "ids", F.when(F.col("bytes") % width == 0, (F.col("bytes") / width).cast("long")).otherwise(
            F.raise_error(F.concat(F.lit("not a whole number of ids: "), F.col("path"))).cast("long"))
    ).filter("ids > 0")
    last = F.floor((F.col("ids") - 1) / block_ids)
    blocks = checked.select("path", "ids", last.alias("end"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).select(
        "path", "block", (F.col("block") * block_ids).alias("first"),
        F.least(F.lit(block_ids).cast("long"), F.col("ids") - F.col("block") * block_ids).alias("n"),
        (F.col("block") == F.col("end")).alias("final"),
    )
    spread = blocks.repartition(4 * tasks)
    found = park(
        spread.mapInArrow(
            partial(_search, separator=separator, width=width),
            "path string, block long, first long, n long, final boolean, ends array<long>, n_ends long, last long",
        ),
        "separators",
    )
    span = F.floor(F.col("block") / FAN).alias("span")
    summary = found.select("path", "block", span, "n_ends", "last")
    inner = Window.partitionBy("path", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("path").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        summary.groupBy("path", "span").agg(F.sum("n_ends").alias("n_ends"), F.max("last").alias("last"))
        .select("path", "span", F.coalesce(F.sum("n_ends").over(outer), F.lit(0)).alias("ended_before"),
                F.coalesce(F.max("last").over(outer), F.lit(-1)).alias("last_before"))
    )
    carried = (
        summary.select("path", "span", "block", F.coalesce(F.sum("n_ends").over(inner), F.lit(0)).alias("in_span"),
                       F.coalesce(F.max("last").over(inner), F.lit(-1)).alias("last_in_span"))
        .join(spans, ["path", "span"])
        .select("path", "block", (F.col("ended_before") + F.col("in_span")).alias("doc_base"),
                F.greatest("last_before", "last_in_span").alias("carry"))
    )
    stitched = found.join(carried, ["path", "block"])
    # the document behind the last separator of a file has its end one past the last id
    open_end = F.col("first") + F.col("n")
    trailing = F.col("final") & (F.greatest("carry", "last") + 1 < open_end)
    ends = F.when(trailing, F.concat("ends", F.array(open_end))).otherwise(F.col("ends"))
    documents = stitched.select("path", "doc_base", "carry", "n_ends", ends.alias("ends"))
    return documents.select(
        "path",
        F.posexplode(F.arrays_zip(F.col("ends").alias("end"), F.concat(F.array("carry"), F.col("ends")).alias("previous"))).alias("i", "e"),
        "doc_base",
        "n_ends",
    ).filter("e.end is not null").select(
        "path",
        (F.col("doc_base") + F.col("i")).alias("doc_no"),
        (F.col("e.previous") + 1).alias("start"),
        (F.col("e.end") - F.col("e.previous") - 1).alias("n_tokens"),
        (F.col("i") < F.col("n_ends")).alias("ended"),
    )
