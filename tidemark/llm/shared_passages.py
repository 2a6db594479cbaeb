"""Passages that recur in other documents, wherever they start. DataFrame functions only.

A window of ``n`` words that a document before has as well is cut out, with what stands between its
words. Not all windows are compared: of every ``n // 2`` words in a row the one with the least hash is
an anchor, and the words from there on are its print. Equal windows hold equal prints, so windows are
hashed and shuffled only around prints that recur, and none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.benchmark_filter import OUTSIDE, PIECES, words
from tidemark.llm.rows import replaced, row_key, spare
from tidemark.llm.storage import park, release

SEGMENT = 4096  # windows that are made at a time
PLACE = (1 << 16) - 1  # bits of an anchor that hold its place in the segment


def _segments(docs: DataFrame, n: int, *more: str) -> DataFrame:
    """row_key, doc_id, before, h: hashes of the words in pieces in which ``SEGMENT`` windows start."""
    hashes = F.transform(words(), lambda w: F.xxhash64(w)).alias("w")
    listed = docs.select("row_key", F.col("doc_id").cast("long").alias("doc_id"), *more, hashes).filter(F.size("w") >= n)
    cut = listed.withColumn("before", F.explode(F.sequence(F.lit(0), F.size("w") - n, F.lit(SEGMENT))))
    return cut.select("row_key", "doc_id", *more, "before", F.slice("w", F.col("before") + 1, SEGMENT + n - 1).alias("h"))


def _prints(docs: DataFrame, n: int) -> DataFrame:
    """row_key, at (from word 1), print of the anchors of all windows of ``n`` words."""
    half = n // 2
    low = F.lit(PLACE).cast("long")
    placed = F.transform("h", lambda h, i: h.bitwiseAND(F.lit(~PLACE).cast("long")).bitwiseOR(i.cast("long")))
    segments = _segments(docs, n).withColumn("placed", placed)
    least = F.transform(F.sequence(F.lit(1), F.size("h") - n + 1), lambda i: F.array_min(F.slice("placed", i, half)))
    anchors = F.transform(F.array_distinct(least), lambda v: v.bitwiseAND(low).cast("int"))
    at = segments.select("row_key", "before", "h", F.explode(anchors).alias("i"))
    # a window's anchor is at most half - 1 words behind its start, so the print ends within the window
    return at.select("row_key", (F.col("before") + F.col("i") + 1).alias("at"), F.xxhash64(F.slice("h", F.col("i") + 1, n - half + 1)).alias("print"))


def _spans(starts: Column, n: int) -> Column:
    """First and last word of each stretch that windows from these sorted starts cover."""
    before, behind = (lambda i: F.get(starts, i - 1)), (lambda i: F.get(starts, i + 1))
    firsts = F.filter(starts, lambda s, i: F.coalesce(s > before(i) + n, F.lit(True)))
    lasts = F.filter(starts, lambda s, i: F.coalesce(behind(i) > s + n, F.lit(True)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b + n - 1).alias("last")))


def recurring_passages(docs: DataFrame, n: int = 50) -> DataFrame:
    """row_key and ``spans`` (first and last, from word 1) of the words in windows of ``n`` words that a
    document before has as well.

    Words are those of ``benchmark_filter``, compared as 64-bit hashes. The document with the smallest
    doc_id (null first) keeps a window. Rows with equal doc_id and text are one document.
    """
    keyed = docs.select(row_key().alias("row_key"), "doc_id", "text")
    spark = docs.sparkSession
    prints = park(_prints(keyed, n), "prints")
    release(spark)
    several = F.min("row_key") != F.max("row_key")
    # parked, so that the joins below deal out both sides and may split a passage of very many documents
    again = park(prints.groupBy("print").agg(several.alias("several")).filter("several").select("print"), "recurring-prints")
    places = park(prints.join(again, "print").groupBy("row_key").agg(F.collect_set("at").alias("places")), "places")
    parts = _segments(keyed.join(places, "row_key"), n, "places")
    last = F.size("h") - n + 1
    here = F.filter(F.transform("places", lambda p: p - F.col("before")), lambda p: (p >= 1) & (p - n // 2 + 1 <= last))
    starts = F.flatten(F.transform(here, lambda p: F.sequence(F.greatest(F.lit(1), p - n // 2 + 1), F.least(last, p))))
    at = parts.select("row_key", "doc_id", "before", "h", F.explode(F.array_distinct(starts)).alias("i"))
    window = F.xxhash64(F.slice("h", F.col("i"), n)).alias("window")
    windows = park(at.select("row_key", "doc_id", (F.col("before") + F.col("i")).alias("at"), window), "windows")
    release(spark, prints, again, places)
    first = F.min(F.struct("doc_id", "row_key"))["row_key"].alias("first")
    firsts = park(windows.groupBy("window").agg(first, several.alias("several")).filter("several").drop("several"), "recurring-windows")
    cut = windows.join(firsts, "window").filter("row_key <> first").groupBy("row_key").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    cut = park(cut, "passage-starts")
    release(spark, windows, firsts)
    return cut.select("row_key", _spans(F.col("starts"), n).alias("spans"))


def drop_passages(docs: DataFrame, n: int = 50, count_as: str = "n_passages") -> DataFrame:
    """``docs`` with recurring passages cut out of their texts, and the number of passages as ``count_as``.

    No row is dropped: a text without any other word keeps what stands before its first. Other columns stay as they
    were, whatever their names; only one that is called ``count_as`` gives way to the number.
    """
    key, gone = spare("key", docs), spare("gone", docs)
    spans = recurring_passages(docs, n).select(F.col("row_key").alias(key), F.col("spans").alias(gone))
    joined = docs.withColumn(key, row_key()).join(spans, key, "left")
    pieces = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(gone, lambda s: (s["first"] <= i + 1) & (i + 1 <= s["last"])))
    cut = F.concat(F.regexp_extract("text", "^" + OUTSIDE + "*", 0), F.array_join(kept, ""))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(cut)
    n_passages = F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0))
    return joined.select(*replaced(docs, count_as, text=text), n_passages.alias(count_as))
