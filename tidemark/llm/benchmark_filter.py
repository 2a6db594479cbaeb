"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, joined with all
word windows of the training texts. DataFrame functions only.

Every word is hashed once, and a window's 64-bit hash is made of its words' hashes. Windows whose hash an item's
window has are then compared word by word, so a hit is equal words. Texts are read once, where they lie; only
windows that hit, and one row per document, are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import replaced, row_key, spare, without
from tidemark.llm.storage import park

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words of lower-cased text
OUTSIDE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of words, before lower-casing
PIECES = OUTSIDE.replace("[", "[^") + "+" + OUTSIDE + "*"
SEGMENT = 4096  # words that are cut into windows at a time
BROADCAST_WINDOWS = 250_000  # of about 100 bytes; a larger set is joined by shuffling hashes


def words(text: str = "text") -> Column:
    """The words of a text: A-Z lower-cased, cut at ASCII characters other than letters and digits."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, BREAKS), "")


def _hashes(listed: Column) -> Column:
    return F.transform(listed, lambda w: F.xxhash64(w))


def _windows(hashes: Column, length: int, last: Column) -> Column:
    """Hashes of the windows of ``length`` words that start at 1..last, in order."""
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, length)))


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """gram, length, item_ids (as strings) of every window of ``n`` words, or of the whole of a shorter item."""
    listed = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n)).alias("length")
    grams = F.transform(
        F.sequence(F.lit(1), F.size("w") - F.least(F.size("w"), F.lit(n)) + 1),
        lambda i: F.array_join(F.slice("w", i, F.least(F.size("w"), F.lit(n))), " "),
    )
    return (
        listed.select("item_id", length, F.explode(grams).alias("gram"))
        .groupBy("gram", "length")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Per row of ``docs``: row_key, doc_id, n_words, n_hit, hits (start and length of each window
    that occurs, from word 1), item_ids (as sorted strings).

    A word inside any occurrence of an item's window is hit, and counts once. A null or empty
    text has no words. Items without words take no part; hits of an item whose id is null count,
    but it is not listed. Repeated rows stay repeated. With an empty benchmark nothing is hit.
    """
    grams = item_windows(benchmark, n).withColumn("hash", F.xxhash64(_hashes(F.split("gram", " "))))
    sizes = grams.groupBy("length").count().collect()  # n rows at most
    small = sum(r["count"] for r in sizes) <= BROADCAST_WINDOWS
    lengths = sorted(r["length"] for r in sizes)
    listed = docs.select(
        F.monotonically_increasing_id().alias("rid"), row_key().alias("row_key"), "doc_id", words().alias("w")
    )
    n_words = F.size("w")
    segments = listed.select(
        "rid", "row_key", "doc_id", n_words.alias("n_words"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n_words - 1, F.lit(0)), F.lit(SEGMENT)),
                lambda s: F.struct(s.alias("before"), F.slice("w", s + 1, SEGMENT + n - 1).alias("w")),
            )
        ).alias("s"),
    ).select("rid", "row_key", "doc_id", "n_words", "s.before", "s.w", _hashes(F.col("s.w")).alias("h"))
    last = [F.least(F.lit(SEGMENT), F.size("w") - k + 1) for k in lengths]
    last_of = [F.least(F.lit(SEGMENT), F.col("size") - k + 1) for k in lengths]
    # for each length all windows' hashes one after the other; the first of them all stands for the row
    hashed = reduce(F.concat, [_windows(F.col("h"), k, at) for k, at in zip(lengths, last)], F.array(F.lit(None).cast("long")))
    own = ["rid", "row_key", "doc_id", "n_words", "before"]
    entries = segments.select(*own, F.size("w").alias("size"), *(["w"] if small else []), F.posexplode(hashed).alias("place", "hash"))
    alone = F.col("place") == 0
    hits = entries.join(F.broadcast(grams) if small else grams, "hash", "left").filter("gram is not null or place = 0 and before = 0")
    if not small:  # hashes alone are shuffled to so many windows; the words come back to what they hit
        hits = park(hits, "window-hits")
        texts = segments.select("row_key", "before", "w").dropDuplicates(["row_key", "before"])
        hits = hits.join(texts, ["row_key", "before"])
    # where in its own length's windows a place lies
    passed, at = F.lit(0), F.lit(None).cast("int")
    for k, count in zip(lengths, last_of):
        at = F.when(F.col("length") == k, F.col("place") - passed).otherwise(at)
        passed = passed + F.greatest(count, F.lit(0))
    same = F.array_join(F.slice("w", F.col("start"), F.col("length")), " ") == F.col("gram")
    found = (
        hits.withColumn("start", at)
        .filter(alone | F.when((F.col("start") >= 1) & (F.col("start") + F.col("length") - 1 <= F.col("size")), same))
        .select(
            "rid", "row_key", "doc_id", "n_words", "length", "item_ids", (F.col("before") + F.col("start")).alias("at")
        )
    )
    per_row = found.groupBy("rid").agg(
        F.first("row_key").alias("row_key"),
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("length").isNotNull(), F.struct("at", "length")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), h["at"] + h["length"] - 1 - F.greatest(s["upto"], (h["at"] - 1).cast("long")))).alias("n"),
            F.greatest(s["upto"], (h["at"] + h["length"] - 1).cast("long")).alias("upto"),
        ),
        lambda s: s["n"],
    )
    return per_row.select(
        "row_key", "doc_id", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), "hits", "item_ids"
    )


def contaminated(share: int = 20) -> Column:
    """At least one in ``share`` words is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) without the words that are hit
    and what stands between them and the next word. Columns as they were."""
    hits = find_hits(docs, benchmark, n)
    if remove == "documents":
        return without(docs, hits.filter(contaminated()))
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    key, gone = spare("key", docs), spare("gone", docs)
    cuts = hits.filter("n_hit > 0").groupBy("row_key").agg(F.first("hits").alias(gone)).withColumnRenamed("row_key", key)
    joined = docs.withColumn(key, row_key()).join(cuts, key, "left")
    first = F.regexp_extract("text", "^" + OUTSIDE + "*", 0)
    hit = F.flatten(F.transform(gone, lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1)))
    kept = F.filter(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)), lambda _, i: ~F.array_contains(hit, i + 1))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat(first, F.array_join(kept, "")))
    return joined.select(*replaced(docs, text=text))
