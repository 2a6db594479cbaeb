"""The pipeline operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arc_convert, benchmark_filter, bitplane_store, bloom_language_model, grouped_packing, histogram_topk, host_reputation, jaccard_join, line_templates, oracles, separator_scan, spectral_whitening, token_alignment, toxic_segments

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
END_OF_TEXT = 49407  # <|endoftext|> of that file


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files of all documents' ids."""
    rows = separator_scan.write_flat(table(spark, sf_dir, "documents"), tokenizer_path(), END_OF_TEXT)
    counted = separator_scan.count_tokens(rows.select("path"), END_OF_TEXT)
    shard = F.regexp_extract("path", r"tokens-(\d+)-", 1).cast("int").alias("shard")
    return rows.join(counted, ["path", "doc_no"]).select("doc_id", shard, "doc_no", "start", "n_tokens", "ended")


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC archives, converted to WARC and read back."""
    archives = arc_convert.write_arc(table(spark, sf_dir, "pages"))
    records = arc_convert.park(arc_convert.survey(archives), "arc-records")
    warcs = arc_convert.convert(archives, records, least=0)
    return arc_convert.read_warc(warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines whose template recurs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_templates.drop_lines(docs, long_tokens=20)
    dropped = F.col("n_dropped").cast("long").alias("n_dropped")
    return left.select("doc_id", dropped, F.length("text").cast("long").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors, by integer inner product, for every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", histogram_topk.quantized("embedding").alias("vector"))
    return histogram_topk.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op5_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from bit-plane files of all ids."""
    files = bitplane_store.write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return bitplane_store.read_documents(files)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles."""
    found = jaccard_join.join_documents(table(spark, sf_dir, "documents"), width=5, share=80)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return grouped_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host of every page, and whether the labelled document that its url numbers is toxic or of low quality. A
    number of more than 18 digits is none of a document. Pages without a number need no join."""
    number = F.regexp_extract(host_reputation.path_of(), "/([0-9]{1,18})([^0-9]|$)", 1)
    pages = table(spark, sf_dir, "pages").select(
        host_reputation.host_of().alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")
    )
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    others = pages.filter("doc_id is null").select("host", F.lit(None).cast("int").alias("bad"))
    return pages.filter("doc_id is not null").join(known, "doc_id", "left").select("host", "bad").unionAll(others)


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block every page by the rules, else by its host's reputation."""
    outcomes = page_outcomes(spark, sf_dir)
    judged = host_reputation.judge(table(spark, sf_dir, "pages"), outcomes, oracles.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxic_segments.score(docs, toxic_segments.fit(docs, table(spark, sf_dir, "labels")))
    held_out = (toxic_segments.fold() == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op10_benchmark_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of 13 words of benchmark items, and how much of them."""
    found = benchmark_filter.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        benchmark_filter.contaminated().alias("contaminated"),
    )


def op11_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a trigram model, and under exact word shares."""
    return bloom_language_model.score_documents(table(spark, sf_dir, "documents"), order=3)


def op12_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened on the first four components of the distinct ones."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", spectral_whitening.quantized("embedding").alias("vector"))
    return spectral_whitening.whiten(rows, components=4)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document."""
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_line_templates": op3_line_templates,
    "op4_histogram_topk": op4_histogram_topk,
    "op5_bitplane_ids": op5_bitplane_ids,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_grouped_packing": op7_grouped_packing,
    "op8_host_reputation": op8_host_reputation,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_benchmark_filter": op10_benchmark_filter,
    "op11_bloom_language_model": op11_bloom_language_model,
    "op12_spectral_whitening": op12_spectral_whitening,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op2_arc_to_warc": oracles.OP2,
    "op3_line_templates": oracles.OP3,
    "op4_histogram_topk": oracles.OP4,
    "op8_host_reputation": oracles.OP8,
    "op10_benchmark_filter": oracles.OP10,
}
