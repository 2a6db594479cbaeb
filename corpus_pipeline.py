"""From raw documents to packed training sequences, one operator a stage.

A stage takes what the one before kept, read back from a table, and its decisions hold for all
that follow: toxic documents go, recurring lines go, of near-duplicates one stays, documents with
benchmark passages go, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import benchmark_filter, grouped_packing, jaccard_join, line_templates, shared_passages, toxic_segments
from tidemark.llm.benchmark_filter import words
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.rows import spare
from tidemark.llm.storage import park


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from the labels does not hold to be toxic."""
    return toxic_segments.reject(docs, toxic_segments.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur in three documents or more, lines of 20 tokens and more in two, but
    for the first, also where their words differ in up to half of the places; a document of which nothing is left goes. ``n_chars`` follows the text."""
    lines, passages = spare("n_lines_cut", docs), spare("n_passages_cut", docs)
    left = park(line_templates.drop_lines(docs, count_as=lines, long_tokens=20), "lines-dropped")
    left = shared_passages.drop_passages(left, n=50, count_as=passages)
    cut = (F.col(lines) > 0) | (F.col(passages) > 0)
    empty = (F.trim("text") == "") | (F.col(passages) > 0) & (F.size(words()) == 0)
    left = left.filter(~cut | ~empty)
    kind = docs.schema["n_chars"].dataType
    n_chars = F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return left.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents with a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, width=5, share=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    return benchmark_filter.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=13, remove="documents")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return grouped_packing.pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = park(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
