r"""Line dedup by a tree of log templates. DataFrame functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens,
those with a digit being variable. Below the leaf tokens are compared place by place; digits are equal
to one another. A token in its place that ``least`` lines of the leaf have is constant, any other is variable; a
line of whose tokens enough are constant has two kinds of templates:

* that of its constant tokens: lines with the same ones have one template, so equal lines always do;
* each line that it follows: the first line is looked up of every token, and a line follows those that are the
  first for enough of its tokens. So lines have one template although different tokens of theirs vary.

A template that recurs in ``least`` documents is dropped, but for the first of them.

Only hashes of lines are shuffled to find templates. Counts are partial sums, and the joins on a
leaf, kind, token or template that very many lines have may be split. Equal lines count as one with a
weight, so copies cost no tokens; tokens are stored as one array of hashes, rows per token only pass through shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import replaced, row_key, spare
from tidemark.llm.storage import park, release

SAME = ("123456789\t\r\f\v", "000000000    ")


def tokens(line: str | Column) -> Column:
    line = F.col(line) if isinstance(line, str) else line
    # to translate takes longer than to see that most lines have none of these characters
    same = F.when(F.rlike(line, F.lit("[1-9\\t\\r\\f\\x0B]")), F.translate(line, *SAME)).otherwise(line)
    return F.array_remove(F.split(same, " "), "")


def _tokens(docs: DataFrame, min_tokens: int, *more: str) -> DataFrame:
    """row_key, doc_id, at (from 0), tokens ``t`` of every line of at least ``min_tokens`` tokens."""
    # the filter stays above what makes its column here; below, lines would be parsed for it once more
    split = F.posexplode(F.transform(F.split("text", "\n"), tokens)).alias("at", "t")
    found = docs.select("row_key", F.col("doc_id").cast("long").alias("doc_id"), *more, split)
    return found.select("row_key", "doc_id", "at", *more, "t").filter(F.size("t") >= min_tokens)


def line_kinds(docs: DataFrame, depth: int, min_tokens: int, least: Column) -> tuple[DataFrame, DataFrame]:
    """The lines whose leaf has at least ``least`` lines: row_key, doc_id, at, least, kind; and their kinds (equal lines
    are one): kind, no (in the order of their first lines), n (lines), leaf, least, marks (hashes of the tokens
    below the leaf in their places). Rows with equal doc_id and text are one line each."""
    spark = docs.sparkSession
    keyed = docs.select(row_key().alias("row_key"), "doc_id", "text")
    lead = F.transform(F.slice("t", 1, depth), lambda t: F.when(F.contains(t, F.lit("0")), "<*>").otherwise(t))
    rest = F.when(F.size("t") > depth, F.slice("t", depth + 1, F.size("t"))).otherwise(F.array(F.lit("")))
    leaf = F.xxhash64(F.size("t"), lead)
    parsed = _tokens(keyed, min_tokens).select("row_key", "doc_id", "at", leaf.alias("leaf"), least.alias("least"), F.xxhash64(leaf, rest).alias("kind"))
    lines = park(parsed, "lines")
    # parked, so that the join below deals out both sides and may split a leaf of very many lines
    leaves = park(lines.groupBy("leaf", "least").agg(F.count("*").alias("k")).filter("k >= least").select("leaf"), "leaves")
    shared = park(lines.join(leaves, "leaf").distinct(), "shared-lines")
    release(spark, lines, leaves)
    first = F.min(F.struct("doc_id", "row_key", "at")).alias("first")
    kinds = shared.groupBy("kind", "leaf", "least").agg(F.count("*").alias("n"), first)
    # ranges of places in order, so that the numbers follow it
    ordered = kinds.repartitionByRange("first").sortWithinPartitions("first")
    kinds = park(ordered.withColumn("no", F.monotonically_increasing_id()), "line-kinds")
    # the texts that have a kind's first line are read again, so that tokens are written once a kind
    own = F.struct("kind", "no", "n", "leaf", "least")
    wanted = park(kinds.groupBy("first.row_key").agg(F.map_from_entries(F.collect_list(F.struct("first.at", own))).alias("of")), "wanted-lines")
    texts = keyed.join(wanted, "row_key").dropDuplicates(["row_key"])
    again = _tokens(texts, min_tokens, "of").withColumn("of", F.col("of")[F.col("at")]).filter("of is not null")
    marked = park(again.select("of.*", F.transform(rest, lambda t, j: F.xxhash64(F.col("of.leaf"), j, t)).alias("marks")), "kind-tokens")
    release(spark, kinds, wanted)
    return shared, marked


def templates_of(kinds: DataFrame, constant: float) -> DataFrame:
    """kind, template: the templates of the kinds of lines of whose marks at least the share ``constant`` is constant.
    ``kinds`` is void then."""
    spark, each = kinds.sparkSession, F.explode("marks").alias("mark")
    enough = F.sum("n") >= F.first("least")
    tokens_in = kinds.select("no", "n", "least", each)
    common = park(tokens_in.groupBy("mark").agg(enough.alias("enough")).filter("enough").select("mark"), "constant-tokens")
    release(spark)
    # marks of a line differ in their places, so the sum without carry tells sets of them apart
    held = tokens_in.select("no", "mark").join(common, "mark", "left_semi").groupBy("no").agg(F.count("*").alias("k"), F.bit_xor("mark").alias("set"))
    taking = kinds.join(held, "no").filter(F.col("k") >= constant * F.size("marks"))
    taking = park(taking.select("kind", "no", "n", "least", "marks", F.xxhash64("leaf", "set").alias("template")), "kinds-taking-part")
    release(spark, common, kinds)
    first = taking.select("no", "n", "least", each).groupBy("mark").agg(F.min("no").alias("leader"), enough.alias("enough")).filter("enough")
    first = park(first.select("mark", "leader"), "first-lines")
    release(spark)
    votes = taking.select("no", each).join(first, "mark").groupBy("no", "leader").agg(F.count("*").alias("votes"))
    of_leader = taking.drop("template").join(votes, "no").filter(F.col("votes") >= constant * F.size("marks"))
    by_leader = F.xxhash64(F.lit("leader"), "leader").alias("template")
    found = park(taking.select("kind", "template").unionAll(of_leader.select("kind", by_leader)), "kind-templates")
    release(spark, taking, first)
    return found


def recurring_lines(
    docs: DataFrame, depth: int = 4, min_tokens: int = 5, min_docs: int = 3, constant: float = 0.5, long_tokens: int | None = None, long_docs: int = 2
) -> DataFrame:
    """row_key and the positions (``dropped``) of the lines of each document that go.

    Lines end at a line feed. Lines of fewer than ``min_tokens`` tokens stay. A template has to occur in
    ``min_docs`` documents, one of ``long_tokens`` tokens and more, if given, only in ``long_docs``. The document with the
    smallest doc_id (null first) keeps its lines of a template. Rows with equal doc_id and text
    are one document. Null texts have no lines.
    """
    least = F.lit(min_docs) if long_tokens is None else F.when(F.size("t") >= long_tokens, long_docs).otherwise(min_docs)
    shared, kinds = line_kinds(docs, depth, min_tokens, least)
    templates = templates_of(kinds, constant)
    lines = park(shared.select("row_key", "doc_id", "at", "least", "kind").join(templates, "kind").drop("kind"), "templates")
    release(docs.sparkSession, shared, templates)
    per_doc = lines.groupBy("template", "least", "row_key").agg(F.min("doc_id").alias("doc_id"))
    templates = per_doc.groupBy("template", "least").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "row_key")).alias("first"))
    recurring = park(templates.filter("docs >= least").select("template", "first"), "recurring")
    again = lines.join(recurring, "template").filter("row_key <> first.row_key")
    return again.groupBy("row_key").agg(F.collect_set("at").alias("dropped"))


def without_lines(text: str, dropped: str) -> Column:
    """The text without the lines at these positions."""

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # as an argument the lines are split once, not once more for each that stays
    cut = F.get(F.transform(F.array(F.split(text, "\n")), left), F.lit(0))
    return F.when(F.col(dropped).isNull(), F.col(text)).otherwise(cut)


def drop_lines(docs: DataFrame, count_as: str = "n_dropped", **parameters) -> DataFrame:
    """``docs`` with recurring lines cut out of their texts, and the number of them as ``count_as``.

    No row is dropped: a text all of whose lines go is empty. Other columns stay as they were, whatever their
    names; only one that is called ``count_as`` gives way to the number.
    """
    key, gone = spare("key", docs), spare("gone", docs)
    found = recurring_lines(docs, **parameters).select(F.col("row_key").alias(key), F.col("dropped").alias(gone))
    joined = docs.withColumn(key, row_key()).join(found, key, "left")
    n = F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0))
    return joined.select(*replaced(docs, count_as, text=without_lines("text", gone)), n.alias(count_as))
