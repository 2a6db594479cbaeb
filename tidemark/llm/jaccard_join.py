"""Exact Jaccard join of documents on word shingles, in the metric space of sets.

The distance 1 - |A & B| / |A | B| is a metric. Unrelated texts share no shingle and are all at
distance 1 from one another and from any pivot taken among the texts, so such pivots alone split
nothing. The first pivots are therefore the sets of one shingle each: a text lies near the pivots
of its own shingles and at distance 1 from all others. Its region is that of its first shingle in
an order common to all texts, and the window within which a linked text must be replicated covers
its first n - ceil(0.8 n) + 1: a set of n shingles keeps at least 0.8 n of them in a link, so two
linked sets meet in a region. The order puts shingles that many texts have last, by a table of
levels from the shingles that several sets of a task's chunk have.

Within a region sizes are a second, one-dimensional window (linked sizes differ by a factor of
0.8 at most), and two texts are compared only where their first common shingle may lie. Ordinary
shingles whose regions turn out crowded are put behind as well, and the prefixes made anew: any
order is exact, so this only thins the regions. Then texts are compared with a pivot text of each
region, and those outside a region's main component with a few more. What is linked becomes one
component, and only pairs of different components are left to compare. Regions in which these are
few for the number of texts are joined, each text outside the main component with all others;
other regions after a split into the Voronoi regions of several pivot texts, a text being
replicated to each pivot that is no more than twice the link distance farther than its nearest.
That goes on until no such region is left, or one can't be split and is joined as well.

Pairs whose prefixes have too little in common for a link are put aside first; distances of the
others come from whole sets. Sets are compared as 64-bit hashes; equal sets are one node.
Two different shingles or sets with one hash would be taken as equal, at odds of about 2^-64 a pair.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.rows import replaced, row_key, spare
from tidemark.llm.shingles import mix, shingle_sets
from tidemark.llm.storage import park, release, slices, tasks_import

CELL_BITS = 22
CELLS = 1 << CELL_BITS  # of the table of levels: 4 MB to a worker, at any size of input
CHUNK = 1 << 22  # shingles of which a task holds the counts at a time
COMMON = 8
MAX_FILTER = 1 << 27  # bits of a filter of nodes: 16 MB at most
SMALL = 64  # a region with up to half as many pairs a text between its components is joined pair by pair
PIVOTS = 4
TURNS = 3  # in which a few pivots a region join components before regions are compared or split, but for the first in large ones
PASSES = 2  # in which crowded regions may still change the order
SALTS = 64


def _node(found: np.ndarray) -> int:
    """One number for a set: sums of two mixes and the size, mixed again."""
    a = mix(found + np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(found ^ np.uint64(0xA0761D6478BD642F)))
    return int(mix(np.asarray([a + np.uint64(len(found))]) ^ mix(np.asarray([b])))[0].astype(np.int64))


def _cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _read(batches, width: int):
    """(other columns, sets of the texts) of small batches; text is the last column."""
    for batch in slices(batches, 512, 2 << 20):
        yield batch.columns[:-1], shingle_sets(batch.column(batch.num_columns - 1), width)


def _nodes(batches, width: int):
    """A row per text, and one per shingle that several different sets of a chunk of this task have: how many."""

    def counted(chunk: dict):
        shingles, counts = np.unique(np.concatenate(list(chunk.values())), return_counts=True)
        several = counts > 1
        shingles, counts = shingles[several].astype(np.int64), counts[several]
        none = pa.nulls(len(counts), pa.int64())
        return pa.record_batch([none, none, none, none, pa.array(shingles), pa.array(counts, pa.int64())], names)

    names = ["row_key", "doc_id", "n", "node", "shingle", "sets"]
    chunk, held = {}, 0
    for (keys, doc_ids), sets in _read(batches, width):
        nodes = [_node(s) if len(s) else None for s in sets]
        none = pa.nulls(len(nodes), pa.int64())
        yield pa.record_batch([keys, doc_ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), none, none], names)
        for node, found in zip(nodes, sets):
            if node is not None and node not in chunk:
                chunk[node] = found
                held += len(found)
        if held >= CHUNK:
            yield counted(chunk)
            chunk, held = {}, 0
    if chunk:
        yield counted(chunk)


def _level(sets: Column) -> Column:
    """How far last a shingle of so many sets stands: 0 below COMMON, else one more per doubling."""
    return F.when(sets >= COMMON, F.floor(F.log2(sets / COMMON)) + 1).otherwise(0).cast("int")


def _by_cell(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the shingles (shingle, sets) that don't stand first, and the level of each: CELLS rows at most."""
    cell = F.shiftrightunsigned("shingle", 64 - CELL_BITS).cast("int").alias("cell")
    found = counted.select(cell, _level(F.col("sets")).alias("level")).filter("level > 0").groupBy("cell").agg(F.max("level").alias("level")).toArrow()
    return found.column("cell").to_numpy().astype(np.int64), found.column("level").to_numpy().astype(np.uint8)


def levels(counted: DataFrame) -> np.ndarray:
    """Per cell of shingles the level of its most common one, from the counts (shingle, sets) of chunks.

    A shingle that chunks have once is not counted there, so counts are too small for some that few
    sets have. Any order of shingles is exact; a poor one costs time.
    """
    cells, found = _by_cell(counted.groupBy("shingle").agg(F.sum("sets").alias("sets")))
    standing = np.zeros(CELLS, dtype=np.uint8)
    standing[cells] = found
    return standing


def _prefixes(batches, width: int, share: int, standing):
    standing = standing.value
    for _, sets in _read(batches, width):
        rows = {}
        for found in sets:
            n = len(found)
            if not n or (node := _node(found)) in rows:
                continue
            level = standing[_cells(found)]
            kept = n - (share * n + 99) // 100 + 1
            first = np.lexsort((found, level))[:kept]
            rows[node] = (n, found[first].astype(np.int64), int((level[first] == 0).sum()))
        yield pa.record_batch(
            [
                pa.array(list(rows), pa.int64()),
                pa.array([r[0] for r in rows.values()], pa.int64()),
                pa.array([r[1] for r in rows.values()], pa.list_(pa.int64())),
                pa.array([r[2] for r in rows.values()], pa.int32()),
            ],
            ["node", "n", "pivots", "cold"],
        )


def _wanted_sets(batches, width: int, chosen):
    bits, mask = chosen.value
    for _, sets in _read(batches, width):
        rows = {}
        for found in sets:
            if len(found):
                node = _node(found)
                place = node & mask
                if bits[place >> 3] >> (place & 7) & 1:
                    rows[node] = found.astype(np.int64)
        if rows:
            yield pa.record_batch([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.list_(pa.int64()))], ["node", "items"])


def _filter_of(nodes: DataFrame) -> tuple[bytes, int]:
    """A bit per low bits of the nodes: a filter that lets all of them pass. Its size is bounded; a full
    filter lets everything pass, which costs time and changes nothing."""
    n = nodes.count()
    size = 1 << 15
    while size < min(MAX_FILTER, 64 * n):
        size *= 2
    place = F.col("node").bitwiseAND(F.lit(size - 1))
    rows = (
        nodes.select((F.bitmap_bucket_number(place + 1) - 1).alias("bucket"), F.bitmap_bit_position(place + 1).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )  # size / 32768 rows
    bits = bytearray(size // 8)
    for row in rows:
        at = row["bucket"] * 4096
        bits[at : at + 4096] = row["bits"]
    return bytes(bits), size - 1


def _compatible(a: Column, b: Column, share: int) -> Column:
    """Sizes of which the smaller is at least ``share`` percent of the larger."""
    return 100 * F.least(a, b) >= share * F.greatest(a, b)


def _may_start(a: str, b: str, share: int) -> Column:
    """Whether a link of two texts may have its first common shingle here: all that they share lies from their
    places of it on, in the ``rest`` of each. A link is looked for where this holds, which it does in one region at least."""
    rest, n = F.least(F.col(f"{a}rest"), F.col(f"{b}rest")), F.col(f"{a}n") + F.col(f"{b}n")
    return (100 + share) * rest >= share * n


def _region_rows(prefixes: DataFrame, share: int) -> DataFrame:
    """region, node, n, rest, and pivot_node, pivot_n, pivot_rest: the texts of each region of two or more, the number of
    their shingles from the region's on, and its pivot text.

    Regions of ordinary shingles hold no more texts than their cell's bound: each is sorted by
    size, where sizes too far apart part it. Regions of shingles that stand out may be of any
    size: their pivots come from partial minima and a join that can be split.
    """
    placed = prefixes.select("node", "n", "cold", F.posexplode("pivots").alias("i", "s")).withColumn("rest", F.col("n") - F.col("i"))
    ordinary = placed.filter("i < cold").select("node", "n", "rest", "s")
    by_size = Window.partitionBy("s").orderBy("n", "node")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    gap = before.isNull() | ~_compatible(before, F.col("n"), share)  # least() passes over nulls
    end = after.isNull() | ~_compatible(after, F.col("n"), share)
    runs = (
        ordinary.withColumn("gap", gap).withColumn("end", end).filter("not (gap and end)")
        .withColumn("run", F.sum(F.col("gap").cast("int")).over(by_size))
    )
    whole = Window.partitionBy("s", "run")
    first = F.min(F.struct("node", "n", "rest"))
    named = ["node", "n", "rest", *[F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in ("node", "n", "rest")]]
    cold = runs.withColumn("pivot", first.over(whole)).select(F.xxhash64("s", "run").alias("region"), *named)
    outstanding = placed.filter("i >= cold").select("node", "n", "rest", "s")
    firsts = outstanding.groupBy("s").agg(first.alias("pivot"), F.count("*").alias("k")).filter("k > 1")
    hot = outstanding.join(firsts, "s").select(F.xxhash64("s").alias("region"), *named)
    return cold.unionAll(hot)


def _one_of_equal(rows: DataFrame) -> DataFrame:
    """The rows with regions that hold the same texts made one, of each text the longest rest."""
    members = rows.groupBy("region").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("of"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("too"))
    same = members.select("region", F.xxhash64("k", "of", "too").alias("same"))
    return rows.join(same, "region").groupBy(F.col("same").alias("region"), "node", "n", "component").agg(F.max("rest").alias("rest"))


def _plausible(pairs: DataFrame, prefixes: DataFrame, share: int) -> DataFrame:
    """The pairs (u, v) whose prefixes have enough in common for a link.

    Of two prefixes in one order, what the sets share beyond the common part of both lies behind the
    end of the prefix that ends first. So they share at most that part and the longer rest.
    """
    side = lambda name: prefixes.select(
        F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("pivots").alias(f"p_{name}")
    )
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    rest = F.greatest(F.col("n_u") - F.size("p_u"), F.col("n_v") - F.size("p_v"))
    most = F.size(F.array_intersect("p_u", "p_v")) + rest
    return both.filter(100 * most >= share * (F.col("n_u") + F.col("n_v") - most)).select("u", "v")


def _sets_of(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, items of at least these nodes, by another pass over the texts."""
    chosen = texts.sparkSession.sparkContext.broadcast(_filter_of(nodes))
    passed = texts.select("text").mapInArrow(partial(_wanted_sets, width=width, chosen=chosen), "node long, items array<long>")
    return park(passed.groupBy("node").agg(F.first("items").alias("items")), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _measured(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The distance of each pair (u, v, distinct) and whether it is a link. The pairs are parked: few are broadcast."""
    sets = sets.join(_ends(pairs), "node", "left_semi")
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("left")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("items").alias("right")), "v")
    common = F.size(F.array_intersect("left", "right"))
    counted = both.select("u", "v", common.alias("common"), (F.size("left") + F.size("right") - common).alias("either"))
    return counted.select(
        "u", "v", (1 - F.col("common") / F.col("either")).alias("distance"), (100 * F.col("common") >= share * F.col("either")).alias("linked")
    )


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with their node's component so far."""
    named = labels.select(F.col("vertex").alias("node"), "component")
    return rows.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _undecided(rows: DataFrame) -> DataFrame:
    """The rows (region, node, n, rest, component) of regions that hold several components, with ``k``, the number of
    the region's rows, ``main``, its largest component, and ``apart``, how many pairs of rows are of different ones."""
    parts = rows.groupBy("region", "component").agg(F.count("*").alias("m"))
    spread = parts.groupBy("region").agg(
        F.sum("m").alias("k"), F.max(F.struct("m", "component"))["component"].alias("main"), F.sum(F.col("m") * F.col("m")).alias("within")
    )
    apart = ((F.col("k") * F.col("k") - F.col("within")) / 2).cast("long")
    return rows.join(spread.select("region", "k", "main", apart.alias("apart")).filter("apart > 0"), "region")


def _tries(left: DataFrame, share: int, turn: int) -> DataFrame:
    """Pairs (u, v) that are likely links between components: a node outside the main component of the largest
    undecided region that it is in, with each of a few pivots among the nodes that are there as well."""
    home = F.max(F.struct("k", "region", "main", "n", "component")).alias("home")
    at = left.groupBy("node").agg(home).select("node", "home.*")
    drawn = F.xxhash64("node", F.lit(turn))
    slots = at.groupBy("region", F.pmod(drawn, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(drawn.alias("drawn"), "node", "n", "component")).alias("pivot"))
    pivots = slots.select("region", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.component").alias("of"))
    met = at.filter("component <> main").join(pivots, "region").filter("component <> of").filter(_compatible(F.col("n"), F.col("pivot_n"), share))
    return met.select(*_pairs(F.col("node"), F.col("pivot"))).distinct()


def _pairs_apart(left: DataFrame, share: int) -> DataFrame:
    """Pairs (u, v) of all texts of a region that are of different components and whose first common shingle may be its."""
    a, b = left.filter("component <> main").alias("a"), left.alias("b")
    met = a.join(b, F.col("a.region") == F.col("b.region")).filter(
        (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    ).filter(_may_start("a.", "b.", share))
    return met.select(*_pairs(F.col("a.node"), F.col("b.node"))).distinct()


def _prefixes_of(texts: DataFrame, width: int, share: int, standing: np.ndarray) -> DataFrame:
    """node, n, pivots (the prefix), cold (how many of them are ordinary) of every set."""
    table = texts.sparkSession.sparkContext.broadcast(standing)
    found = texts.select("text").mapInArrow(
        partial(_prefixes, width=width, share=share, standing=table), "node long, n long, pivots array<long>, cold int"
    )
    # copies are one node: dropped in the map tasks first
    firsts = [F.first(c).alias(c) for c in ("n", "pivots", "cold")]
    return park(found.groupBy("node").agg(*firsts), "prefixes")


def _crowded(prefixes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells of ordinary shingles whose regions hold more than SMALL texts, at most CELLS of them, and their
    levels. Put behind in the order, such a shingle leaves the prefixes of texts that have rarer ones."""
    ordinary = prefixes.select(F.explode(F.slice("pivots", F.lit(1), F.col("cold"))).alias("shingle"))
    return _by_cell(ordinary.groupBy("shingle").agg(F.count("*").alias("sets")).filter(F.col("sets") > SMALL))


def link_components(texts: DataFrame, counted: DataFrame, width: int, share: int) -> DataFrame:
    """vertex, component of all nodes that have a link; texts: text; counted: shingle, sets of chunks."""
    spark = texts.sparkSession
    standing = levels(counted)
    for _ in range(PASSES):
        prefixes = _prefixes_of(texts, width, share, standing)
        crowded, found = _crowded(prefixes)
        if not len(crowded):
            break
        standing[crowded] = np.maximum(standing[crowded], found)
        release(spark, prefixes)
    else:
        prefixes = _prefixes_of(texts, width, share, standing)
    release(spark)
    regions = park(_region_rows(prefixes, share), "regions")
    release(spark)

    def links_among(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        likely = park(_plausible(pairs, prefixes, share), "likely")
        if likely.isEmpty():
            return likely
        release(spark)
        own = sets is None and _sets_of(texts, _ends(likely), width)
        release(spark)
        found = park(_measured(likely, sets or own, share).filter("linked").select("u", "v"), "links")
        release(spark, likely, *([own] if own else []))
        return found

    beside = regions.filter("node <> pivot_node")
    links = links_among(beside.filter(_may_start("", "pivot_", share)).select(*_pairs(F.col("node"), F.col("pivot_node"))).distinct())
    labels = park(components(links), "labels")
    columns = ["region", "node", "n", "rest", "component"]
    rows = park(_undecided(_labelled(beside.select(*columns[:-1]), labels)).select(*columns), "undecided-rows")
    release(spark, regions)
    left = park(_undecided(_one_of_equal(rows)), "undecided")
    release(spark, rows)
    if left.isEmpty():
        return components(links)
    sets = _sets_of(texts, left.select("node").distinct(), width)
    release(spark)
    for turn in range(TURNS):
        tries = park(_tries(left.filter(F.col("k") > SMALL) if turn else left, share, turn), "tries")
        found = park(_measured(tries, sets, share).filter("linked").select("u", "v"), "links")
        if found.isEmpty():
            break
        links = links.unionAll(found)
        labels = park(components(links), "labels")
        before, left = left, park(_undecided(_labelled(left.select(*columns[:-1]), labels)), "undecided")
        release(spark, before)
    while True:
        few = F.col("stuck") | (2 * F.col("apart") <= SMALL * F.col("k"))
        left = left if "stuck" in left.columns else left.withColumn("stuck", F.lit(False))
        links = links.unionAll(links_among(_pairs_apart(left.filter(few), share), sets))
        large = left.filter(~few)
        if large.isEmpty():
            break
        # the pivots of a large region: the least nodes of different components
        heads = large.groupBy("region", "component").agg(F.min("node").alias("pivot"))
        order = Window.partitionBy("region").orderBy("pivot")
        pivots = park(heads.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= PIVOTS).select("region", "pivot"), "pivots")
        beside = large.join(pivots, "region").filter("node <> pivot")
        tried = park(beside.select(*_pairs(F.col("node"), F.col("pivot"))).distinct(), "tried")
        distances = park(_measured(tried, sets, share), "distances")
        links = links.unionAll(distances.filter("linked").select("u", "v"))
        labels = park(components(links), "labels")
        reach = beside.select("region", "node", "n", "rest", "k", "pivot", *_pairs(F.col("node"), F.col("pivot"))).join(distances, ["u", "v"])
        near = reach.groupBy("region", "node").agg(F.min("distance").alias("nearest"))
        window = 2 * (1 - share / 100) + 1e-9
        inner = reach.join(near, ["region", "node"]).filter(F.col("distance") <= F.col("nearest") + window)
        inner = inner.join(pivots.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti")
        split = inner.select("region", F.xxhash64("region", "pivot").alias("part"), "node", "n", "rest", F.col("k").alias("parent"))
        # a region of which some part is nearly as large as it was does not get smaller: it stays whole
        size = split.groupBy("region", "part").agg(F.count("*").alias("k"), F.first("parent").alias("parent"))
        stuck = park(
            size.groupBy("region").agg(F.max(F.col("k") + PIVOTS >= F.col("parent")).alias("stuck")), "stuck"
        )
        marked = split.join(stuck, "region")
        whole = marked.filter("stuck").select("region", "node", "n", "rest").distinct()
        parts = marked.filter("not stuck").select(F.col("part").alias("region"), "node", "n", "rest")
        apart = _undecided(_labelled(parts, labels)).withColumn("stuck", F.lit(False))
        kept = _undecided(_labelled(whole, labels)).withColumn("stuck", F.lit(True))
        left = park(apart.unionAll(kept), "undecided")
    return components(links)


def join_documents(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """Per row of ``docs``: row_key, doc_id, n_shingles, component_id, the smallest doc_id that links reach,
    and component, a number of the component (null without words).

    Links: sets of ``width``-word shingles whose intersection is at least ``share`` percent of their
    union. A text with fewer words has one shingle of them all; a null text or one without words
    has none, is linked with nothing, and keeps its own doc_id. Equal sets are linked. Null doc_ids
    count only where nothing else is reached. Other columns are ignored; an empty table gives no rows.
    """
    tasks_import(docs.sparkSession)
    source = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = park(source.mapInArrow(partial(_nodes, width=width), "row_key long, doc_id long, n long, node long, shingle long, sets long"), "nodes")
    rows = found.filter("sets is null").drop("shingle", "sets")
    counted = found.filter("sets is not null").select("shingle", "sets")
    labels = park(link_components(source, counted, width, share), "components")
    least = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = _labelled(least, labels)
    reached = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(reached, "component").select("node", "component", "component_id")
    reached_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(by_node, "node", "left").select(
        "row_key", "doc_id", F.col("n").alias("n_shingles"), reached_id.alias("component_id"), "component"
    )


def one_of_each(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id (null first); columns as they
    were. Texts without words all stay. Rows with equal doc_id and text are one document."""
    found = join_documents(docs, width, share)
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    key = spare("key", docs)
    kept = first.select(F.col("first.row_key").alias(key)).unionAll(
        found.filter("component is null").select(F.col("row_key").alias(key))
    ).distinct()
    return docs.withColumn(key, row_key()).join(kept, key, "left_semi").dropDuplicates([key]).select(*replaced(docs))
