"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

An n-gram that the training documents hold c times is put into the filter with each of the levels 1 to
1 + floor(log2 c). Its count is read back by asking for level after level until one is missing, and
stands for the middle of what the last level covers. Probabilities of the orders are interpolated: a
context's count weighs against a constant times the lower order. The filter is built in shards,
from counts of the whole corpus, and grows with it. While it is small enough every worker holds all of it;
beyond that the questions go to the shards. Both give the same scores.
"""

from __future__ import annotations

import functools
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import routed_counts as routed
from tidemark.llm.storage import park, scratch_path, slices, tasks_import

CHUNK_TOKENS = 1 << 21  # after which a chunk is closed
SLICE_TOKENS = 1 << 18  # that are scored together
BITS = 10  # of the filter for each entry
BROADCAST_BYTES = 256 << 20  # up to which every worker holds the whole filter
GRAM = np.uint64(((1 << 48) - 1) << 16)  # of an n-gram's key 48 bits count, of a word's all
FILTER, WORD = 0, 1  # kinds of rows; n-grams have their order
END, START = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
LEVELS = 64


class _Words(dict):
    """64-bit key of a word; short ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        key = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = key
        return key


def word_keys(raw: bytes | None, known: _Words) -> np.ndarray:
    """Keys of a text's words, A-Z lower-cased, cut at ASCII blanks, and of the end."""
    words = (raw or b"").lower().split()
    return np.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), END)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of orders 1 to ``order`` that end at each word; documents begin at ``starts``,
    and before them stands a start sign."""
    found, before = [words], np.asarray([START])
    for _ in range(order - 1):
        context = np.empty_like(words)
        context[1:] = found[-1][:-1]
        context[starts] = before
        found.append(_mixed(context * np.uint64(0x9FB21C651E98DF25) + words))
        before = _mixed(before * np.uint64(0x9FB21C651E98DF25) + START)
    return [found[0], *[k & GRAM for k in found[1:]]]


# the filter


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), and 0 for none."""
    return np.frexp(counts.astype(float))[1].astype(np.int64) * (counts > 0)


#: What a level stands for: the middle of the counts that have it.
MEANS = np.concatenate([[0.0], 1.5 * 2.0 ** np.arange(LEVELS) - 0.5])


def _probes(keys: np.ndarray, level: np.ndarray | int, sizes: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that holds a key's entry for a level, and the five bits of it."""
    h = _mixed(keys ^ (np.asarray(level).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    place = ((h >> np.uint64(32)) * np.asarray(sizes).astype(np.uint64)) >> np.uint64(32)
    bits = np.zeros_like(h)
    for i in range(5):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return place, bits


def build(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """A shard of the filter: all keys with all their levels."""
    levels = levels_of(counts)
    size = max(1, -(-int(levels.sum()) * bits // 64))
    held = np.zeros((size, 64), dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        place, mask = _probes(keys[levels >= level], level, size)
        for i in range(64):
            held[place[(mask >> np.uint64(i)) & np.uint64(1) == 1], i] = True
    return np.packbits(held, axis=1, bitorder="little").view("<u8").ravel()


def levels_in(bits: np.ndarray, keys: np.ndarray, most: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The level of each key: asked for one after the other, up to the first that is missing or to ``most``. A
    key's shard has ``sizes`` words from ``offsets``."""
    found = np.zeros(len(keys), dtype=np.int64)
    asked = np.flatnonzero(most > 0)
    level = 0
    while len(asked):
        level += 1
        place, mask = _probes(keys[asked], level, sizes[asked])
        asked = asked[bits[place + offsets[asked]] & mask == mask]
        found[asked] = level
        asked = asked[most[asked] > level]
    return found


class Filter:
    """All shards; one that no file stands for is empty."""

    def __init__(self, parts: dict[int, np.ndarray], shards: int):
        arrays = [parts.get(s, np.zeros(1, dtype=np.uint64)) for s in range(shards)]
        self._sizes = np.asarray([len(a) for a in arrays], dtype=np.uint64)
        self._offsets = np.cumsum(self._sizes) - self._sizes
        self._bits, self._shift = np.concatenate(arrays), np.uint64(64 - (shards.bit_length() - 1))

    def levels(self, keys: np.ndarray, most: np.ndarray) -> np.ndarray:
        shard = (keys >> self._shift).astype(np.int64)
        return levels_in(self._bits, keys, most, self._sizes[shard], self._offsets[shard])


@functools.lru_cache(maxsize=1)
def _whole_filter(paths: tuple[tuple[int, str], ...], shards: int) -> Filter:
    """One per Python worker, read from the shared folder."""
    return Filter({s: np.frombuffer(routed.load(path)["bits"], dtype="<u8") for s, path in paths}, shards)


# chunks


def _save_chunk(rows: list[tuple], folder: str) -> str:
    ids, train, keys = zip(*rows)
    words, ranks = np.unique(np.concatenate(keys), return_inverse=True)
    pack = routed.pack
    return routed.save(
        folder, "words", words=routed.pack_sorted(words), ranks=pack(ranks), lengths=pack(np.asarray([len(k) for k in keys])),
        train=pack(np.asarray(train)), known=pack(np.asarray([i is not None for i in ids])), ids=pack(np.asarray([i or 0 for i in ids], dtype=np.int64).view(np.uint64)),
    )


def _write_chunks(batches, folder: str):
    known, rows, tokens = _Words(), [], 0
    for batch in slices(batches, 1024):
        for doc_id, train, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.append((doc_id, train, word_keys(raw, known)))
            tokens += len(rows[-1][2])
        if tokens >= CHUNK_TOKENS:
            yield routed.chunk_batch([_save_chunk(rows, folder)])
            rows, tokens = [], 0
    if rows:
        yield routed.chunk_batch([_save_chunk(rows, folder)])


class _Chunk:
    def __init__(self, path: str):
        parts = routed.load(path)
        self.words, self.ranks = routed.unpack_sorted(parts["words"]), routed.unpack(parts["ranks"]).astype(np.int64)
        self.lengths = routed.unpack(parts["lengths"]).astype(np.int64)
        self.train = routed.unpack(parts["train"]).astype(bool)
        self.ids = pa.array(routed.unpack(parts["ids"]).view(np.int64), mask=routed.unpack(parts["known"]) == 0)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def grams(self, first: int, behind: int, order: int) -> list[np.ndarray]:
        """Of documents ``first`` up to ``behind``."""
        a, b = self.starts[first], self.starts[behind - 1] + self.lengths[behind - 1]
        return gram_keys(self.words[self.ranks[a:b]], self.starts[first:behind] - a, order)

    def slices(self):
        """Documents that are scored together, about SLICE_TOKENS; one at least."""
        first = 0
        while first < len(self.lengths):
            behind = int(np.searchsorted(self.starts, self.starts[first] + SLICE_TOKENS))
            yield first, max(behind, first + 1)
            first = max(behind, first + 1)


def _emit_counts(batches, shards: int, order: int):
    """Words of all documents with their counts in training documents, and training documents' n-grams."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            chunk = _Chunk(path)
            train = np.repeat(chunk.train, chunk.lengths)
            counts = np.bincount(chunk.ranks[train], minlength=len(chunk.words))
            yield from routed.entries(path, WORD, chunk.words, counts, shards)
            for n, keys in enumerate(chunk.grams(0, len(chunk.lengths), order)[1:], 2):
                yield from routed.entries(path, n, *np.unique(keys[train], return_counts=True), shards)


def _emit_questions(batches, shards: int, order: int):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            chunk = _Chunk(path)
            for n, keys in enumerate(chunk.grams(0, len(chunk.lengths), order), 1):
                keys = np.unique(keys)
                yield from routed.entries(path, n, keys, np.zeros(len(keys), dtype=np.uint64), shards)


def _build_shard(shard: int, rows: list[dict], folder: str, bits: int):
    """Counts of their words to the chunks; and the shard's file, with the number of its 64-bit words, of training
    tokens and of distinct ones."""
    keys, counts, tokens, distinct = [], [], 0, 0
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        some, sums, places = routed.totals(own)
        keys.append(some)
        counts.append(sums)
        if kind == WORD:
            tokens, distinct = int(sums.sum()), int((sums > 0).sum())
            for row, place in zip(own, places):
                yield {"shard": shard, "chunk": row["chunk"], "kind": WORD, "numbers": routed.pack(sums[place])}
    held = build(np.concatenate(keys), np.concatenate(counts), bits)
    path = routed.save(folder, f"bloom-{shard}", bits=held.tobytes())
    yield {"shard": shard, "chunk": path, "kind": FILTER, "numbers": routed.pack(np.asarray([len(held), tokens, distinct]))}


def _answer_questions(shard: int, rows: list[dict]):
    """Levels of the chunks' n-grams, as kinds -1, -2, ..."""
    paths = [r["chunk"] for r in rows if r["kind"] == FILTER]
    bits = np.frombuffer(routed.load(paths[0])["bits"], dtype="<u8") if paths else np.zeros(1, dtype=np.uint64)
    for row in rows:
        if row["kind"] != FILTER:
            keys = routed.unpack_sorted(row["keys"])
            sizes, offsets = np.full(len(keys), len(bits), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
            levels = levels_in(bits, keys, np.full(len(keys), LEVELS), sizes, offsets)
            yield {"shard": shard, "chunk": row["chunk"], "kind": -row["kind"], "numbers": routed.pack(levels)}


def _sizes(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([dict(zip(("words", "tokens", "distinct"), map(int, routed.unpack(row["numbers"])))) | {"shard": row["shard"], "path": row["chunk"]}])


# scores


def _score(table, paths, shards, order, weights, tokens, distinct, trained, schema):
    rows = table.to_pylist()
    chunk = _Chunk(rows[0]["chunk"])
    counts = routed.in_order(rows, WORD)
    total = tokens + 0.5 * (distinct + 1)
    base_of = np.log10(counts.astype(float) + 0.5) - np.log10(total)
    base = np.add.reduceat(base_of[chunk.ranks], chunk.starts)
    n_known = np.add.reduceat((counts > 0)[chunk.ranks].astype(np.int64), chunk.starts)
    if paths is not None:
        held = _whole_filter(paths, shards)
        ask = lambda n, keys, most: held.levels(keys, most)
    else:
        all_keys = [np.unique(k) for k in chunk.grams(0, len(chunk.lengths), order)]
        answers = [routed.in_order(rows, -n).astype(np.int64) for n in range(1, order + 1)]
        ask = lambda n, keys, most: np.minimum(answers[n - 1][np.searchsorted(all_keys[n - 1], keys)], most)
    word_levels = ask(1, chunk.words, np.full(len(chunk.words), LEVELS))
    scores = []
    for first, behind in chunk.slices():
        starts = chunk.starts[first:behind] - chunk.starts[first]
        keys = chunk.grams(first, behind, order)
        levels = word_levels[chunk.ranks[chunk.starts[first] : chunk.starts[first] + len(keys[0])]]
        p = (MEANS[levels] + 0.5) / total
        start_level = int(levels_of(np.asarray([trained]))[0])
        for n, weight in zip(range(2, order + 1), weights):
            context = np.empty_like(levels)
            context[1:] = levels[:-1]
            context[starts] = start_level
            levels = ask(n, keys[n - 1], np.minimum(levels, context))
            p = (MEANS[levels] + weight * p) / (MEANS[context] + weight)
        scores.append(np.add.reduceat(np.log10(p), starts))
    columns = [
        chunk.ids, pa.array(~chunk.train), pa.array(chunk.lengths), pa.array(n_known), pa.array(np.full(len(base), tokens, dtype=np.int64)), pa.array(base), pa.array(np.concatenate(scores)),
    ]
    return pa.Table.from_arrays(columns, schema=schema)


def score_documents(
    docs: DataFrame, order: int = 3, weights: tuple[float, ...] = (1000.0, 5.0), bits: int = BITS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of a text, A-Z lower-cased, between ASCII blanks, and one end; a null or empty text is
    an end alone. The model learns from rows whose crc32(doc_id as text) mod 5 is not 1 (a null id counts as the empty
    text). ``base_score`` is exact, with counts of training tokens; ``score`` is the log10 probability by the filter, of
    n-grams up to ``order``, with ``weights`` for the orders above the first. ``bits`` of the filter stand for an entry. Up to
    ``broadcast_bytes`` of filter each worker holds all of it. Words are told apart by 64 bits of a hash. Repeated rows count and are
    listed each; without training documents all counts are 0. An empty table gives no rows. Other columns are ignored.
    """
    if len(weights) != order - 1:
        raise ValueError("one weight for each order above the first")
    spark = docs.sparkSession
    tasks_import(spark)
    routed.check_endian()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold != 1).alias("train"), F.col("text").cast("string").cast("binary").alias("text"))
    folder, shards = scratch_path(spark, "language-model"), routed.shards_for(docs)
    chunks = park(rows.mapInArrow(partial(_write_chunks, folder=folder), "chunk string"), "word-chunks")
    counted = routed.sum_shards(
        chunks, partial(_emit_counts, shards=shards, order=order), partial(_build_shard, folder=folder, bits=bits), "gram-counts"
    )
    parts = counted.filter(F.col("kind") == FILTER)
    files = parts.mapInArrow(_sizes, "words long, tokens long, distinct long, shard long, path string")
    words, tokens, distinct = files.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "distinct")]).first()
    trained = rows.filter("train").count()
    answers, paths = counted.filter(F.col("kind") == WORD), None
    if 8 * words <= broadcast_bytes:
        paths = tuple(sorted((r["shard"], r["path"]) for r in files.select("shard", "path").collect()))
    else:
        asked = routed.sum_shards(chunks, partial(_emit_questions, shards=shards, order=order), _answer_questions, "gram-levels", more=parts)
        answers = answers.unionAll(asked)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    use = partial(_score, paths=paths, shards=shards, order=order, weights=weights, tokens=tokens, distinct=distinct, trained=trained, schema=arrow)
    return routed.by_chunk(answers, chunks, use, schema)
