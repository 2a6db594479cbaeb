"""Alignment of two tokenizers' ids over a corpus of which many texts are copies.

Texts are shuffled whole, so that each distinct one is tokenised and aligned once. Where tokens of both
end at the same byte a group ends, and all ids of the two kinds in a group are linked. How many
documents hold a pair of ids linked is counted with each text weighing as many as it has copies;
a text's measures then go to all documents that have it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import routed_counts as routed
from tidemark.llm.storage import park, scratch_path, slices, tasks_import

CHUNK_LINKS = 1 << 20  # after which a chunk is closed
SMALL = 64  # links of a group up to which they are listed one by one
SPREAD = 0x9E3779B97F4A7C15  # odd: pairs times this are spread over all 64 bits, and come back by its inverse
PAIR, BEST = 0, 1  # kinds of entries

# Fixed value: how byte-level files cut a text before they merge bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEASURES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class TokenBytes:
    """Encodes with both tokenizers and knows the bytes of every id."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_bpe)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        # a byte-level entry spells visible Latin-1 bytes as themselves, all others from U+0100 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        spelled = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.a = [
            bytes(spelled[c] for c in entry) if entry is not None and all(c in spelled for c in entry) else b""
            for entry in map(self._a.id_to_token, range(self._a.get_vocab_size()))
        ]
        self.b = [
            bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self._b.id_to_piece, range(self._b.get_piece_size())))
        ]
        self.a_bytes, self.b_bytes = (np.asarray([len(x) for x in t], dtype=np.int64) for t in (self.a, self.b))
        self._ranked = self._by_ranks(byte_bpe)
        # an id with what follows it: within its side of a group, at the end of the side
        self.a_text, self.b_text = (
            (np.asarray([f"{i}," for i in range(len(t))], dtype=object), np.asarray([f"{i}{end}" for i in range(len(t))], dtype=object))
            for t, end in ((self.a, "|"), (self.b, ";"))
        )

    def _by_ranks(self, path: str):
        """An encoder that merges by the rank of the result, some times faster. It does what the file says if this is a
        plain byte-level one and its merges make ids in increasing order; None if not."""
        import tiktoken

        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        if file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        if any(model.get(option) for option in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        ranks = {self.a[i]: i for i in model["vocab"].values()}
        if merged != sorted(set(merged)) or len(ranks) != len(merged) + 256 or max(ranks[bytes([b])] for b in range(256)) >= merged[0]:
            return None
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        if self._ranked is not None:
            return [self._ranked.encode_ordinary(" " + text) for text in texts]
        return [e.ids for e in self._a.encode_batch_fast([" " + text for text in texts], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both kinds for each text; None where the bytes of either are not those of space + text."""
        found = []
        for text, a in zip(texts, self.a_ids(texts)):
            raw, other = b" " + text.encode(), self._b.encode(text)
            same = b"".join(map(self.a.__getitem__, a)) == raw and b"".join(map(self.b.__getitem__, other)) == raw
            found.append((np.asarray(a, dtype=np.int64), np.asarray(other, dtype=np.int64)) if same else None)
        return found


@functools.lru_cache(maxsize=2)
def token_bytes(byte_bpe: str, pieces: str) -> TokenBytes:
    """One pair of tokenizers per Python worker."""
    return TokenBytes(byte_bpe, pieces)


def align(a: np.ndarray, b: np.ndarray, a_bytes: np.ndarray, b_bytes: np.ndarray):
    """Group of each token of either kind, the number of tokens of either kind in each group."""
    a_ends, b_ends = np.cumsum(a_bytes[a]), np.cumsum(b_bytes[b])
    at = np.searchsorted(b_ends, a_ends)
    a_shared = b_ends[at] == a_ends
    b_shared = np.zeros(len(b), dtype=bool)
    b_shared[at[a_shared]] = True
    a_group, b_group = np.cumsum(a_shared) - a_shared, np.cumsum(b_shared) - b_shared
    return a_group, b_group, np.bincount(a_group), np.bincount(b_group)


def links(a, b, a_group, b_group, a_size, b_size) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs (a * 2**32 + b) and how often each occurs. Ids of a large group are
    counted before they are paired."""
    per_group = a_size * b_size
    small = per_group <= SMALL
    own = small[a_group]
    ids, group = a[own], a_group[own]
    times = b_size[group]
    first = np.cumsum(b_size) - b_size
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[group], times)
    listed = [(np.repeat(ids, times) << 32) | b[place]]
    counts = [np.ones(len(listed[0]), dtype=np.int64)]
    a_first = np.cumsum(a_size) - a_size
    for g in np.flatnonzero(~small):
        left, left_n = np.unique(a[a_first[g] : a_first[g] + a_size[g]], return_counts=True)
        right, right_n = np.unique(b[first[g] : first[g] + b_size[g]], return_counts=True)
        listed.append(((left[:, None] << 32) | right).ravel())
        counts.append(np.outer(left_n, right_n).ravel())
    distinct, place = np.unique(np.concatenate(listed), return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return distinct, total


def spelled_groups(a, b, a_group, b_group, a_size, b_size, known: TokenBytes) -> str:
    """``a1,a2|b1;a3|b2,b3``."""
    out = np.empty(len(a) + len(b), dtype=object)
    a_last, b_last = np.cumsum(a_size) - 1, np.cumsum(b_size) - 1
    a_text, b_text = known.a_text[0][a], known.b_text[0][b]
    a_text[a_last], b_text[b_last] = known.a_text[1][a[a_last]], known.b_text[1][b[b_last]]
    out[np.arange(len(a)) + (b_last + 1 - b_size)[a_group]] = a_text
    out[np.arange(len(b)) + (a_last + 1)[b_group]] = b_text
    return "".join(out.tolist())[:-1]


class _Chunk:
    """Texts aligned so far: measures of each, and which pairs it has how often."""

    def __init__(self):
        self.digests, self.copies, self.sizes, self.sha, self.pairs, self.times = [], [], [], [], [], []
        self.links = 0

    def add(self, digest, copies, a, b, known):
        groups = align(a, b, known.a_bytes, known.b_bytes)
        pairs, times = links(a, b, *groups)
        self.digests.append(digest)
        self.copies.append(copies)
        self.sizes.append((len(a), len(b), len(groups[2]), int((groups[2] * groups[3]).sum())))
        self.sha.append(hashlib.sha256(spelled_groups(a, b, *groups, known).encode()).digest())
        self.pairs.append(pairs.astype(np.uint64))
        self.times.append(times)
        self.links += len(pairs)

    def save(self, folder: str) -> str:
        lengths = np.asarray([len(p) for p in self.pairs])
        spread = np.concatenate(self.pairs) * np.uint64(SPREAD)
        keys, place = np.unique(spread, return_inverse=True)
        weights = np.zeros(len(keys), dtype=np.uint64)
        np.add.at(weights, place, np.repeat(np.asarray(self.copies, dtype=np.uint64), lengths))
        return routed.save(
            folder, "aligned", digests=b"".join(self.digests), sha=b"".join(self.sha), sizes=routed.pack(np.asarray(self.sizes).ravel()),
            lengths=routed.pack(lengths), keys=routed.pack_sorted(keys), weights=routed.pack(weights), places=routed.pack(place),
            times=routed.pack(np.concatenate(self.times)),
        )


def _write_chunks(batches, byte_bpe: str, pieces: str, folder: str):
    known, chunk = token_bytes(byte_bpe, pieces), _Chunk()
    for batch in slices(batches, 256, 1 << 20):
        texts, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for text, n, ids in zip(texts, copies, known.encode(texts)):
            if ids is not None:
                chunk.add(hashlib.sha256(text.encode()).digest(), n, *ids, known)
        if chunk.links >= CHUNK_LINKS:
            yield routed.chunk_batch([chunk.save(folder)])
            chunk = _Chunk()
    if chunk.links:
        yield routed.chunk_batch([chunk.save(folder)])


def _emit(batches, shards: int):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            parts = routed.load(path)
            yield from routed.entries(path, PAIR, routed.unpack_sorted(parts["keys"]), routed.unpack(parts["weights"]), shards)


def _a_ids(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(pow(SPREAD, -1, 1 << 64))) >> np.uint64(32)


def _answer(shard: int, rows: list[dict]):
    """To each chunk the counts of its pairs; and the highest count of every A id of the shard."""
    keys, sums, places = routed.totals(rows)
    for row, place in zip(rows, places):
        yield {"shard": shard, "chunk": row["chunk"], "kind": PAIR, "numbers": routed.pack(sums[place])}
    a = _a_ids(keys)
    order = np.lexsort((sums, a))
    last = np.flatnonzero(np.r_[a[order][1:] != a[order][:-1], True])
    yield {"shard": shard, "kind": BEST, "keys": routed.pack_sorted(a[order][last]), "numbers": routed.pack(sums[order][last])}


def _best(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.record_batch(
                [pa.array(routed.unpack_sorted(row["keys"]).astype(np.int64)), pa.array(routed.unpack(row["numbers"]).astype(np.int64))], ["a", "best"]
            )


def _measure(table, best, schema):
    rows, best = table.to_pylist(), best.value
    parts = routed.load(rows[0]["chunk"])
    keys, counts = routed.unpack_sorted(parts["keys"]), routed.in_order(rows, PAIR)
    lengths = routed.unpack(parts["lengths"]).astype(np.int64)
    places, times = routed.unpack(parts["places"]).astype(np.int64), routed.unpack(parts["times"]).astype(np.int64)
    is_best = counts == best[_a_ids(keys).astype(np.int64)]
    starts = np.cumsum(lengths) - lengths
    sizes = routed.unpack(parts["sizes"]).astype(np.int64).reshape(-1, 4)
    digests, sha = (np.frombuffer(parts[name], dtype="V32").tolist() for name in ("digests", "sha"))
    columns = [
        pa.array(digests, pa.binary()), *[pa.array(sizes[:, i]) for i in range(4)],
        pa.array(np.add.reduceat(times * is_best[places], starts)), pa.array(np.add.reduceat(times * counts[places].astype(np.int64), starts)),
        pa.array([x.hex() for x in sha], pa.string()),
    ]
    return pa.Table.from_arrays(columns, schema=schema)


def align_documents(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A document's tokens are those of a blank and its text, by the byte-level file ``byte_bpe`` (A) and by the
    sentencepiece model ``pieces`` (B, which puts the blank there itself); special tokens' strings are plain text.
    A null or empty text, or one whose bytes a tokenizer does not keep, has no tokens: zeros and an empty
    string. Repeated rows count and are listed each; null doc_ids stay. Texts are told apart by
    themselves when they are grouped, by their SHA-256 when measures go back to documents. An empty table gives
    no rows. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    tasks_import(spark)
    routed.check_endian()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    folder = scratch_path(spark, "aligned")
    chunks = park(texts.mapInArrow(partial(_write_chunks, byte_bpe=byte_bpe, pieces=pieces, folder=folder), "chunk string"), "aligned-chunks")
    answers = routed.sum_shards(chunks, partial(_emit, shards=routed.shards_for(docs)), _answer, "pair-counts")
    # at most one row per entry of A's vocabulary
    top = answers.filter(F.col("kind") == BEST).mapInArrow(_best, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toArrow()
    best = np.zeros(max([0, *top.column(0).to_pylist()]) + 1, dtype=np.uint64)
    best[top.column(0).to_numpy()] = top.column(1).to_numpy().astype(np.uint64)
    schema = "digest binary, " + MEASURES
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    measures = routed.by_chunk(
        answers.filter(F.col("kind") == PAIR), chunks, partial(_measure, best=spark.sparkContext.broadcast(best), schema=arrow), schema
    )
    digest = F.when(F.col("text") != "", F.unhex(F.sha2("text", 256)))
    joined = docs.select("doc_id", digest.alias("digest")).join(measures, "digest", "left")
    names = [c for c in measures.columns if c not in ("digest", "groups_sha256")]
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
