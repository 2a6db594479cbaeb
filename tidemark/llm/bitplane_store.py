"""Token ids in a binary file format: blocks of ids as compressed bit or byte planes.

A file is a sequence of chunks. A chunk holds ``block`` consecutive ids, transposed into
planes (bit k, or byte k, of every id), each plane a zstandard frame of its own. The
footer holds the chunk index (first id, ids, planes, place and length of each frame) and
the documents (doc_id, ids). The last 16 bytes give the footer's length and a mark.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import input_file, output_file, park, scratch_path, slices, tasks_import
from tidemark.llm.tokens import text_encoder

MARK = b"PLANES01"


def to_planes(ids: np.ndarray, kind: str, level: int = 3) -> list[bytes]:
    """The planes of ids (unsigned 32-bit), lowest first, as far up as any id has a bit."""
    press = zstandard.ZstdCompressor(level=level).compress
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [press(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range((top + 7) // 8)]
    planes = []
    for k in range((top + 7) // 8):
        bits = np.unpackbits(np.ascontiguousarray(raw[:, k])[:, None], axis=1, bitorder="little")
        planes += [press(np.packbits(bits[:, j]).tobytes()) for j in range(min(8, top - 8 * k))]
    return planes


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    out = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(expand(plane), dtype=np.uint8)
        if kind == "byte":
            out[:, k] = raw
        else:
            out[:, k // 8] |= np.unpackbits(raw, count=n) << (k % 8)
    return out.view("<u4").reshape(-1)


class PlaneWriter:
    """Appends documents to a file; holds one block of ids and the index in memory."""

    def __init__(self, target, block: int, kind: str, level: int = 3):
        self._target, self._block, self._kind, self._level = target, block, kind, level
        self._waiting: list[np.ndarray] = []
        self._held = self._at = self.n_ids = self.n_docs = 0
        self._chunks: list[list] = []
        self._doc_ids, self._lengths = io.BytesIO(), io.BytesIO()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._doc_ids.write(struct.pack("<?q", doc_id is not None, doc_id or 0))
        self._lengths.write(struct.pack("<Q", len(ids)))
        self.n_docs += 1
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= self._block:
            joined = np.concatenate(self._waiting)
            whole = len(joined) // self._block * self._block
            for at in range(0, whole, self._block):
                self._flush(joined[at : at + self._block])
            self._waiting, self._held = [joined[whole:]], len(joined) - whole

    def _flush(self, ids: np.ndarray) -> None:
        planes = to_planes(ids, self._kind, self._level)
        self._chunks.append([self.n_ids, len(ids), self._at, [len(p) for p in planes]])
        for plane in planes:
            self._target.write(plane)
            self._at += len(plane)
        self.n_ids += len(ids)

    def close(self) -> None:
        if self._held:
            self._flush(np.concatenate(self._waiting))
        press = zstandard.ZstdCompressor(level=3).compress
        parts = [
            press(json.dumps({"kind": self._kind, "chunks": self._chunks}).encode()),
            press(self._doc_ids.getvalue()),
            press(self._lengths.getvalue()),
        ]
        for part in parts:
            self._target.write(part)
        self._target.write(struct.pack("<3Q", *map(len, parts)) + MARK)
        self._target.close()


class PlaneReader:
    """Reads a file's documents in order, or any stretch of ids through the chunk index."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        source.seek(size - 32)
        tail = source.read(32)
        if tail[24:] != MARK:
            raise ValueError("not a file of id planes")
        lengths = struct.unpack("<3Q", tail[:24])
        source.seek(size - 32 - sum(lengths))
        expand = zstandard.ZstdDecompressor().decompress
        head, doc_ids, counts = (expand(source.read(n)) for n in lengths)
        head = json.loads(head)
        self.kind, self.chunks = head["kind"], head["chunks"]
        table = np.frombuffer(doc_ids, dtype=np.dtype([("known", "?"), ("id", "<i8")]))
        self.known, self.doc_ids = table["known"], table["id"]
        self.lengths = np.frombuffer(counts, dtype="<u8")

    def chunk(self, k: int) -> np.ndarray:
        _, n, at, sizes = self.chunks[k]
        self._source.seek(at)
        return from_planes([self._source.read(size) for size in sizes], n, self.kind)

    def ids(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Ids start..stop, in pieces of a chunk at most."""
        firsts = [c[0] for c in self.chunks]
        k = int(np.searchsorted(firsts, start, side="right")) - 1 if firsts else 0
        while start < stop:
            first, n = self.chunks[k][:2]
            yield self.chunk(k)[start - first : min(stop, first + n) - first]
            start, k = first + n, k + 1

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id in the file, ids, crc32 of the ids) in file order."""
        from tidemark.llm.storage import crc_words

        held, at, k, start = np.empty(0, dtype="<u4"), 0, 0, 0
        for known, doc_id, length in zip(self.known.tolist(), self.doc_ids.tolist(), self.lengths.tolist()):
            crc, left = 0, length
            while left:
                if at == len(held):
                    held, at, k = self.chunk(k), 0, k + 1
                part = held[at : at + left]
                crc, at, left = crc_words(part, crc), at + len(part), left - len(part)
            yield (doc_id if known else None), start, length, crc
            start += length


def _encode(batches, tokenizer: str, end_id: int, bounds: np.ndarray):
    encoder = text_encoder(tokenizer)
    end = np.asarray([end_id], dtype=encoder.dtype).tobytes()
    spread = np.random.default_rng(TaskContext.get().partitionId())
    for batch in slices(batches, 2048):
        ids = pa.array([x + end for x in encoder.encode(batch.column(1))], pa.large_binary())
        doc_ids = batch.column(0)
        keys = doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
        shard = low + spread.integers(0, high - low + 1)
        yield pa.record_batch([doc_ids, pa.array(shard, pa.int32()), ids], ["doc_id", "shard", "ids"])
    encoder.forget()


def _write(batches, folder: str, block: int, kind: str, wide: bool):
    writer = path = None
    shard, dtype = TaskContext.get().partitionId(), "<u4" if wide else "<u2"
    for batch in batches:
        if writer is None:
            path, target = output_file(folder, f"ids-{shard:06d}")
            writer = PlaneWriter(target, block, kind)
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            writer.add(doc_id, np.frombuffer(raw.as_buffer(), dtype=dtype))
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "path": path, "n_docs": writer.n_docs, "n_ids": writer.n_ids}],
            pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    block: int = 1 << 16,
    kind: str = "byte",
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """Encode ``text`` of every row, append ``end_id``, and write the ids in ascending
    ``doc_id`` order; returns the files: shard, path, n_docs, n_ids.

    Texts are encoded where they are read; only ids are shuffled, into ranges of doc_id of
    about ``shard_bytes`` of text. Rows with the same doc_id may span several shards, in any
    order among themselves. A null text is an empty one. Null doc_ids come first. Other
    columns are ignored. An empty table gives no file.
    """
    spark = docs.sparkSession
    tasks_import(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    bounds: list[int] = []
    if shards > 1:
        at = [k / shards for k in range(1, shards)]
        bounds = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * shards))).first()[0] or []
    encoded = rows.mapInArrow(
        partial(_encode, tokenizer=tokenizer, end_id=end_id, bounds=np.asarray(bounds, dtype=np.int64)),
        "doc_id long, shard int, ids binary",
    )
    wide = text_encoder(tokenizer).dtype.itemsize == 4
    files = (
        encoded.repartitionById(shards, F.col("shard"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
        .select("doc_id", "ids")
        .mapInArrow(
            partial(_write, folder=scratch_path(spark, "id-planes"), block=block, kind=kind, wide=wide),
            "shard int, path string, n_docs long, n_ids long",
        )
    )
    return park(files, "id-plane-files")


def _read(batches):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )
    for batch in batches:
        for file in batch.to_pylist():
            with input_file(file["path"]) as source:
                rows = []
                for doc_id, start, n, crc in PlaneReader(source).documents():
                    rows.append((doc_id, file["base"] + start, n, crc))
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, decoded from their planes."""
    shards = max(1, files.count())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    numbered = based.withColumn("k", F.row_number().over(Window.orderBy("shard")) - 1)
    return (
        numbered.repartitionById(shards, F.col("k").cast("int"))
        .select("path", "base")
        .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
