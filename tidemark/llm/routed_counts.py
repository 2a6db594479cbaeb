"""Counts of keys over a whole corpus, handed back to each piece of it.

A piece ("chunk") is a file on shared storage, written once by the task that read its texts and named by
a parked row, so every later pass finds the same bytes, also after an executor is lost. A chunk's
distinct keys, sorted and packed, go to shards by their leading bits; there they are summed, and each
chunk gets back the numbers of its own keys in the same order. A key that all texts hold costs one
entry a chunk. Nothing is gathered beyond one shard or one chunk.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import input_file, output_file, park

LEAST_SHARDS = 64
SHARD_BYTES = 8 << 20  # of text that a shard stands for


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed; planes above the largest number are left out."""
    numbers = np.ascontiguousarray(numbers, dtype="<u8")
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), dtype=np.uint8).reshape(width, -1)
    numbers = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    numbers[:, :width] = planes.T
    return numbers.view("<u8").ravel().astype(np.uint64, copy=False)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def save(folder: str, label: str, **parts: bytes) -> str:
    """A file of named byte strings; its path."""
    path, target = output_file(folder, label)
    with target, pa.ipc.new_stream(target, pa.schema([(name, pa.large_binary()) for name in parts])) as writer:
        writer.write_batch(pa.record_batch([pa.array([value], pa.large_binary()) for value in parts.values()], list(parts)))
    return path


def load(path: str) -> dict[str, bytes]:
    with input_file(path) as source:
        return pa.ipc.open_stream(source.read_buffer()).read_all().to_pylist()[0]


def shards_for(docs: DataFrame, text: str = "text") -> int:
    """How many shards hold about ``SHARD_BYTES`` of text each; a power of two."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_SHARDS, 1 << max(0, (size // SHARD_BYTES) - 1).bit_length())


def spread(chunks: DataFrame) -> DataFrame:
    """The parked list of chunks (column chunk), about one to a task."""
    return chunks.select("chunk").repartition(max(1, chunks.count()))


ENTRIES = "shard int, chunk string, kind int, keys binary, numbers binary"
_ENTRIES = pa.schema([("shard", pa.int32()), ("chunk", pa.string()), ("kind", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ENTRIES)


def entries(chunk: str, kind: int, keys: np.ndarray, numbers: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """What a chunk sends to each shard: its sorted distinct keys of a kind, and their numbers."""
    bits = np.uint64(64 - (shards.bit_length() - 1))
    bounds = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) << bits)
    bounds = [0, *bounds.tolist(), len(keys)]
    rows = [
        {"shard": s, "chunk": chunk, "kind": kind, "keys": pack_sorted(keys[a:b]), "numbers": pack(numbers[a:b])}
        for s, (a, b) in enumerate(zip(bounds, bounds[1:]))
        if b > a
    ]
    for at in range(0, len(rows), 256):
        yield _batch(rows[at : at + 256])


def totals(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a shard's rows, their sums, and each row's places among them."""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), dtype=np.uint64)
    np.add.at(sums, place, np.concatenate([unpack(r["numbers"]) for r in rows]))
    return distinct, sums, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _sum_shard(table, answer):
    rows = table.to_pylist()
    return pa.Table.from_pylist(list(answer(rows[0]["shard"], rows)), _ENTRIES)


def sum_shards(
    chunks: DataFrame,
    emit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    answer: Callable[[int, list[dict]], Iterable[dict]],
    label: str,
    more: DataFrame | None = None,
) -> DataFrame:
    """``emit`` turns the list of chunks into entries, ``answer`` a shard's entries into rows of the same
    shape; the parked result. Rows of ``more`` go to their shards as they are."""
    sent = spread(chunks).mapInArrow(emit, ENTRIES)
    sent = sent if more is None else sent.unionAll(more)
    return park(sent.groupBy("shard").applyInArrow(partial(_sum_shard, answer=answer), ENTRIES), label)


def by_chunk(answers: DataFrame, chunks: DataFrame, use: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``use`` gets a chunk's answers, from all shards."""
    tasks = max(2 * chunks.count(), 1)
    return answers.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(use, schema)


def in_order(rows: list[dict], kind: int) -> np.ndarray:
    """A chunk's numbers of one kind in the order of its keys."""
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["shard"])
    return np.concatenate([unpack(r["numbers"]) for r in own]) if own else np.zeros(0, dtype=np.uint64)


def chunk_batch(paths: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(paths, pa.string())], ["chunk"])


def check_endian() -> None:
    if sys.byteorder != "little":
        raise RuntimeError("files are written in little-endian order")
