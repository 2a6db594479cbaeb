"""Packing of documents into sequences: linear grouping, then best fit.

Only the histogram of piece lengths (one count per length, at most ``capacity`` of them)
reaches the driver. The plan made from it says, for each length and range of ranks, which
sequences take those pieces and where; tasks look their pieces up in it.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import park, slices, tasks_import
from tidemark.llm.tokens import text_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _cut(batches, tokenizer: str, end_id: int, capacity: int):
    encoder = text_encoder(tokenizer)
    end = np.asarray([end_id], dtype=encoder.dtype).tobytes()
    task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    for batch in slices(batches, 2048):
        rows = []
        for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
            ids = np.frombuffer(raw + end, dtype=encoder.dtype)
            for piece, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                n = len(part)
                rows.append((doc_id, piece, at, n, zlib.crc32(part.astype("<u4").tobytes()), task, seen[n]))
                seen[n] += 1
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    encoder.forget()


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces of ``capacity`` if longer.

    ``nth`` numbers the pieces of equal length within the task that cut them.
    """
    tasks_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_cut, tokenizer=tokenizer, end_id=end_id, capacity=capacity), PIECES)


def best_configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size fill a sequence) and how often each is used, so that
    the wanted numbers are met with the fewest sequences: a linear program over all
    configurations, whose columns are found one by one by a knapsack on the prices."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * k + 200):
        prices = np.linalg.solve(basis.T, np.ones(k))
        best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= room)
            values = best[room - sizes[fits]] + prices[fits]
            top = int(values.argmax())
            best[room], taken[room] = best[room - 1], -1
            if values[top] > best[room] + 1e-12:
                best[room], taken[room] = values[top], fits[top]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if taken[room] < 0:
                room -= 1
            else:
                column[taken[room]] += 1
                room -= int(sizes[taken[room]])
        used, change = np.linalg.solve(basis, wanted.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, np.maximum(used, 0) / np.where(change > 1e-9, change, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    used = np.linalg.solve(basis, wanted.astype(float))
    return [(basis[:, j].astype(np.int64), max(0.0, used[j])) for j in range(k)]


class _Open:
    """Runs of sequences with equal contents, by the room they have left."""

    def __init__(self, capacity: int):
        self.runs: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
        self.any = np.zeros(capacity + 1, dtype=bool)
        self.capacity = capacity

    def put(self, room: int, count: int, contents: list[tuple[int, int]]) -> None:
        if count:
            self.runs[room].append((count, contents))
            self.any[room] = True

    def take(self, length: int) -> tuple[int, int, list[tuple[int, int]]]:
        """The fullest run with that much room, or (nothing open) a run of no sequences."""
        found = int(self.any[length:].argmax()) + length
        if not self.any[found]:
            return self.capacity, 0, []
        count, contents = self.runs[found].pop()
        self.any[found] = bool(self.runs[found])
        return found, count, contents


def _draw(supply: list[list[int]], count: int, end: int) -> list[list[int]]:
    """Take ``count`` pieces off the longer (0) or shorter (-1) end of [length, pieces] pairs."""
    drawn = []
    while count:
        n, there = supply[end]
        step = min(count, there)
        drawn.append([n, step])
        count -= step
        if step == there:
            supply.pop(end)
        else:
            supply[end][1] -= step
    return drawn


def plan_sequences(histogram: dict[int, int], capacity: int, groups: int = 40, large: float = 1 / 8) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, pieces per sequence, offset).

    Lengths over ``large * capacity`` are ranked and put into ``groups`` groups with
    equally many pieces, each rounded up to its group's longest. The best configurations
    of these few sizes are made up as often as whole multiples allow, and actual lengths
    take the rounded ones' places, longest first. The shortest place of a configuration
    stays open: its pieces, and all small ones, go longest first to the fullest sequence
    that has room, so that no room is lost to the rounding.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    open_ = _Open(capacity)
    big = sorted((n for n in left if large * capacity < n < capacity), reverse=True)
    total = sum(left[n] for n in big)
    if total:
        share, members, held = -(-total // groups), [[]], 0
        for n in big:  # one length may span several groups
            count = left[n]
            while count:
                if held == share:
                    members, held = [*members, []], 0
                step = min(count, share - held)
                members[-1].append([n, step])
                held, count = held + step, count - step
        sizes = np.asarray([m[0][0] for m in members], dtype=np.int64)
        wanted = np.asarray([sum(c for _, c in m) for m in members], dtype=np.int64)
        merged: dict[int, list] = {}
        for size, member, count in zip(sizes.tolist(), members, wanted.tolist()):
            slot = merged.setdefault(size, [[], 0])
            slot[0] += member
            slot[1] += count
        sizes = np.asarray(list(merged), dtype=np.int64)
        wanted = np.asarray([slot[1] for slot in merged.values()], dtype=np.int64)
        supply = [slot[0] for slot in merged.values()]
        for pattern, times in best_configurations(sizes, wanted, capacity):
            times = int(min([times + 1e-6, *(sum(c for _, c in supply[g]) // pattern[g] for g in np.flatnonzero(pattern))]))
            if times <= 0 or not pattern.any():
                continue
            slots = np.repeat(np.flatnonzero(pattern), pattern[np.flatnonzero(pattern)])
            slots = slots[np.argsort(-sizes[slots], kind="stable")].tolist()
            places = [_draw(supply[g], times, 0) for g in slots[: max(1, len(slots) - 1)]]
            for place in places:
                for n, count in place:
                    left[n] -= count
            for g in slots[len(places) :]:  # its pieces stay with the rest, for the closest fit
                _draw(supply[g], times, -1)
            while places[0]:  # stretches of sequences in which every place holds one length
                step = min(place[0][1] for place in places)
                held: dict[int, int] = {}
                for place in places:
                    held[place[0][0]] = held.get(place[0][0], 0) + 1
                    place[0][1] -= step
                    if not place[0][1]:
                        place.pop(0)
                open_.put(capacity - sum(n * q for n, q in held.items()), step, list(held.items()))
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        count = left[n]
        while count:
            room, run, contents = open_.take(n)
            fit = room // n
            if not run:
                run = max(1, count // fit)
            whole = min(run, count // fit)
            open_.put(room - fit * n, whole, [*contents, (n, fit)])
            count -= whole * fit
            if whole < run and count:  # fewer than fit are left: one sequence takes them
                open_.put(room - count * n, 1, [*contents, (n, count)])
                count, whole = 0, whole + 1
            if contents:
                open_.put(room, run - whole, contents)
    rank = dict.fromkeys(histogram, 0)
    plan, sequence = [], 0
    for runs in open_.runs:
        for count, contents in runs:
            offset = 0
            for n, q in contents:
                plan.append((n, rank[n], count * q, sequence, q, offset))
                rank[n] += count * q
                offset += n * q
            sequence += count
    if any(rank[n] != c for n, c in histogram.items()):
        raise AssertionError("the plan must place every piece once")
    return np.asarray(sorted(plan), dtype=np.int64).reshape(-1, 6)


def best_plan(histogram: dict[int, int], capacity: int, groups: int = 40) -> np.ndarray:
    """The plan with the fewest sequences over several bounds between small and large. With few
    small pieces about, a low bound wins; with many, a high one."""
    least, best = -(-sum(n * c for n, c in histogram.items()) // capacity), None
    for large in (1 / 2, 2 / 5, 1 / 4, 1 / 8):
        plan = plan_sequences(histogram, capacity, groups, large)
        used = int((plan[:, 3] + plan[:, 2] // plan[:, 4]).max()) if len(plan) else 0
        if best is None or used < best[0]:
            best = used, plan
        if used == least:
            break
    return best[1]


def _place(batches, plan):
    table = plan.value
    keys = table[:, 0] << 48 | table[:, 1]
    for batch in batches:
        frame = {name: batch.column(name) for name in batch.schema.names}
        length = frame["length"].to_numpy(zero_copy_only=False)
        rank = frame.pop("rank").to_numpy(zero_copy_only=False)
        row = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
        nth = rank - row[:, 1]
        frame["sequence_id"] = pa.array(row[:, 3] + nth // row[:, 4], pa.int64())
        frame["offset"] = pa.array(row[:, 5] + nth % row[:, 4] * length, pa.int64())
        yield pa.RecordBatch.from_arrays(list(frame.values()), list(frame))


def pack(cut: DataFrame, capacity: int = 2048, groups: int = 40) -> DataFrame:
    """Give each piece a sequence_id and an offset in it.

    ``cut`` has the columns of ``pieces``, and must be stable when read again (a table);
    length lies in 1..capacity. Pieces of equal length change places freely, so ranks are
    made of the tasks' own numbering and one running sum per length over the tasks. Nothing
    depends on how many pieces share a length, a document or a task. An empty table gives no
    rows.
    """
    spark = cut.sparkSession
    tasks_import(spark)
    counts = park(cut.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_plan(histogram, capacity, groups))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        partial(_place, plan=plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``pieces`` of all documents, packed. A null text is empty: its piece is the end id alone.
    Null doc_ids and repeated rows are packed like any other; other columns are ignored."""
    return pack(park(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
