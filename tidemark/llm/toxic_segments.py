"""Toxic passages as maximum-scoring segments of a text's words.

Each word carries a log-odds score: toxic against clean documents that have it, smoothed by a Dirichlet prior
whose mean is the share among words with the same beginning. A drift makes clean text score
below zero on average, so that a linear scan finds all maximal segments. Scores of the best
segment of clean texts follow an extreme-value law; its tail turns a segment's score and the
text's length into an expected count, and these are calibrated into a probability.
"""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import row_key
from tidemark.llm.storage import slices, tasks_import

WORD = re.compile(r"[^\W\d_]+")
STEM = 4  # letters that words share for the prior
DRIFT = 0.5
SIGNIFICANT = 0.05  # expected segments of that score in a clean text of that length


@dataclass(frozen=True)
class ToxicModel:
    """Bounded by ``lexicon`` words and stems, whatever the corpus."""

    words: dict[str, float]
    stems: dict[str, float]
    scale: float  # of the extreme-value law
    rate: float
    weights: tuple[float, ...]  # intercept, best segment, all significant segments


class _Scores(dict):
    """Score of a word: its own, else its stem's, else the prior's."""

    def __init__(self, model: ToxicModel, bound: int = 50_000):
        super().__init__(model.words)
        self._stems, self._bound = model.stems, len(model.words) + bound

    def __missing__(self, word: str) -> float:
        found = self._stems.get(word[:STEM], 0.0)
        if len(self) < self._bound:
            self[word] = found
        return found


def word_scores(text: str | None, scores: _Scores) -> np.ndarray:
    """The score of every word; a word said again at once only costs the drift, so that mere
    repetition makes no passage."""
    words = WORD.findall((text or "").lower())
    found = np.fromiter(map(scores.__getitem__, words), float)
    again = np.fromiter(map(operator.eq, words[1:], words), bool)
    found[1:][again] = np.minimum(found[1:][again], -DRIFT)
    return found


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, behind last, score), by one linear scan.

    Runs of equal sign count as one step. A kept segment carries the sum left of it, the sum up
    to its end, and the nearest earlier one with less on its left. A new segment is joined
    with that one as long as the sum has risen since.
    """
    if not (scores > 0).any():
        return []
    sign = scores > 0
    starts = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
    sums = np.add.reduceat(scores, starts)
    stops = np.r_[starts[1:], len(scores)]
    kept: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for first, stop, step in zip(starts.tolist(), stops.tolist(), sums.tolist()):
        left, total = total, total + step
        if step <= 0:
            continue
        lower = len(kept) - 1
        while lower >= 0 and kept[lower][2] >= left:
            lower = kept[lower][4]
        while lower >= 0 and kept[lower][3] < total:
            first, _, left, _, further = kept[lower]
            del kept[lower:]
            lower = further
        kept.append((first, stop, left, total, lower))
    return [(a, b, right - left) for a, b, left, right, _ in kept]


def _tail(model: ToxicModel, score: float, n: int) -> float:
    """-ln of the expected number of clean segments with at least this score among n words."""
    return model.scale * score - math.log(model.rate * max(n, 1))


def evidence(model: ToxicModel, scores: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
    """-ln E of the best segment, the sum of it over significant ones, and these segments."""
    n = len(scores)
    found = [(a, b, s, _tail(model, s, n)) for a, b, s in segments(scores)]
    strong = [x for x in found if x[3] >= -math.log(SIGNIFICANT)]
    best = max((x[3] for x in found), default=_tail(model, 0.0, n))
    return min(40.0, max(best, -10.0)), math.log1p(sum(x[3] for x in strong)), [(a, b, s) for a, b, s, _ in strong]


def _probability(model: ToxicModel, best: float, strong: float) -> float:
    z = model.weights[0] + model.weights[1] * best + model.weights[2] * strong
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _count(batches):
    counts: dict[str, list[int]] = {}
    for batch in slices(batches, 1024):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word in set(WORD.findall((text or "").lower())):
                counts.setdefault(word, [0, 0])[toxic] += 1
        if len(counts) > 200_000:
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def _counted(counts):
    values = list(counts.values())
    return pa.record_batch(
        [pa.array(list(counts), pa.string()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[0] for v in values], pa.int64())],
        ["word", "toxic", "clean"],
    )


def _measure(batches, model):
    model, scores = model.value, _Scores(model.value)
    for batch in slices(batches, 1024):
        rows = []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = word_scores(text, scores)
            best, strong, _ = evidence(model, s)
            top = max((x[2] for x in segments(s)), default=0.0)
            rows.append((toxic, best, strong, top, len(s)))
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["toxic", "best", "strong", "top", "n"])


def _positive_root(values: np.ndarray, shares: np.ndarray) -> float:
    """The scale at which the mean of exp(scale * score) over clean words is 1."""
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        if float((shares * np.exp(np.minimum(middle * values, 50))).sum()) > 1:
            high = middle
        else:
            low = middle
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 5; of an empty text for a null id."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, rows: int = 30_000, lexicon: int = 50_000, strength: float = 2.0) -> ToxicModel:
    """Learn from at most ``rows`` labelled documents (those first by a hash of the id), none of fold 0.

    Folds 1 to 3 give the word scores, fold 4 the calibration. ``lexicon`` bounds the words and
    the stems of the model, the most significant ones stay. Labels other than 0 and 1, and null
    ids, teach nothing; of several labels of an id the highest holds. Without labels of both
    kinds in both parts every text gets the share of toxic labels.
    """
    spark = docs.sparkSession
    tasks_import(spark)
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.filter(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    share = sum(r["toxic"] for r in chosen) / len(chosen) if chosen else 0.0
    flat = ToxicModel({}, {}, 1.0, 1.0, (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))
    if not 0 < share < 1:
        return flat
    drawn = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int"))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(drawn, "doc_id")
    counts = (
        labelled.filter(fold() != 4).select("text", "toxic").mapInArrow(_count, "word string, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    counts = counts.persist()
    try:
        all_toxic, all_clean = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
        if not all_toxic or not all_clean:
            return flat
        # clean counts are weighed so that both sides have equally many words
        even = all_toxic / all_clean
        stems = counts.groupBy(F.substring("word", 1, STEM).alias("stem")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        share_of = lambda toxic, clean, mean: (toxic + strength * mean) / (toxic + even * clean + strength)
        stem_share = share_of(F.col("toxic"), F.col("clean"), F.lit(0.5))
        log_odds = lambda p: F.log(p / (1 - p))
        spread = F.sqrt(1 / (F.col("toxic") + strength / 2) + 1 / (even * F.col("clean") + strength / 2))
        top = lambda frame, name: (
            frame.filter("toxic + clean >= 3").orderBy(F.abs(F.col("score") / spread).desc(), name).limit(lexicon).select(name, "score").collect()
        )
        stem_rows = top(stems.withColumn("score", log_odds(stem_share)), "stem")
        with_stem = counts.withColumn("stem", F.substring("word", 1, STEM)).join(stems.select("stem", stem_share.alias("mean")), "stem")
        scored = with_stem.withColumn("score", log_odds(share_of(F.col("toxic"), F.col("clean"), F.col("mean"))))
        word_rows = top(scored, "word")
        model = ToxicModel(
            {r["word"]: r["score"] - DRIFT for r in word_rows}, {r["stem"]: r["score"] - DRIFT for r in stem_rows}, 1.0, 1.0, (0.0, 0.0, 0.0)
        )
        # scores of words outside the model: a stem's of its own, or none but the drift
        model.stems[""] = -DRIFT
        bins = counts.join(spark.createDataFrame(list(model.words.items()) or [("", 0.0)], "word string, own double"), "word", "left").withColumn(
            "stem", F.substring("word", 1, STEM)
        ).join(spark.createDataFrame(list(model.stems.items()), "stem string, back double"), "stem", "left").select(
            F.round(F.coalesce("own", "back", F.lit(0.0)), 1).alias("score"), "clean"
        ).groupBy("score").agg(F.sum("clean").alias("n")).collect()
    finally:
        counts.unpersist()
    values, sizes = np.asarray([r["score"] for r in bins]), np.asarray([float(r["n"]) for r in bins])
    model = ToxicModel(model.words, model.stems, _positive_root(values, sizes / sizes.sum()), 1.0, (0.0, 0.0, 0.0))
    held = labelled.filter(fold() == 4).select("text", "toxic")
    schema = "toxic int, best double, strong double, top double, n long"
    measured = held.mapInArrow(partial(_measure, model=spark.sparkContext.broadcast(model)), schema).collect()  # at most ``rows``
    toxic = np.asarray([r["toxic"] for r in measured], dtype=float)
    if not 0 < toxic.sum() < len(toxic):
        return flat
    clean = [(r["n"], r["top"]) for r in measured if not r["toxic"]]
    waits = sum(max(n, 1) * math.exp(-model.scale * top) for n, top in clean)
    model = ToxicModel(model.words, model.stems, model.scale, max(1e-12, len(clean) / waits), (0.0, 0.0, 0.0))
    again = held.mapInArrow(partial(_measure, model=spark.sparkContext.broadcast(model)), schema).collect()
    features = np.asarray([(r["best"], r["strong"]) for r in again])
    weights = _logistic(features, np.asarray([r["toxic"] for r in again], dtype=float))
    return ToxicModel(model.words, model.stems, model.scale, model.rate, tuple(float(w) for w in weights))


def _score(batches, model):
    model = model.value
    scores = _Scores(model)
    for batch in slices(batches, 1024):
        columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        found, passages = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            s = word_scores(text, scores)
            best, strong, spans = evidence(model, s)
            found.append(_probability(model, best, strong))
            if spans and len(text) == len(text.lower()):
                places = [m.span() for m in WORD.finditer(text.lower())]
                spans = [{"start": places[a][0], "end": places[b - 1][1], "score": v} for a, b, v in spans]
            else:
                spans = [{"start": None, "end": None, "score": v} for _, _, v in spans]
            passages.append(spans)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        columns["score"], columns["passages"] = pa.array(found, pa.float64()), pa.array(passages, kind)
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Per row of ``docs``: row_key, doc_id, score (0 to 1) and the significant passages (character
    positions, where lower-casing keeps them, and segment score). Only the text is looked at; a null
    text is empty. Repeated rows score alike; an empty table gives no rows."""
    spark = docs.sparkSession
    tasks_import(spark)
    rows = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        partial(_score, model=spark.sparkContext.broadcast(model)),
        "row_key long, doc_id long, score double, passages array<struct<start:long,end:long,score:double>>",
    )


def _keep(batches, model, threshold: float, at: int):
    model = model.value
    scores = _Scores(model)
    for batch in slices(batches, 1024):
        kept = []
        for text in batch.column(at).to_pylist():
            s = word_scores(text, scores)
            best, strong, _ = evidence(model, s)
            kept.append(_probability(model, best, strong) < threshold)
        yield batch.filter(pa.array(kept, pa.bool_()))


def reject(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; columns as they were, nothing is shuffled."""
    spark = docs.sparkSession
    tasks_import(spark)
    keep = partial(_keep, model=spark.sparkContext.broadcast(model), threshold=threshold, at=docs.columns.index("text"))
    return docs.mapInArrow(keep, docs.schema)
