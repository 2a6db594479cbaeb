"""Language-model scores against counts in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloom_language_model as lm
from tidemark.llm.queries import op11_bloom_language_model

DOCS = "doc_id long, text string"
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "One two"), (5, "one  TWO\x1c three"), (6, "ÀÉ àé İ ß"), (6, "ÀÉ àé İ ß"), (6, "one"),
    (None, "one two"), (None, None), (7, " ".join(f"w{i % 97}" for i in range(3000))), (8, "x" * 5000), (-9, "one two one two one two"),
]


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]  # None ends a document


def level_mean(count):
    return 0.0 if not count else (2 ** (count.bit_length() - 1) * 3 - 1) / 2


def reference(rows, weights=(1000.0, 5.0)):
    """The same model with a table of counts for the filter."""
    order = len(weights) + 1
    start = object()
    counts = [Counter() for _ in range(order)]
    train = [tokens(t) for i, t in rows if not held_out(i)]
    for words in train:
        padded = [start] * (order - 1) + words
        for at in range(len(words)):
            for n in range(1, order + 1):
                counts[n - 1][tuple(padded[at + order - n : at + order])] += 1
    total, distinct = sum(counts[0].values()), len(counts[0])
    below = total + 0.5 * (distinct + 1)

    def mean(gram):
        c = len(train) if gram and all(w is start for w in gram) else counts[len(gram) - 1][gram]
        return level_mean(c)

    out = []
    for doc_id, text in rows:
        words = tokens(text)
        padded = [start] * (order - 1) + words
        base = score = 0.0
        for at in range(len(words)):
            base += math.log10((counts[0][(words[at],)] + 0.5) / below)
            p = (mean((words[at],)) + 0.5) / below
            for n in range(2, order + 1):
                gram = tuple(padded[at + order - n : at + order])
                p = (mean(gram) + weights[n - 2] * p) / (mean(gram[:-1]) + weights[n - 2])
            score += math.log10(p)
        known = sum(counts[0][(w,)] > 0 for w in words)
        out.append((doc_id, held_out(doc_id), len(words), known, total, base, score))
    return out


def compare(got, want, rel=1e-9):
    order = lambda r: ((r[0] is None, r[0]), *r[2:4], round(r[5], 6), round(r[6], 3))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-12)
        assert g[6] == pytest.approx(w[6], rel=rel)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    return AWKWARD + rows + [(1000 + i, rows[0][1]) for i in range(40)]


@pytest.mark.parametrize("order,weights,chunk,part", [(3, (1000.0, 5.0), 1 << 21, 1 << 18), (3, (5.0, 1.0), 500, 100), (1, (), 500, 100), (2, (3.0,), 1 << 21, 64)])
def test_scores_match_plain_counts(spark, monkeypatch, order, weights, chunk, part):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm, "SLICE_TOKENS", part)
    rows = corpus(order)
    docs = spark.createDataFrame(rows, DOCS).withColumn("train", F.lit("clash")).withColumn("chunk", F.lit(1)).repartition(4)
    got = lm.score_documents(docs, order, weights, bits=64)  # a filter that hardly errs
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compare(got.collect(), reference(rows, weights))


def test_asking_the_shards_gives_the_same(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    whole = lm.score_documents(docs, bits=6).collect()
    asked = lm.score_documents(docs, bits=6, broadcast_bytes=0).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, asked))


def test_the_filter_errs_seldom_and_never_downwards():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    counts = rng.geometric(0.4, 20_000).astype(np.uint64)
    bits = lm.build(keys[:20_000], counts, lm.BITS)
    sizes, offsets = np.full(40_000, len(bits), dtype=np.uint64), np.zeros(40_000, dtype=np.uint64)
    found = lm.levels_in(bits, keys, np.full(40_000, lm.LEVELS), sizes, offsets)
    true = lm.levels_of(counts)
    assert (found[:20_000] >= true).all() and (found[:20_000] > true).mean() < 0.03
    assert (found[20_000:] > 0).mean() < 0.03
    assert len(bits) * 64 <= lm.BITS * true.sum() + 64


def test_levels_are_exact_at_powers_of_two():
    counts = np.asarray([0, 1, 2, 3, 4, 7, 8, (1 << 40) - 1, 1 << 40], dtype=np.uint64)
    assert lm.levels_of(counts).tolist() == [int(c).bit_length() for c in counts]
    assert [lm.MEANS[int(c).bit_length()] for c in counts.tolist()] == [level_mean(c) for c in counts.tolist()]


def test_without_training_documents(spark):
    held = next(i for i in range(100) if held_out(i))
    got = lm.score_documents(spark.createDataFrame([(held, "a b")], DOCS)).collect()
    assert [tuple(r)[:5] for r in got] == [(held, True, 3, 0, 0)]
    assert got[0]["base_score"] == got[0]["score"] == 0.0  # the one share there is
    assert lm.score_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_the_registered_query_beats_word_shares(spark, tmp_path):
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(3)] for i in range(200)}
    rows = []
    for i in range(300):
        word, text = f"w{rng.randrange(200)}", []
        for _ in range(40):
            text.append(word)
            word = rng.choice(follow[word])
        rows.append((i, " ".join(text)))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_bloom_language_model(spark, str(tmp_path)).collect()
    compare(got, reference(rows), rel=0.1)  # the filter errs about once in a hundred questions
    assert sum(r["score"] for r in got) == pytest.approx(sum(r[6] for r in reference(rows)), rel=0.01)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)
