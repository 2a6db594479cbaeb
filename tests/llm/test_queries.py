"""Registered queries without SQL against brute force, on the smallest of the given table folders."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries

pytest.importorskip("public_tokenizers")

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="without the given tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return {i: tokenizer.encode(text, add_special_tokens=False).ids for i, text in texts.items()}


def crc(listed):
    return zlib.crc32(np.asarray(listed, dtype="<u4").tobytes())


def test_op5(spark, ids):
    start, want = 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]) + 1, crc([*ids[i], 1]))
        start += len(ids[i]) + 1
    found = queries.op5_bitplane_ids(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)


def test_op7(spark, ids):
    want, places = {}, defaultdict(list)
    for i, listed in ids.items():
        whole = [*listed, 0]
        for piece, start in enumerate(range(0, len(whole), 2048)):
            want[i, piece] = (start, len(whole[start : start + 2048]), crc(whole[start : start + 2048]))
    found = queries.op7_grouped_packing(spark, FOLDER).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        ends = np.cumsum([0] + [n for _, n in sorted(held)]).tolist()
        assert [at for at, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) <= 1.05 * -(-sum(n for _, n, _ in want.values()) // 2048) + 1


def linked(texts):
    """Shingles and smallest linked doc_id of every text."""
    lower, blank = {c: c + 32 for c in range(65, 91)}, "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
    sets = {}
    for i, text in texts.items():
        for c in blank:
            text = text.replace(c, " ")
        words = [w for w in text.translate(lower).split(" ") if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j]) if i < j else 0
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_op6(spark, texts):
    found = queries.op6_jaccard_join(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == linked(texts) and len(found) == len(texts)


def test_pipeline(spark):
    """What is packed: clean documents, one of each component, without contaminated ones."""
    docs = queries.table(spark, FOLDER, "documents")
    clean = {r["doc_id"] for r in queries.op9_toxic_segments(spark, FOLDER).filter("score < 0.5").collect()}
    left = corpus_pipeline.line_dedup(spark, docs.filter(F.col("doc_id").isin(*clean)), FOLDER)
    texts = {r["doc_id"]: r["text"] or "" for r in left.select("doc_id", "text").collect()}
    split = lambda text: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    items = [split(r["text"] or "") for r in queries.table(spark, FOLDER, "benchmark").collect()]
    windows = {tuple(w[k : k + 13]) for w in items if w for k in range(max(1, len(w) - 12))}
    want = set()
    for i, (_, first) in linked(texts).items():
        words, hit = split(texts[i]), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if i == first and not (hit and 20 * len(hit) >= len(words)):
            want.add(i)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()} == want
    assert 0 < len(want) < len(texts) < docs.count()
