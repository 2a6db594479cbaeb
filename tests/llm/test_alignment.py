"""Alignment of two tokenizers against a brute-force version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import routed_counts, token_alignment
from tidemark.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, op13_token_alignment, tokenizer_path

pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string"
TEXTS = [
    (1, "The cat sat on the mat, and then it left again."),
    (2, "The cat sat on the mat, and then it left again."),
    (3, None),
    (4, ""),
    (5, "  \t\n "),
    (6, "naïve café — 日本語 テスト <|endoftext|> </s> <s> <unk> <0x41> it's 12,345"),
    (7, "x"),
    (7, "x"),
    (7, "another text under the same number"),
    (None, "a text without any number"),
    (None, None),
    (8, "▁ already spelled ▁▁ like a piece"),
    (9, "aaaaaaaaaaa" * 300 + " " + "-" * 1000 + "\n" * 50),
    (10, " ".join(f"word{i % 89}" for i in range(9000))),
    (11, "The mat"),
    (12, "\x00 zero ﻿ mark é"),
    (13, " leading and  double  blanks "),
]


def reference(rows):
    """Token by token and link by link, in plain Python."""
    known = token_alignment.token_bytes(tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_TOKENIZER))
    found, holders = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            raw = (" " + text).encode()
            if b"".join(known.a[i] for i in a) == raw == b"".join(known.b[i] for i in b):
                left, right, i, j, p, q = [], [], 0, 0, 0, 0
                while i < len(a) or j < len(b):
                    if p <= q and i < len(a):
                        left.append(a[i])
                        p += len(known.a[a[i]])
                        i += 1
                    else:
                        right.append(b[j])
                        q += len(known.b[b[j]])
                        j += 1
                    if p == q and left and right:
                        groups.append((left, right))
                        left, right = [], []
        pairs = Counter()
        for left, right in groups:
            for x, n in Counter(left).items():
                for y, m in Counter(right).items():
                    pairs[x, y] += n * m
        holders.update(pairs.keys())
        found.append((doc_id, groups, pairs))
    highest = defaultdict(int)
    for (x, _), n in holders.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, groups, pairs in found:
        spelled = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if holders[p] == highest[p[0]]), sum(n * holders[p] for p, n in pairs.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        ))
    return out


def aligned(docs):
    return token_alignment.align_documents(docs, tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("chunk,small", [(1 << 20, 64), (50, 2)])
def test_alignment_matches_brute_force(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(token_alignment, "CHUNK_LINKS", chunk)
    monkeypatch.setattr(token_alignment, "SMALL", small)
    rng = random.Random(chunk)
    words = "the cat sat Schlüssel naïve 12 345 _x_ it's tionthe eröver ñgaco çvi".split()
    made = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows = TEXTS + made + made[:20] + [(200 + i, made[0][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for name in ("copies", "digest", "chunk", "n_a"):
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    got = sorted(map(tuple, aligned(docs).collect()), key=key)
    assert got == sorted(reference(rows), key=key)


def test_no_texts_have_no_tokens(spark):
    assert aligned(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r) for r in aligned(spark.createDataFrame([(1, None), (2, "")], DOCS)).orderBy("doc_id").collect()] == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_large_groups_count_like_small_ones(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 7, 300)
    a_size, b_size = np.asarray([100, 1, 299]), np.asarray([3, 200, 97])
    groups = np.repeat(np.arange(3), a_size), np.repeat(np.arange(3), b_size), a_size, b_size
    want = Counter()
    for g in range(3):
        for x in a[groups[0] == g]:
            for y in b[groups[1] == g]:
                want[(int(x) << 32) | int(y)] += 1
    for small in (0, 64, 1 << 30):
        monkeypatch.setattr(token_alignment, "SMALL", small)
        pairs, times = token_alignment.links(a, b, *groups)
        assert dict(zip(pairs.tolist(), times.tolist())) == want


def test_the_registered_query(spark, tmp_path):
    spark.createDataFrame(TEXTS, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(reference(TEXTS), key=key)


@pytest.mark.parametrize("top", [0, 1, 255, 256, 2**32, 2**64 - 1])
def test_numbers_are_unpacked_as_they_were(top):
    numbers = np.asarray([0, top, top // 2, 0], dtype=np.uint64)
    assert routed_counts.unpack(routed_counts.pack(numbers)).tolist() == numbers.tolist()
    keys = np.unique(numbers)
    assert routed_counts.unpack_sorted(routed_counts.pack_sorted(keys)).tolist() == keys.tolist()
    assert routed_counts.unpack(routed_counts.pack(np.zeros(0, dtype=np.uint64))).tolist() == []


def test_both_encoders_of_a_byte_level_file_agree():
    known = token_alignment.TokenBytes(tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))
    assert known._ranked is not None
    rng = random.Random(2)
    points = [*range(1, 0x3000), *range(0xA000, 0xA800), *range(0xFE00, 0xFFFE), *range(0x1F300, 0x1F700)]
    texts = ["".join(rng.choice([chr(rng.choice(points)), "a", " ", "\n", "'s", "12"]) for _ in range(60)) for _ in range(3000)]
    texts += ["<|endoftext|>", "a" * 50_000, " " * 50_000, "-" * 50_000 + "\n" * 50_000, "'LL 'll  x"]
    fast = known.a_ids(texts)
    known._ranked = None
    assert known.a_ids(texts) == fast
