"""Word by word, in bulk, and whole: the same ids."""

import random

import pyarrow as pa
import pytest

from tidemark.llm import bitplane_store, grouped_packing, tokens
from tidemark.llm.queries import tokenizer_path

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def made_texts(seed):
    rng = random.Random(seed)
    letters = tokens._LETTERS + "abcdefghij" * 20
    pieces = ["", ".", ",", "..", "?!", "'s", "1", "<|endoftext|>", "Σ", "İ", "ﬁ", "é", "—", "日本", "\x85", " "]

    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) + rng.choice(pieces) * rng.randrange(2)

    return [rng.choice(" \n\t").join(word() for _ in range(rng.randrange(1, 80))) for _ in range(300)]


def test_bulk_encoding_is_used(tokenizer):
    assert tokens.TextEncoder(tokenizer_path())._plain is not None


@pytest.mark.parametrize("words", [500_000, 50])
def test_ids_are_those_of_whole_texts(tokenizer, words):
    encoder = tokens.TextEncoder(tokenizer_path(), words=words)
    texts = made_texts(words)
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        want = [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        got = [list(memoryview(raw).cast("H")) for raw in encoder.encode(part)]
        assert got == want


def test_special_tokens_as_plain_text(tokenizer):
    encoder = tokens.TextEncoder(tokenizer_path(), plain_specials=True)
    tokenizer.encode_special_tokens = True
    text = "end<|endoftext|>. The <|startoftext|> End."
    want = tokenizer.encode(text, add_special_tokens=False).ids
    tokenizer.encode_special_tokens = False
    assert list(memoryview(encoder.encode([text])[0]).cast("H")) == want


def test_words_that_cannot_be_cut_are_encoded_whole(tokenizer, monkeypatch):
    encoder = tokens.TextEncoder(tokenizer_path())
    monkeypatch.setattr(encoder._plain, "ids", lambda words: None)
    text = "Some words, in a row."
    assert list(memoryview(encoder.encode([text])[0]).cast("H")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_columns_encode_like_lists():
    encoder = tokens.TextEncoder(tokenizer_path(), words=100)
    texts = [*made_texts(7), None, "", " \n", *made_texts(8)]
    column = pa.array(["cut off", *texts], pa.string())[1:]
    assert encoder.encode(column) == [encoder._whole([text or ""])[0] for text in texts]
    assert encoder.encode(pa.array([None, " "], pa.string())) == [b"", b""] and encoder.encode(column[:0]) == []


def test_only_marks_behind_a_word_are_encoded_whole(monkeypatch):
    encoder = tokens.TextEncoder(tokenizer_path())
    text = "Wenn?! (wenn) nicht... nicht!%%% o'clock no<|endoftext|>"
    want, seen, whole = encoder._whole([text]), [], encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: seen.extend(texts) or whole(texts))
    assert encoder.encode([text]) == want
    assert sorted(seen) == ["!%%%", "(wenn)", "...", "?!", "no<|endoftext|>", "o'clock"]


def test_words_are_forgotten_with_the_task(spark):
    def held(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([len(tokens.text_encoder(tokenizer_path())._young)], pa.int64())], ["n"])

    docs = spark.createDataFrame([(1, "some words to be met")], "doc_id long, text string").coalesce(1)
    assert grouped_packing.pieces(docs, tokenizer_path()).count() == 1
    assert docs.mapInArrow(held, "n long").first()["n"] == 1
    assert bitplane_store.write_ids(docs, tokenizer_path()).count() == 1
    assert docs.mapInArrow(held, "n long").first()["n"] == 1
