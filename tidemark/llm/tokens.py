"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import functools
import json
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANKS = "\n\t\r\x0b\x0c"
_PROBES = ("a b", "it's  The end.", "x\n\ty , z", "é ́a b", "1 2", "'s 't <|endoftext|> q")
LAST_LETTER = "\xff"  # of Latin-1
_LETTERS = "".join(chr(c) for c in range(256) if chr(c).isalpha())
_MARKS = string.punctuation.replace("'", "")  # runs of them behind a word are cut off it


class _PlainWords:
    """Ids of words of Latin-1 letters, many in one go.

    For a byte-level file whose tokens carry the end of a word, such words can skip the file's own cutting and
    normalising: they are spelled as the model spells them, joined by blanks, and the ids cut where a
    word ends.
    """

    def __init__(self, file: dict, dtype: np.dtype):
        from tokenizers import Tokenizer

        suffix = file["model"]["end_of_word_suffix"]
        vocabulary = file["model"]["vocab"]
        self._lower = any(n["type"] == "Lowercase" for n in _parts(file.get("normalizer"), "normalizers"))
        bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self._tokenizer = Tokenizer.from_str(json.dumps(file | bare))
        self._dtype = dtype
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for entry, i in vocabulary.items() if entry.endswith(suffix)]] = True
        # bytes that are visible in Latin-1 are spelled as themselves, the others from U+0100 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        spelled = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._spelled = {ord(c): "".join(spelled[b] for b in c.encode()) for c in _LETTERS}

    def ids(self, words: list[str]) -> list[bytes] | None:
        """None if the ids can't be cut into as many words."""
        parts = [words[at : at + 512] for at in range(0, len(words), 512)]
        joined = [" ".join(part) for part in parts]
        texts = [(text.lower() if self._lower else text).translate(self._spelled) for text in joined]
        found, width = [], self._dtype.itemsize
        for part, encoded in zip(parts, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.asarray(encoded.ids, dtype=np.int64)
            ends = ((np.flatnonzero(self._ends[ids]) + 1) * width).tolist()
            if len(ends) != len(part):
                return None
            raw = ids.astype(self._dtype).tobytes()
            found += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return found


def _parts(step: dict | None, inner: str) -> list[dict]:
    return [] if step is None else step[inner] if step["type"] == "Sequence" else [step]


def _plain_words(path: str, dtype: np.dtype) -> _PlainWords | None:
    """For files that are known to keep such words whole: lower-casing, NFC, byte-level, ends of words marked."""
    with open(path, encoding="utf-8") as source:
        file = json.load(source)
    model = file["model"]
    normal = {n["type"] for n in _parts(file.get("normalizer"), "normalizers")}
    cut = {n["type"] for n in _parts(file.get("pre_tokenizer"), "pretokenizers")}
    if model.get("type", "BPE") != "BPE" or not model.get("end_of_word_suffix") or model.get("dropout"):
        return None
    if not normal <= {"NFC", "Replace", "Lowercase"} or "ByteLevel" not in cut or not cut <= {"ByteLevel", "Split"}:
        return None
    return _PlainWords(file, dtype)


class TextEncoder:
    """Encodes texts, remembering the ids of words it has met.

    A tokenizer that drops white space and never looks across it encodes a text as its
    blank-separated words one after another; ids of a word are then looked up once. For
    any other tokenizer whole texts are encoded. The memory is bounded: of two generations
    the older is dropped when the younger is full.
    """

    def __init__(self, path: str, plain_specials: bool = False, words: int = 500_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain_specials
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self._words, self._longest = words, longest
        self._young: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}
        self._wordwise = all(
            self._whole([probe])[0] == b"".join(self._whole(probe.split(" "))) for probe in _PROBES
        ) and all(self._whole([f"a{c}b"])[0] == b"".join(self._whole(["a", "b"])) for c in _BLANKS)
        self._plain = _plain_words(path, self.dtype) if self._wordwise else None
        if self._plain is not None:
            probes = [*_LETTERS, *(f"th{c}ing" for c in _LETTERS), "The", "ENDE", "a" * 300, _LETTERS]
            added = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
            self._marks = "".join(mark for mark in _MARKS if mark not in "".join(added))
            tails = [*self._marks, *(a + b for a in self._marks for b in self._marks), *(3 * mark for mark in self._marks)]
            before = self._whole(["Ab"])[0]
            marked = self._whole([f"Ab{tail}" for tail in tails]) == [before + ids for ids in self._whole(tails)]
            if not marked or any(token.isalpha() for token in added) or self._plain.ids(probes) != self._whole(probes):
                self._plain = None

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _words_of(self, words: list[str]) -> dict[str, bytes]:
        """Words that have not been met, with their ids (and those of the marks behind them)."""
        if self._plain is None:
            return dict(zip(words, self._whole(words)))
        marks, young, old = self._marks, self._young, self._old
        plain, stems, rest, new = [], [], [], {}
        for word in words:
            stem = word.rstrip(marks)
            if stem.isalpha() and (stem.isascii() or max(stem) <= LAST_LETTER):
                plain.append(word)
                stems.append(stem)
                if stem not in young and stem not in old:
                    new[stem] = b""
            else:
                rest.append(word)
        unmet = list(new)
        ids = self._plain.ids(unmet)
        new.update(zip(unmet, self._whole(unmet) if ids is None else ids))
        tails = {word[len(stem) :] for word, stem in zip(plain, stems)}
        rest += [tail for tail in tails.difference(rest) if tail not in young and tail not in old]
        found = dict(zip(rest, self._whole(rest)))
        known = lambda part: young[part] if part in young else old[part]
        behind = {tail: found[tail] if tail in found else known(tail) for tail in tails}
        for word, stem in zip(plain, stems):
            raw = new.get(stem)
            if raw is None:
                raw = known(stem)
            found[word] = raw if len(word) == len(stem) else raw + behind[word[len(stem) :]]
        return found

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each of different words."""
        if len(self._young) > self._words:
            self._old, self._young = self._young, {"": b""}
        young, old, longest = self._young, self._old, self._longest
        found = list(map(young.get, words))
        unmet = [word for word, raw in zip(words, found) if raw is None]
        if not unmet:
            return found
        made = self._words_of([word for word in unmet if word not in old])
        made.update((word, old[word]) for word in unmet if word in old)
        young.update((word, raw) for word, raw in made.items() if len(word) <= longest)
        return [made[word] if raw is None else raw for word, raw in zip(words, found)]

    def forget(self) -> None:
        """Drop the words met so far: workers outlive their tasks, and what stages keep in them adds up."""
        self._young, self._old = {"": b""}, {}

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``; null encodes like an empty text."""
        if not self._wordwise:
            return self._whole([text or "" for text in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # each different word is looked up once, Arrow puts the ids of all in their places
        split = pc.ascii_split_whitespace(column.fill_null(""))
        firsts = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        if not len(words):
            return [b""] * len(column)
        ids = pa.array(self._ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        _, places, raw = ids.buffers()
        at = np.frombuffer(places, dtype="<i8")[ids.offset :][firsts].tolist()
        return [raw[a:b].to_pybytes() if a < b else b"" for a, b in zip(at, at[1:])]


@functools.lru_cache(maxsize=2)
def text_encoder(path: str, plain_specials: bool = False) -> TextEncoder:
    """One encoder per Python worker, kept between its tasks; a task that is done lets it :meth:`~TextEncoder.forget`."""
    return TextEncoder(path, plain_specials)
