"""Token ids of whole texts with a public vocabulary of the ``tokenizers`` library.

The vocabulary drops white space and never lets a token cross it, so a text's ids are the ids of
its stretches between spaces and line ends, joined. A batch of texts is split by Arrow, equal
stretches are found by dictionary coding, only different ones are encoded, and the ids of all
occurrences are gathered with array operations. Of a stretch of Latin letters and marks, the
letters are one word for the vocabulary's model; a last mark is cut off by Arrow, so a word is looked
up once whatever follows it, and each Python worker keeps the ids of words it has seen (a bounded
number). Everything else goes through the whole library.
``Encoder`` refuses a vocabulary for which this does not hold on a probe text.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rebuy.llm.common import Memo, worker_memo

REMEMBERED = 500_000  # words kept by each worker; about 100 MB
LONGEST_REMEMBERED = 48  # characters
CHUNK_BYTES = 2 << 20  # of text that is split at once, unless a single text is longer

# Letters of ASCII and Latin-1, then ASCII punctuation without an apostrophe.
_MARKS = "".join(c for c in string.punctuation if c != "'")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_LATIN = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
_PROBE = "Some words, l'été <|endoftext|>x\nand 12 of it's; O.K. naïve TARİHİ, VERGİ. হয়, क़. abcשׁ, été." + "., ".join(_LATIN)


def joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ids of the entries, and all ids."""
    return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")


def gathered(sizes: np.ndarray, table: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of entry numbers, how many ids a row's entries have together, and the ids of all rows."""
    lengths = sizes[which]
    flat = lengths.ravel()
    at = np.repeat((np.cumsum(sizes) - sizes)[which.ravel()] - (np.cumsum(flat) - flat), flat)
    at += np.arange(len(at))
    return lengths.sum(axis=1), table[at]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = Memo(self._word, REMEMBERED)
        self.others = Memo(self._other, REMEMBERED // 4)
        self.letters = Memo(self._ends_in_letter, REMEMBERED)
        # How the vocabulary writes the bytes of a letter.
        self.spelt = str.maketrans({c: self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LATIN})
        # Ids of a mark by its byte; byte 0 stands for no mark.
        self.marks = [self._word(chr(b)) if b and chr(b) in _MARKS else b"" for b in range(128)]
        if self.ids(_PROBE) != self._full(_PROBE):
            raise ValueError(f"the tokens of {path} cross white space")

    def _full(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of lower-case Latin letters, or of ASCII punctuation: one pre-token, no normalisation to do."""
        spelt = word if word.isascii() else word.translate(self.spelt)
        return array("I", [t.id for t in self.library.model.tokenize(spelt)]).tobytes()

    def _ends_in_letter(self, char: str) -> bool:
        """Whether a mark after ``char`` is a pre-token of its own; normalised, some letters end in a combining mark."""
        text = self.library.normalizer.normalize_str(char + ".")
        return char.isalpha() and self.library.pre_tokenizer.pre_tokenize_str(text)[-1][0] == "."

    def _other(self, text: str) -> bytes:
        if text[-1:] in (".", ",") and len(text) > 1 and self.letters[text[-2]] and "<|" not in text:
            return self.stretch(text[:-1]) + self.words[text[-1]]
        return self._full(text) if text else b""

    def stretch(self, text: str) -> bytes:
        """The ids of a text without spaces and line ends."""
        if len(text) > LONGEST_REMEMBERED:
            return self._full(text)
        if plain := _PLAIN.fullmatch(text):
            letters, marks = plain.groups()
            return self.words[letters.lower()] + self.words[marks] if marks else self.words[letters.lower()]
        return self.others[text]

    def letters_of(self, text: str) -> bytes | None:
        """The ids of Latin letters or of nothing; none for a text that is not all such letters, or that is long."""
        if len(text) > LONGEST_REMEMBERED:
            return None
        if not (text.isascii() and text.isalpha() and text.islower()):
            if not _LETTERS.fullmatch(text):
                return None if text else b""
            text = text.lower()
        return self.words[text]

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids of different stretches, and the ids."""
        trimmed = pc.ascii_rtrim(texts, _MARKS)
        cut = np.asarray(pc.subtract(pc.binary_length(texts), pc.binary_length(trimmed)))
        data, ends = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)
        one = np.flatnonzero(cut == 1)
        mark = np.zeros(len(texts), np.int64)
        mark[one] = data[ends[texts.offset + 1 :][one] - 1]
        found = trimmed.dictionary_encode()
        words, unit = found.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(found.indices).astype(np.int64)
        known, other = list(map(self.words.get, words)), np.zeros(len(words), bool)
        for k in [k for k, ids in enumerate(known) if ids is None]:
            if (ids := self.letters_of(words[k])) is None:
                other[k], ids = True, b""
            known[k] = ids
        rest = np.flatnonzero(other[unit] | (cut > 1))
        unit[rest], mark[rest] = len(known) + np.arange(len(rest)), 0
        whole = texts.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()
        ids = [*self.marks, *known, *map(self.stretch, whole)]
        return gathered(*joined(ids), np.stack([unit + len(self.marks), mark], axis=1))

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For consecutive chunks of the texts: where each text's ids end, and the ids.

        A null or empty text has none.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
        at = 0
        while at < len(texts):
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right")))
            yield self._chunk(texts.slice(at, end - at))
            at = end
        pa.default_memory_pool().release_unused()

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Special tokens are read before letters are lower-cased; without them the order does not matter.
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = pc.list_flatten(parts).dictionary_encode()
        sizes, ids = gathered(*self._stretches(found.dictionary), np.asarray(found.indices)[:, None])
        last = np.cumsum(np.asarray(pc.list_value_length(parts)))
        return np.concatenate(([0], np.cumsum(sizes)))[last], ids

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for ends, ids in self.batches(texts):
            data, start = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
            for end in ends.tolist():
                yield bytes(data[4 * start : 4 * end])
                start = end

    def ids(self, text: str | None) -> bytes:
        return next(self.texts(pa.array([text], pa.string())))


def encoder(path: str) -> Encoder:
    return worker_memo(f"encoder:{path}", lambda: Encoder(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
