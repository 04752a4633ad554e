"""Ids of the public tokenizers, encoded with the ``tokenizers`` library once per distinct word.

Both vocabularies cut a text into words before they merge anything, so a word's ids do not depend on
its neighbours. Texts are cut at single spaces and line ends, where such a cut is always one of the
library's own, and the ids of each piece are kept in a bounded cache. Arrow cuts the texts of a batch, a few
megabytes at a time, and each distinct piece of those is looked up once. Texts with other white space
that the cut would change go to the library whole. The tests compare both ways.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seriesloom.llm.common import hold

CACHE = 300_000
# Bytes of text whose words are looked up together; a longer text is taken alone.
TOGETHER = 16 << 20
# A word of Latin letters, none of which composes with another, with ASCII marks behind it: the library
# cuts such a piece into just these two.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
MARKS = r"!-&(-/:-@\[-`{-~"
SIMPLE = re.compile(rf"([{LATIN}]+)([{MARKS}]*)")
# The marks one by one, to cut them off.
ASCII_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
# Words that go to the library in one string.
GROUP = 500
# What ``odd`` finds, for Arrow: white space other than a space or a line end, beside another, or at either end.
ODD = (r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
       r"|[ \n][ \n]|\A[ \n]|[ \n]\z")
# How byte-level vocabularies write a space.
SPACE = "\u0120"


def odd(text: str) -> bool:
    """Whether there is white space beside white space, at either end, or other than a space or a line end.

    Such a text falls into other parts at any white space than at single spaces and line ends.
    """
    return text.split() != text.replace("\n", " ").split(" ")


def public_path(name: str) -> str:
    """Where the installed public tokenizer files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the letters below U+0180: every byte of their UTF-8 form as one character.

    Bytes that are printable in Latin-1 stand for themselves, the others follow from U+0100 on.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    written = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(written[b] for b in chr(c).encode()) for c in range(128, 0x180)}


BYTE_LETTERS = _byte_letters()


class _Pieces(dict):
    """Ids of words as bytes. When full, it starts anew and the full one becomes a second look-up."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self.keep(word, found)
        return found

    def keep(self, word: str, ids: bytes) -> None:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = ids


class Encoder:
    """``encode(text)`` gives the ids of a whole text as a uint32 array, as the library does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model, self.normal, self.split = self.library.model, self.library.normalizer, self.library.pre_tokenizer
        # With a normaliser that folds white space no piece keeps any; without one, a space belongs to the word after it.
        self.keeps_space = self.normal is None
        self.parts = _Pieces(self._model)
        self.inner = _Pieces(self._after_space if self.keeps_space else self._chunk)
        self.first = _Pieces(self._chunk)
        self.line_end = self.whole("\n").tobytes() if self.keeps_space else b""
        # The same merges for words that are cut and written already.
        self.merges = Tokenizer(self.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # How many characters of a written word each id stands for.
        suffix, vocabulary = getattr(self.model, "end_of_word_suffix", None) or "", self.library.get_vocab(with_added_tokens=False)
        self.spans = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for entry, k in vocabulary.items():
            self.spans[k] = len(entry.removesuffix(suffix))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _model(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _letters(self, word: str, lead: str = "") -> bytes:
        """Ids of a word of Latin letters."""
        return self._model(lead + self._written(word))

    def _written(self, word: str) -> str:
        if not word.isascii():
            word = (word if self.keeps_space else word.lower()).translate(BYTE_LETTERS)
        return word

    def _learn(self, words: list[str]) -> None:
        """Merge the distinct words of Latin letters that are not known yet, many in one call."""
        known, old = self.inner, self.inner.old
        new = [w for w in words if w not in known and w not in old]
        lead = SPACE if self.keeps_space else ""
        for a in range(0, len(new), GROUP):
            some = new[a : a + GROUP]
            written = [lead + self._written(w) for w in some]
            ids = np.array(self.merges.encode_batch_fast([" ".join(written)], add_special_tokens=False)[0].ids, np.uint32)
            told, ends = np.cumsum(self.spans[ids]), np.cumsum([len(w) for w in written])
            stops = np.searchsorted(told, ends)
            if len(ids) != stops[-1] + 1 or not np.array_equal(told[stops], ends):
                # The vocabulary does not hold every letter, so its ids do not tell where a word ends.
                for word in some:
                    known.keep(word, self._letters(word, lead))
                continue
            data, cuts = ids.tobytes(), (4 * (stops + 1)).tolist()
            for word, start, stop in zip(some, [0, *cuts], cuts):
                known.keep(word, data[start:stop])

    def _after_space(self, word: str) -> bytes:
        simple = SIMPLE.fullmatch(word)
        if not simple:
            return self._library(" " + word)
        return self.inner[simple[1]] + self.parts[simple[2]] if simple[2] else self._letters(word, SPACE)

    def _chunk(self, word: str) -> bytes:
        """Ids of a piece without white space. Where letters are folded, A-Z are lower case already."""
        simple = SIMPLE.fullmatch(word)
        if not simple:
            return self._library(word)
        same = self.first if self.keeps_space else self.inner
        return same[simple[1]] + self.parts[simple[2]] if simple[2] else self._letters(word)

    def _library(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        text = self.normal.normalize_str(chunk) if self.normal is not None else chunk
        return b"".join([self.parts[part] for part, _ in self.split.pre_tokenize_str(text)])

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of distinct pieces as bytes: letters, the marks behind them, and pieces of any other kind whole."""
        first, inner, line_end = self.first, self.inner, self.line_end
        simple = pc.match_substring_regex(words, rf"\A[{LATIN}]+[{MARKS}]*\z")
        plain = pc.if_else(simple, words, "")
        letters = pc.ascii_rtrim(plain, ASCII_MARKS).dictionary_encode()
        marks = pc.replace_substring_regex(plain, rf"\A[{LATIN}]+", "").dictionary_encode()
        others = pc.if_else(simple, "", words).dictionary_encode()
        known = letters.dictionary.to_pylist()
        self._learn([w for w in known if w])
        parts = (
            (letters, [inner[w] if w else b"" for w in known]),
            (marks, [self.parts[w] if w else b"" for w in marks.dictionary.to_pylist()]),
            (others, [line_end + first[w[1:]] if w[:1] == "\n" else inner[w] if w else b"" for w in others.dictionary.to_pylist()]),
        )
        nothing = pa.scalar(b"", pa.large_binary())
        return pc.binary_join_element_wise(*[pa.array(ids, pa.large_binary()).take(coded.indices) for coded, ids in parts], nothing)

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        apart = pc.match_substring(texts, "<|")
        if self.keeps_space:
            apart = pc.or_(apart, pc.match_substring_regex(texts, ODD))
        plain = pc.if_else(apart, "", texts)
        if self.keeps_space:
            # The first word of a line keeps the line end before it. A text's first word gets one too, which is left out below.
            lines = pc.binary_replace_slice(pc.replace_substring(plain, "\n", " \n"), 0, 0, "\n")
        else:
            # The normaliser folds these letters too, after composing, which keeps A-Z apart from a-z only by case.
            lines = pc.replace_substring(pc.ascii_lower(plain), "\n", " ")
        words = pc.split_pattern(lines, " ")
        coded = words.values.dictionary_encode()
        ids = self._distinct(coded.dictionary).take(coded.indices)
        _, places, data = ids.buffers()
        bounds = np.frombuffer(places, np.int64)[words.offsets.to_numpy()].tolist()
        data, skip = memoryview(data or b""), len(self.line_end)
        for k, alone in enumerate(apart.to_pylist()):
            yield self.whole(texts[k].as_py()).tobytes() if alone else bytes(data[bounds[k] + skip : bounds[k + 1]])

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text in turn, as little-endian unsigned 32-bit integers; null texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            yield from self._together(texts[start:stop])
            start = stop

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(next(self.encode_all(pa.array([text], pa.large_string()))), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder per worker process and file; a bare name means an installed public file."""
    hold("tokens", encoder.cache_clear)
    return Encoder(name if os.path.sep in name else public_path(name))
