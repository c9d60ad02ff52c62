"""Token ids of whole texts with a public tokenizer file.

The byte-level pre-tokenizer of the file never joins text across a single space between two other characters, nor across
a single line end, so a batch of texts is cut there, each distinct piece is encoded once, and the ids of a piece are kept
for the next batch. A text with other white space, or two of them in a row, goes to the tokenizer whole. The ids are the
same either way (tested).
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a task keeps; beyond that it starts anew.
MEMORY = 1_000_000
END_ID = 2

_CLOSING = ".,;:!?%&$#*|)"
#: One word of characters of which every release of Unicode says that they are letters.
_LATIN = "^ ?[A-Za-zÀ-ÖØ-öø-ɏ]+$"
#: Texts that are not words with one space or line end between.
_ODD = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, int]:
    """Byte to the character that stands for it in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of texts, each with the end id behind it."""

    def __init__(self, path: str | None = None, end_id: int = END_ID) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        # Strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.space = chr(self.letters[0x20])
        self.signs = {b: c for b, c in self.letters.items() if b}  # words are joined by 0
        self.end = end_id
        self._forget()

    def _forget(self) -> None:
        """Pieces by number, and where each number's ids are in one array."""
        self.known: dict[str, int] = {}
        self.stored = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)
        self._add(["", "\x01"], [self.end], [0, 1])

    def _add(self, pieces: list[str], ids: list[int], sizes: list[int]) -> None:
        base = len(self.at) - 1
        self.known.update(zip(pieces, range(base, base + len(pieces))))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.array(sizes, np.int64))])
        while self.at[-1] > len(self.stored):
            self.stored = np.concatenate([self.stored, np.zeros_like(self.stored)])
        self.stored[self.at[base] : self.at[-1]] = ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array([*e.ids, self.end], np.uint32) for e in found]

    def _words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of runs of letters, with a space before them or not, and their numbers: each is one piece for the merges of the model."""
        tokenize = self.model.tokenize
        # Letters of ASCII stand for themselves, and only the space has another sign.
        signs = "\x00".join(words)
        signs = signs.replace(" ", self.space) if signs.isascii() else signs.encode().decode("latin-1").translate(self.signs)
        ids, sizes = [], []
        for word in signs.split("\x00") if words else []:
            own = [t.id for t in tokenize(word)]
            ids += own
            sizes.append(len(own))
        return ids, sizes

    def _numbers(self, pieces: list[str], words: list[bool]) -> np.ndarray:
        """The number of each piece; those met for the first time are encoded. words: which are letters only."""
        found = list(map(self.known.get, pieces))
        if None in found:
            new = {p: w for p, w, n in zip(pieces, words, found) if n is None}
            basic, letters, others = [], [], []
            for p, w in new.items():
                (others if not w else basic if p.isascii() else letters).append(p)
            self._add(basic, *self._words(basic))
            self._add(letters, *self._words(letters))
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            self._add(others, list(chain.from_iterable(lists)), list(map(len, lists)))
            found = list(map(self.known.__getitem__, pieces))
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        plain = texts.filter(pc.invert(odd))
        plain_ids = iter(self._plain(plain)) if len(plain) else iter(())
        odd_ids = iter(self.whole(texts.filter(odd).to_pylist()))
        return [next(odd_ids) if o else next(plain_ids) for o in odd.to_pylist()]

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.known) > MEMORY:
            self._forget()
        # Pieces keep the space before them; a line end is a piece of its own, and so is the end.
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
        lists = pc.split_pattern(pc.binary_join_element_wise(cut, "\x01", "\x00"), "\x00")
        coded = lists.flatten().dictionary_encode()
        # A word and the closing punctuation behind it are encoded apart.
        body = pc.utf8_rtrim(coded.dictionary, characters=_CLOSING)
        word = pc.match_substring_regex(body, _LATIN)
        heads = pc.if_else(word, body, coded.dictionary)
        cut_off = np.flatnonzero(pc.not_equal(pc.binary_length(heads), pc.binary_length(coded.dictionary)))
        tails = [p[len(h) :] for h, p in zip(_values(heads.take(cut_off)), _values(coded.dictionary.take(cut_off)))]
        numbers = np.zeros((len(heads), 2), np.int64)  # piece 0 is empty
        numbers[:, 0] = self._numbers(_values(heads), _values(word))
        numbers[cut_off, 1] = self._numbers(tails, [False] * len(tails))
        numbers = numbers.ravel()
        ids, ends = _gather(self.stored, self.at[numbers], self.at[numbers + 1] - self.at[numbers])
        ends = np.concatenate([[0], ends[1::2]])
        which = coded.indices.to_numpy()
        flat, ends = _gather(ids, ends[which], (ends[1:] - ends[:-1])[which])
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _values(array: pa.Array) -> list:
    """Faster than to_pylist, for arrays without nulls."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `values` one after another, and where each ends."""
    ends = np.cumsum(lengths)
    kind = np.int32 if len(values) < 2**31 > (ends[-1] if len(ends) else 0) else np.int64
    places = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    places += np.arange(len(places), dtype=kind)
    return values[places], ends
