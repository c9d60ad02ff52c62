"""Alignment of the tokens of two public tokenizers over the same bytes.

Tokenizer A (a `tokenizers` file, byte-level) encodes a space and the text, tokenizer B (a `sentencepiece` file, which adds
the space itself) the text. Both cover the same bytes, so a byte offset where a token of A and one of B end is a shared cut.
`shared_cuts` finds all of them by divide and conquer: in each interval the first common end at or behind the middle is
located by bisection in the two sorted arrays of ends (and, if there is none before the interval's end, the last one before
the middle); both halves are treated alike, and an interval without a common end is a leaf: one group of tokens. All intervals of one
level, of all texts of a batch, are halved at once. The walk from a middle never leaves one group, and a group holds the
middle of a few intervals only, so the work is that of a bisection per group.

A link is a pair of a token of A and a token of B that end together. The bytes of one are then a suffix of the other's, so the
number of different pairs of ids is bounded by the lengths of the vocabularies' entries (`most_pairs`), whatever the corpus:
counts of pairs are a table that may go to every task. Texts are encoded once; their links are written to the shared
folder, counted from there, and each document meets the counts in a second pass over the links alone.

Null and empty texts, and those whose joined token bytes differ from the space and the text, have no tokens: zeros, and an
empty string of groups. Every row is a document: repeated rows and ties of doc_id give repeated rows, null doc_ids stay. Extra columns
are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, _slices, utf8, written
from .tokens import _ODD, Encoder, _gather, _values, default_tokenizer

#: Text taken at once; a longer text is one piece.
SLICE_BYTES = 1 << 20
#: Stretches whose ids a task keeps for each tokenizer; beyond that it starts anew.
KNOWN = 150_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class SpacedEncoder(Encoder):
    """Tokenizer A: the ids of a space and the text, without an end id."""

    def spaced(self, texts: pa.Array, odd: np.ndarray) -> list[np.ndarray]:
        """`odd` marks texts that must be encoded whole."""
        if len(self.known) > KNOWN:
            self._forget()
        both = pc.binary_join_element_wise(" ", texts, "")
        plain, whole = both.filter(pa.array(~odd)), both.filter(pa.array(odd))
        found = {False: iter(self._plain(plain) if len(plain) else []), True: iter(self.whole(whole.to_pylist()) if len(whole) else [])}
        return [next(found[o])[:-1] for o in odd.tolist()]

    def byte_table(self) -> list[bytes]:
        """The bytes of each id; an entry that is not byte-level stands for its own text."""
        letters = {chr(c): b for b, c in self.letters.items()}
        out = []
        for i in range(self.tokenizer.get_vocab_size()):
            entry = self.tokenizer.id_to_token(i) or ""
            out.append(bytes(letters[c] for c in entry) if all(c in letters for c in entry) else utf8(entry))
        return out


class PieceEncoder:
    """Tokenizer B. No entry of its vocabulary has the mark of a space behind another character, so nothing is joined across
    the place before a space, nor next to a line end; each distinct stretch between is encoded once and its ids are kept.
    """

    def __init__(self, path: str | None = None) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path or default_pieces())
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.names = names
        byte = [i for i, p in enumerate(names) if self.model.is_byte(i)]
        joins = [p for i, p in enumerate(names) if i not in set(byte) and (re.search("[^▁]▁", p) or "\n" in p)]
        self.by_stretch = not joins and len(byte) == 256
        self._forget()

    def _forget(self) -> None:
        """Stretches by number, and where each number's ids are in one array."""
        self.known: dict[str, int] = {}
        self.stored = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _numbers(self, stretches: list[str]) -> np.ndarray:
        found = list(map(self.known.get, stretches))
        if None in found:
            new = [s for s, n in zip(stretches, found) if n is None]
            # A stretch from a line end on follows no space, but the model puts one before every text.
            ids = [i[1:] if s[0] == "\n" else i for s, i in zip(new, self.model.encode(new, num_threads=1))]
            self.known.update(zip(new, range(len(self.at) - 1, len(self.at) - 1 + len(new))))
            first = self.at[-1]
            self.at = np.concatenate([self.at, first + np.cumsum([len(i) for i in ids], dtype=np.int64)])
            while self.at[-1] > len(self.stored):
                self.stored = np.concatenate([self.stored, np.zeros_like(self.stored)])
            self.stored[first : self.at[-1]] = np.fromiter((x for i in ids for x in i), np.uint32)
            found = [self.known[s] if n is None else n for s, n in zip(stretches, found)]
        return np.array(found, np.int64)

    def byte_table(self) -> list[bytes]:
        return [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else utf8(p.replace("▁", " ")) for i, p in enumerate(self.names)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def spaced(self, texts: pa.Array, odd: np.ndarray) -> list[np.ndarray]:
        if not self.by_stretch:
            return self.whole(texts.to_pylist())
        # A text with the mark itself could join it with the space behind it.
        odd = odd | pc.match_substring(texts, "▁").to_numpy(zero_copy_only=False)
        plain, whole = texts.filter(pa.array(~odd)), texts.filter(pa.array(odd))
        found = {False: iter(self._plain(plain) if len(plain) else []), True: iter(self.whole(whole.to_pylist()))}
        return [next(found[o]) for o in odd.tolist()]

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.known) > KNOWN:
            self._forget()
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x00"), "\n", "\x00\n")
        lists = pc.split_pattern(cut, "\x00")
        coded = lists.flatten().dictionary_encode()
        numbers = self._numbers(_values(coded.dictionary))[coded.indices.to_numpy()]
        flat, ends = _gather(self.stored, self.at[numbers], self.at[numbers + 1] - self.at[numbers])
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class ByteTable:
    """The bytes of each id as one array."""

    def __init__(self, entries: list[bytes]) -> None:
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each id end."""
        ends = np.cumsum(self.lengths[ids])
        return ends.astype(np.int32) if len(ends) and ends[-1] < 2**31 else ends

    def differing(self, ids: list[np.ndarray], data: list[bytes]) -> list[int]:
        """Which lists of ids do not spell their data. Empty lists are left out."""
        has = [k for k, i in enumerate(ids) if len(i)]
        if not has:
            return []
        flat = np.concatenate([ids[k] for k in has])
        spelt, ends = _gather(self.flat, self.starts[flat], self.lengths[flat])
        spelt = spelt.tobytes()
        if spelt == b"".join(data[k] for k in has):
            bounds = ends[np.cumsum([len(ids[k]) for k in has]) - 1]
            if (bounds == np.cumsum([len(data[k]) for k in has])).all():
                return []
        last = np.concatenate([[0], ends[np.cumsum([len(ids[k]) for k in has]) - 1]]).tolist()
        return [k for k, x, y in zip(has, last[:-1], last[1:]) if spelt[x:y] != data[k]]


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts one after another: the tokens of A and those of B that end at a shared cut, in order.

    `a_ends` and `b_ends` grow strictly; `a_sizes` and `b_sizes` are the numbers of tokens of each text, which end together.
    """
    at_a, at_b = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    # An interval: tokens a0..a1 of A and b0..b1 of B, the last of which end together.
    a1, b1 = np.cumsum(a_sizes) - 1, np.cumsum(b_sizes) - 1
    has = np.asarray(a_sizes) > 0
    a1, b1, a0, b0 = a1[has], b1[has], (a1 - a_sizes + 1)[has], (b1 - b_sizes + 1)[has]
    at_a[a1], at_b[b1] = True, True
    while True:
        inner = (a0 < a1) & (b0 < b1)
        a0, a1, b0, b1 = a0[inner], a1[inner], b0[inner], b1[inner]
        if not len(a0):
            return np.flatnonzero(at_a), np.flatnonzero(at_b)
        low = np.where(a0 > 0, a_ends[a0 - 1], 0)
        middle = (low + a_ends[a1] + 1) >> 1
        i, j = _common_behind(a_ends, b_ends, middle)
        # Nothing between the middle and the interval's end: look before the middle.
        ahead = np.flatnonzero(i >= a1)
        if len(ahead):
            i[ahead], j[ahead] = _common_before(a_ends, b_ends, middle[ahead], a0[ahead], b0[ahead])
        cut = i >= a0
        a0, a1, b0, b1, i, j = (x[cut] for x in (a0, a1, b0, b1, i, j))
        at_a[i], at_b[j] = True, True
        # Halves side by side: places stay sorted, which keeps the bisection in the cache.
        a0, a1, b0, b1 = (np.stack(x, 1).ravel() for x in ((a0, i + 1), (i, a1), (b0, j + 1), (j, b1)))


def _common_behind(a_ends: np.ndarray, b_ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first common end at or behind each place, as a number in each array; texts end in one."""
    i = np.searchsorted(a_ends, places)
    j = np.searchsorted(b_ends, a_ends[i])
    todo = np.flatnonzero(b_ends[j] != a_ends[i])
    while len(todo):
        i[todo] = np.searchsorted(a_ends, b_ends[j[todo]])
        j[todo] = np.searchsorted(b_ends, a_ends[i[todo]])
        todo = todo[b_ends[j[todo]] != a_ends[i[todo]]]
    return i, j


def _common_before(a_ends: np.ndarray, b_ends: np.ndarray, places: np.ndarray, a0: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last common end before each place and not before tokens a0 and b0; a0 - 1 where there is none."""
    i = np.searchsorted(a_ends, places) - 1
    j = np.full(len(i), -1, np.int64)
    todo = np.flatnonzero(i >= a0)
    while len(todo):
        j[todo] = np.searchsorted(b_ends, a_ends[i[todo]], "right") - 1
        todo = todo[j[todo] >= b0[todo]]
        far = b_ends[j[todo]] != a_ends[i[todo]]
        todo = todo[far]
        i[todo] = np.searchsorted(a_ends, b_ends[j[todo]], "right") - 1
        todo = todo[i[todo] >= a0[todo]]
    none = (i < a0) | (j < b0)
    return np.where(none, a0 - 1, i), j


class Digits:
    """Ids as decimal digits with one sign behind each, joined without a loop over ids."""

    def __init__(self, size: int) -> None:
        digits = [str(i).encode() for i in range(size)]
        self.lengths = np.array([len(d) for d in digits], np.int64)
        self.width = int(self.lengths.max()) + 1
        self.table = np.array([d.ljust(self.width, b"\x00") for d in digits]).view(np.uint8).reshape(size, self.width)

    def joined(self, ids: np.ndarray, signs: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The text and where the part of each id ends in it, the sign included."""
        rows, lengths = self.table[ids], self.lengths[ids]
        rows[np.arange(len(ids)), lengths] = signs
        keep = np.arange(self.width) <= lengths[:, None]
        return rows[keep].tobytes(), np.cumsum(lengths + 1)


@dataclass
class Alignment:
    """One text: ids of both tokenizers, and for each group the number of tokens up to its end."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    groups: str

    def links(self, b_size: int) -> np.ndarray:
        """A pair of ids that end together as one number: id of A times `b_size`, plus id of B."""
        return self.a[self.a_cuts - 1].astype(np.int64) * b_size + self.b[self.b_cuts - 1]


class Aligner:
    def __init__(self, a_path: str | None = None, b_path: str | None = None) -> None:
        self.a_encoder, self.b_encoder = SpacedEncoder(a_path or default_tokenizer()), PieceEncoder(b_path)
        a_bytes, b_bytes = self.a_encoder.byte_table(), self.b_encoder.byte_table()
        self.a_bytes, self.b_bytes = ByteTable(a_bytes), ByteTable(b_bytes)
        self.b_size = len(b_bytes)
        self.digits = Digits(max(len(a_bytes), len(b_bytes)))

    def most_pairs(self) -> int:
        """A bound on the pairs of ids that can end together: an entry has as many suffixes as bytes, and a byte piece may
        stand for the same bytes as an ordinary piece."""
        return int(2 * self.a_bytes.lengths.sum() + self.b_bytes.lengths.sum())

    def align(self, texts: pa.Array) -> list[Alignment]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        a, b = self.a_encoder.spaced(texts, odd), self.b_encoder.spaced(texts, odd)
        none = np.zeros(0, np.uint32)
        data = [utf8(" " + text) for text in _values(texts)]
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            for k in table.differing(ids, data):
                a[k] = b[k] = none
        for k, d in enumerate(data):
            if len(d) == 1:
                a[k] = b[k] = none
        a_sizes, b_sizes = (np.array([len(i) for i in ids], np.int64) for ids in (a, b))
        a_all, b_all = np.concatenate([none, *a]), np.concatenate([none, *b])
        at_a, at_b = shared_cuts(self.a_bytes.ends(a_all), self.b_bytes.ends(b_all), a_sizes, b_sizes)
        text, ends = self._text(a_all, b_all, at_a, at_b)
        out = []
        a_first, b_first = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
        firsts = np.searchsorted(at_a, a_first)
        lasts = np.searchsorted(at_a, a_first + a_sizes)
        for k in range(len(a)):
            i, j = firsts[k], lasts[k]
            x, y = (ends[i - 1] if i else 0), (ends[j - 1] - 1 if j else 0)
            groups = text[x:y].decode() if j > i else ""
            out.append(Alignment(a[k], b[k], at_a[i:j] + 1 - a_first[k], at_b[i:j] + 1 - b_first[k], groups))
        return out

    def _text(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, and where each ends: ids of A, a bar, ids of B, a semicolon."""
        if not len(at_a):
            return b"", np.zeros(0, np.int64)
        # Ids of A follow those of B of the groups before; ids of B those of A up to their own group.
        a_sizes, b_sizes = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        a_place = np.arange(len(a)) + np.repeat(at_b + 1 - b_sizes, a_sizes)
        b_place = np.arange(len(b)) + np.repeat(at_a + 1, b_sizes)
        ids = np.zeros(len(a) + len(b), np.int64)
        signs = np.full(len(ids), ord(","), np.uint8)
        ids[a_place], ids[b_place] = a, b
        signs[a_place[at_a]], signs[b_place[at_b]] = ord("|"), ord(";")
        text, ends = self.digits.joined(ids, signs)
        return text, ends[b_place[at_b]]


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`) and links (see `Alignment.links`) of each row of `docs`."""
    one = Aligner(a_path, b_path)
    number = "int" if len(one.a_bytes.lengths) * one.b_size < 2**31 else "long"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, groups string, links array<{number}>"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            for part in _slices(batch, SLICE_BYTES):
                found = aligner.align(part.column(1))
                links = [f.links(aligner.b_size) for f in found]
                columns = [
                    part.column(0), pa.array([len(f.a) for f in found], pa.int64()), pa.array([len(f.b) for f in found], pa.int64()),
                    pa.array([len(f.a_cuts) for f in found], pa.int64()), pa.array([f.groups for f in found], pa.string()),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, links)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *links])),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """link, n: how many links of all documents hold each pair of ids. A task sends each pair once."""
    links = aligned.select(F.explode("links").alias("link"))
    return links.groupBy(F.col("link").cast("long").alias("link")).agg(F.count("*").alias("n"))


def with_pair_counts(aligned: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Add n_links, n_best and count_sum to the rows of `align`. `aligned` is read twice: hand in a written table.

    n_best counts the links whose pair is the most frequent one of its id of B, ties included.
    """
    aligner = Aligner(a_path, b_path)
    size = aligner.b_size
    counts = pair_counts(aligned).toArrow()
    # Bounded by the vocabularies; some hundred thousand rows.
    assert counts.num_rows <= aligner.most_pairs()
    order = np.argsort(counts["link"].to_numpy())
    links, n = counts["link"].to_numpy()[order], counts["n"].to_numpy()[order]
    most = np.zeros(size, np.int64)
    np.maximum.at(most, links % size, n)
    best = n == most[links % size]
    shared = aligned.sparkSession.sparkContext.broadcast((links, n, best))
    kept = [c for c in aligned.columns if c != "links"]
    types = {f.name: f.dataType.simpleString() for f in aligned.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", n_links long, n_best long, count_sum long"
    arrow = _arrow_schema(aligned.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n, best = shared.value
        for batch in batches:
            for part in _slices(batch, SLICE_BYTES):
                lists = part.column(len(kept))
                ends = np.asarray(lists.offsets).astype(np.int64)
                ends -= ends[0]
                place = np.searchsorted(links, lists.flatten().to_numpy())
                sums = np.zeros((2, len(place) + 1), np.int64)
                if len(place):
                    np.cumsum(best[place], out=sums[0, 1:])
                    np.cumsum(n[place], out=sums[1, 1:])
                n_best, total = (s[ends[1:]] - s[ends[:-1]] for s in sums)
                columns = [*(part.column(i) for i in range(len(kept))), pa.array(np.diff(ends)), pa.array(n_best), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return aligned.select(*kept, "links").mapInArrow(run, schema)


def digest(groups: Column) -> Column:
    """The hex digest of the groups; an empty string without tokens."""
    return F.when(groups == "", F.lit("")).otherwise(F.sha2(groups, 256))


def cross_tokenizer_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum of each row of `docs` (doc_id, text)."""
    found = align(docs, a_path, b_path).withColumn("groups_sha256", digest(F.col("groups"))).drop("groups")
    return with_pair_counts(written(found, "aligned"), a_path, b_path)
