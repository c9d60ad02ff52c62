"""Short license notices, exact and with a few errors.

Exact phrases are found as runs of whole words. A notice with errors is found in two steps: it is split into one more
piece than the errors it may have, so that at least one piece stands unchanged in any such copy (pigeonhole); an
automaton finds the pieces in one pass over the text, and only around a piece does the regex library test the whole
notice with a bounded number of errors and tell its span. A text with other digits than the notice's is another version,
not a copy with errors.

A text is searched whole, as its words (lower-cased A-Z, letters, digits and non-ASCII characters) with one space
between. Null and empty texts have no words and no places; repeated rows get equal results.
"""

from __future__ import annotations

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import per_batch, word_bytes

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that are searched with errors, and their labels.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution": "cc-attribution",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "mozilla public license version 2 0": "mpl-2.0",
}
#: One error is allowed for so many characters of a notice.
CHARS_PER_ERROR = 12

SPANS = "array<struct<label:string,first_word:long,last_word:long,errors:int,found:string>>"


class Scanner:
    """The automaton of all pieces, and the bounded-error expression of each notice."""

    def __init__(self, notices: dict[str, str]) -> None:
        self.notices = [(n, label, max(1, len(n) // CHARS_PER_ERROR)) for n, label in notices.items()]
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}") for n, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, errors) in enumerate(self.notices):
            for start, piece in pieces(notice, errors + 1):
                where.setdefault(piece, []).append((i, start))
        for piece, places in where.items():
            self.seeds.add_word(piece, (len(piece), places))
        if where:
            self.seeds.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) in `text`; of finds that overlap, those with fewer errors for their length stay."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.seeds.iter(text) if len(self.seeds) else ():
            for i, at in places:
                notice, _, errors = self.notices[i]
                start = end - length + 1 - at
                windows.setdefault(i, []).append((max(0, start - errors), min(len(text), start + len(notice) + errors)))
        found = []
        for i, spans in windows.items():
            for start, end in _joined(spans):
                found += self._copies(i, text, start, end)
        kept: list[tuple[int, int, int, int]] = []
        for f in sorted(found, key=lambda f: (f[3] / (f[2] - f[1]), f[1] - f[2], f[0], f[1])):
            if all(f[2] <= k[1] or k[2] <= f[1] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: (f[1], f[0]))

    def _copies(self, i: int, text: str, start: int, end: int) -> list[tuple[int, int, int, int]]:
        """Copies of notice i in text[start:end]. The best match of a stretch comes first, so those before it are looked for again."""
        notice, _, errors = self.notices[i]
        found, stretches = [], [(start, end)]
        while stretches:
            start, end = stretches.pop()
            for m in self.fuzzy[i].finditer(text, start, end):
                if m.start() - start >= len(notice) - errors:
                    stretches.append((start, m.start()))
                start = m.end()
                if not _other_digits(notice, text, m.start(), m.end()):
                    found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
        return found


def _other_digits(notice: str, text: str, start: int, end: int) -> bool:
    """Whether text[start:end], with the digits that go on after it, has digits that the notice lacks: another version."""
    while end < len(text) and text[end].isdigit() and text[end - 1].isdigit():
        end += 1
    if end < len(text) and text[end - 1] == " " and text[end].isdigit() and not notice.endswith(" "):
        end += 1
    left = iter(c for c in notice if c.isdigit())
    return not all(c in left for c in text[start:end] if c.isdigit())


def pieces(notice: str, n: int) -> list[tuple[int, str]]:
    """`n` pieces of about equal length, with their places."""
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def phrase_places(text: str, phrase: str) -> list[int]:
    """Where `phrase` stands as whole words in `text`, which has one space between, before and after words."""
    out, at = [], text.find(f" {phrase} ")
    while at >= 0:
        out.append(at)
        at = text.find(f" {phrase} ", at + 1)
    return out


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, places (label, first_word of each exact phrase) and spans (notices with errors) of every row."""

    def make():
        scanner = Scanner(notices)

        def work(batch):
            out = {"doc_id": batch["doc_id"], "n_words": [], "places": [], "spans": []}
            for text in batch["text"]:
                words = word_bytes(text)
                flat = b" ".join([b"", *words, b""]).decode("utf-8", "replace") if words else ""
                word_at = lambda at: flat.count(" ", 0, at)
                out["n_words"].append(len(words))
                places = [(at, label) for phrase, label in phrases.items() for at in phrase_places(flat, phrase)]
                out["places"].append([{"label": label, "first_word": word_at(at)} for at, label in sorted(places)])
                spans = []
                for i, start, end, errors in scanner.spans(flat):
                    inside = flat[start:end]
                    first = start + len(inside) - len(inside.lstrip())
                    last = max(first, start + len(inside.rstrip()) - 1)
                    spans.append({"label": scanner.notices[i][1], "first_word": word_at(first) - 1, "last_word": word_at(last) - 1, "errors": errors, "found": inside.strip()})
                out["spans"].append(spans)
            yield out

        return work

    schema = f"doc_id long, n_words long, places array<struct<label:string,first_word:long>>, spans {SPANS}"
    return per_batch(docs, ["doc_id", "text"], schema, make)
