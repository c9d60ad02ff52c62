"""Text columns: stripping, words, n-grams. Native expressions only, so that they stay in
whole-stage codegen and also run on streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that str.strip() removes, as one regex class body.
SPACE_CLASS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# A word run of at least two characters, and a word run or a single symbol.
WORD_RUN = r"[\p{L}\p{N}_]{2,}"
WORD_OR_SYMBOL = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
# A first character that counts as a digit, and the token that replaces the word.
LEADING_DIGIT = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
NUMBER_TOKEN = "#NUMBER"
# Fixed value: the mark for a word start in learned pieces.
WORD_START = "▁"


def strip_right(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{SPACE_CLASS}]+$", "")


def strip_both(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def has_text(c: Column) -> Column:
    """At least one character that is not white space."""
    return c.rlike(rf"[^{SPACE_CLASS}]")


def word_list(c: Column) -> Column:
    """Words and single symbols, case kept, in order."""
    return F.regexp_extract_all(c, F.lit(WORD_OR_SYMBOL), F.lit(0))


def analyzed_words(c: Column) -> Column:
    """Lowercased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RUN), F.lit(0))


def space_words(c: Column) -> Column:
    """Pieces between white space; no empty ones."""
    return F.filter(F.split(c, rf"[{SPACE_CLASS}]+"), lambda w: w != "")


def mark_numbers(words: Column) -> Column:
    """Replace every word that begins with a digit by one placeholder."""
    return F.transform(
        words, lambda w: F.when(w.rlike(LEADING_DIGIT), F.lit(NUMBER_TOKEN)).otherwise(w)
    )


def drop_words(words: Column, stop: list[str]) -> Column:
    """Remove stop words but keep repeats of the others. `stop` is a short given list."""
    if not stop:
        return words
    return F.filter(words, lambda w: ~w.isin(*stop))


def word_ngrams(words: Column, lo: int, hi: int) -> Column:
    """All n-grams of lo..hi words, joined by one space, shorter ones first."""
    if (lo, hi) == (1, 1):
        return words
    # Shifted copies are zipped, so that the words are not computed again for every position.
    runs, gram = [], words
    for n in range(1, hi + 1):
        if n > 1:
            shifted = F.slice(words, F.lit(n), F.greatest(F.size(words), F.lit(1)))
            # The zip is as long as the longer side; positions past the last word give null.
            gram = F.filter(
                F.zip_with(gram, shifted, lambda x, y: F.concat(x, F.lit(" "), y)), lambda g: g.isNotNull()
            )
        if n >= lo:
            runs.append(gram)
    return F.concat(*runs)


def padded_words(c: Column) -> Column:
    """Lowercased words between white space, each with a space on both sides."""
    return F.transform(space_words(F.lower(c)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def _cut(w: Column, n: int):
    return lambda start: F.substring(w, start, F.lit(n))


def char_ngrams(c: Column, lo: int, hi: int) -> Column:
    """Character n-grams that stay inside padded words."""
    return F.flatten(F.transform(padded_words(c), lambda w: word_char_ngrams(w, lo, hi)))


def word_char_ngrams(word: Column, lo: int, hi: int) -> Column:
    """Character n-grams of one padded word.

    A padded word that is not longer than n gives itself, once: only for the smallest such n.
    """

    def of_word(w: Column) -> Column:
        length = F.length(w)
        runs = []
        for n in range(lo, hi + 1):
            starts = F.sequence(F.lit(1), F.greatest(length - n, F.lit(0)) + 1)
            grams = F.transform(starts, _cut(w, n))
            if n == lo:
                runs.append(grams)
            else:
                # The word was already given whole when it is not longer than n - 1.
                runs.append(F.when(length > n - 1, grams).otherwise(F.array().cast("array<string>")))
        return F.concat(*runs)

    return of_word(word)


def characters(c: Column) -> Column:
    """One entry per code point."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def substrings(c: Column, longest: int) -> Column:
    """All substrings of 1..longest characters, with repeats."""
    size = F.length(c)
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)),
                lambda n: F.substring(c, i, n),
            ),
        )
    )
