"""Toxicity by a weighted grammar of clauses.

A text is cut into clauses. Five small transducers run over the words of a clause: insult (stems from a lexicon that is
learned from labels, next to fixed words), threat, target, negation and reported speech. Their composition gives each
matched clause one kind, e.g. a negated insult or a targeted threat; a document's score is the logistic of the weights of
its kinds. The weights are fitted on labelled rows. Isolated words never score: only clauses that end in an accepting
state do, and what stands before the match in the same clause changes the kind.

Null and empty texts have no clause and get the score of the intercept. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, written

#: The classifier is fitted on at most this many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Stems of this many characters at least, and at most.
STEM = (3, 8)
#: A stem may have to be met in up to so many different words of a text.
LEVELS = 4

# Words of the transducers.
INSULTS = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()
THREATS = "beat burn crush destroy hurt kill shoot stab strangle".split()
TARGETS = "he her him she their them they you your yourself these those".split()
NEGATIONS = "cannot hardly kein keine nicht never no none not nunca pas".split()
REPORTS = "called calls claimed quote quoted quotes reported reports said says stated told wrote writes".split()

KINDS = ("insult", "insult_at_target", "insult_negated", "insult_reported", "threat_at_target", "threat_other")
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Grammar:
    """Stems of insults with the number of different words that must have a stem in one text, and weights of the kinds."""

    stems: dict[str, int] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1))
    weights: dict[str, float] = field(default_factory=lambda: {"bias": -3.0, "insult": 5.0, "insult_at_target": 6.0, "insult_negated": 1.0, "insult_reported": 1.5, "threat_at_target": 4.0, "threat_other": 0.5})

    def read(self, word: str, known: dict[str, tuple]) -> tuple:
        """(symbol, stems): the input symbol of a word, and the stems that make it an insult where enough words have them."""
        found = known.get(word)
        if found is None:
            own = {word[:n] for n in range(STEM[0], min(len(word), STEM[1]) + 1)} | {word}
            stems = tuple(s for s in own if s in self.stems)
            if any(self.stems[s] == 1 for s in stems):
                found = "I", ()
            else:
                found = next((s for s, words in _LEXICON if word in words), "."), stems
            if len(known) > 300_000:
                known.clear()
            known[word] = found
        return found

    def kinds(self, text: str | None, known: dict[str, tuple]) -> Counter:
        """How many clauses of each kind a text has."""
        clauses = [_WORD.findall(c) for c in _CLAUSE.split((text or "").lower())]
        seen: dict[str, set] = defaultdict(set)
        read = [[self.read(w, known) for w in words] for words in clauses]
        for words, symbols in zip(clauses, read):
            for w, (_, stems) in zip(words, symbols):
                for s in stems:
                    seen[s].add(w)
        met = {s for s, words in seen.items() if len(words) >= self.stems[s]}
        found: Counter = Counter()
        for symbols in read:
            tape = "".join("I" if stems and not met.isdisjoint(stems) else symbol for symbol, stems in symbols)
            if "I" in tape or "H" in tape:
                kind = clause_kind(tape)
                if kind:
                    found[kind] += 1
        return found

    def score(self, found: Counter) -> float:
        z = self.weights["bias"] + sum(self.weights[k] * np.log1p(n) for k, n in found.items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_LEXICON = (("H", frozenset(THREATS)), ("T", frozenset(TARGETS)), ("N", frozenset(NEGATIONS)), ("R", frozenset(REPORTS)))

# The composed transducers, in order of preference, as expressions over symbols. "." is any other word.
_PATHS = (
    ("threat_at_target", re.compile(r"H[.]{0,2}T")),
    ("insult_reported", re.compile(r"^[^IH]*R[^IH]*I")),
    ("insult_negated", re.compile(r"N[.T]{0,3}I(?!.*I)")),
    ("insult_at_target", re.compile(r"T[.]{0,3}I|I[.]{0,3}T")),
    ("insult", re.compile(r"I")),
    ("threat_other", re.compile(r"H")),
)


def clause_kind(symbols: str) -> str | None:
    """The kind of a clause from its symbols; reported speech is tested before negation, both before a plain insult."""
    return next((kind for kind, path in _PATHS if path.search(symbols)), None)


def _stems_of(text: str | None) -> set[tuple[str, int]]:
    """(stem, k) for every stem that k different words of a text have, up to LEVELS."""
    words = set(_WORD.findall((text or "").lower()))
    count = Counter(w[:n] for w in words for n in range(STEM[0], min(len(w), STEM[1]) + 1))
    return {(s, k) for s, n in count.items() for k in range(1, min(n, LEVELS) + 1)}


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Grammar:
    """A grammar from texts (doc_id, text) and labels (doc_id, toxic), of which at most `rows` are used.

    The bounded choice of labels is made before texts are looked at, so that only these texts move.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    totals = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") != 0).cast("int")), F.lit(0))).first()
    n, toxic = int(totals[0]), int(totals[1])
    if not toxic or toxic == n:
        return Grammar()
    found = _candidates(_stem_counts(sample), toxic)
    stems = dict.fromkeys(INSULTS, 1)
    for stem, level in _cover(sample, found):
        stems[stem] = min(level, stems.get(stem, level))
    grammar = Grammar(stems)
    grammar.weights = _fit_weights(sample, grammar)
    return grammar


def _stem_counts(sample: DataFrame) -> DataFrame:
    """stem, level, and in how many clean and toxic texts."""

    def make():
        def work(batch):
            seen: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for key in _stems_of(text):
                    seen[key][toxic != 0] += 1
            yield {"stem": [k[0] for k in seen], "level": [k[1] for k in seen], "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]}

        return work

    parts = per_batch(sample, ["text", "toxic"], "stem string, level int, clean long, toxic long", make)
    return parts.groupBy("stem", "level").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _candidates(count: DataFrame, toxic: int) -> dict[tuple[str, int], int]:
    """Stems and levels that toxic texts have and clean ones hardly, with the number of clean ones.

    One that a shorter stem or a lower level makes needless is left out.
    """
    least = max(3, round(0.004 * toxic))
    rows = count.where((F.col("toxic") >= least) & (F.col("clean") <= F.col("toxic") * 0.05)).collect()  # of a bounded sample
    found = {(r["stem"], r["level"]): (r["toxic"], r["clean"]) for r in rows}

    longer: dict[tuple[str, int], tuple] = {}
    for (stem, level), own in found.items():
        longer.setdefault((stem[:-1], level), own)
        longer[stem[:-1], level] = max(longer[stem[:-1], level], own)

    def needless(key: tuple[str, int], own: tuple[int, int]) -> bool:
        shorter = found.get((key[0][:-1], key[1])), found.get((key[0], key[1] - 1))
        more = any(o and o[0] > own[0] and o[1] <= own[1] for o in shorter)
        # Of stems in the same rows the longest stays, which is the most careful one.
        return more or longer.get(key) == own

    return {key: own[1] for key, own in found.items() if not needless(key, own)}


def _cover(sample: DataFrame, candidates: dict[tuple[str, int], int]) -> list[tuple[str, int]]:
    """Few candidates that are in the toxic rows of the sample, greedily; a clean row weighs as much as three of them."""
    names = set(candidates)
    plain = Grammar()

    def make():
        known: dict[str, tuple] = {}

        def work(batch):
            texts = [t for t in batch["text"] if not plain.kinds(t, known)]  # the fixed words find the others
            yield {"stems": [[f"{s} {k}" for s, k in sorted(_stems_of(t) & names)] for t in texts]}

        return work

    rows = per_batch(sample.where("toxic <> 0"), ["text"], "stems array<string>", make).collect()
    left = [{(s.split(" ")[0], int(s.split(" ")[1])) for s in r["stems"]} for r in rows]
    chosen: list[tuple[str, int]] = []
    while True:
        gain = Counter(key for r in left for key in r)
        for key in gain:
            gain[key] -= 3 * candidates[key]
        # Ties go to the higher level and the longer stem, which are the more careful ones.
        best = max(gain, key=lambda s: (gain[s], s[1], len(s[0]), s), default=None)
        if best is None or gain[best] < 2:
            return chosen
        chosen.append(best)
        left = [r for r in left if best not in r]


def _fit_weights(sample: DataFrame, grammar: Grammar) -> dict[str, float]:
    """Logistic weights of the kinds by Newton steps with a ridge towards the default weights."""

    def make():
        known: dict[str, tuple] = {}

        def work(batch):
            found = [grammar.kinds(t, known) for t in batch["text"]]
            yield {"y": batch["toxic"], "x": [[float(np.log1p(f[k])) for k in KINDS] for f in found]}

        return work

    rows = per_batch(sample, ["text", "toxic"], "y int, x array<double>", make).collect()
    x = np.array([[1.0, *r["x"]] for r in rows])
    y = np.array([float(r["y"] != 0) for r in rows])
    prior = np.array([Grammar().weights[k] for k in ("bias", *KINDS)])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.3 * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(("bias", *KINDS), map(float, np.round(w, 9))))


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, predicted and the number of clauses of each kind, for every row of `docs` (doc_id, text)."""

    def make():
        known: dict[str, tuple] = {}

        def work(batch):
            found = [grammar.kinds(t, known) for t in batch["text"]]
            scores = [grammar.score(f) for f in found]
            counts = {k: [f[k] for f in found] for k in KINDS}
            yield {"doc_id": batch["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores], **counts}

        return work

    schema = "doc_id long, score double, predicted int, " + ", ".join(f"{k} long" for k in KINDS)
    return per_batch(docs, ["doc_id", "text"], schema, make)


def held_out(doc_id: str = "doc_id"):
    """Rows whose label is never used to fit."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit_from_tables(docs: DataFrame, labels: DataFrame) -> Grammar:
    return fit(docs, labels.where(~held_out()))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    grammar = fit_from_tables(docs, labels)
    return toxicity(docs, grammar).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def without_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of `docs`, all columns, that the grammar does not call toxic."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            keep = [grammar.score(grammar.kinds(t, known)) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
