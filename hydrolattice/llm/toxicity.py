"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers are composed over a clause: insults (an automaton over word beginnings, with weights learned from labels),
threats, targets (anywhere in the clause), negation (of the words behind it), and reported speech (of the words before and
behind it). Each insult or threat becomes a matched part in one situation, and a clause gives the weight of its matches in each
situation. A logistic model over what the clauses of a text gave in each situation is the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, remainder, slices, stored

# Words of the four languages that turn what is said.
TARGETS = frozenset("you your yours you're u he she they them him her toi vous tu te ton ta votre du dich dir dein deine ihr euch sie tú usted ustedes ti tus él ella ellos".split())
THREATS = frozenset("kill hurt destroy burn shoot beat stab punish attack crush tuer frapper détruire brûler töten schlagen vernichten verbrennen matar golpear destruir quemar".split())
NEGATIONS = frozenset("not never don't doesn't didn't isn't aren't wasn't won't ne pas jamais nicht kein keine niemals nie nunca jamás tampoco".split())
REPORTS = frozenset("said says wrote writes quoted quote reported claims claimed called dit disait écrit déclaré sagte schrieb behauptete dijo dice escribió".split())

SITUATIONS = ("plain", "targeted", "negated", "reported", "threat", "threatened")
TARGET, NEGATION, REPORT, THREAT = -3.0, -1.0, -2.0, -4.0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_CLOSES = ".!?;:"
MAX_COUNTED = 200_000


@dataclass(frozen=True)
class Learning:
    """``sample`` bounds the labelled rows that the lexicon and the model learn from (about, chosen by hash)."""

    sample: int = 60_000
    shortest: int = 3
    longest: int = 8
    min_documents: int = 3
    min_evidence: float = 8.0  # beyond the logarithm of the number of features looked at
    max_entries: int = 5_000
    reach: int = 3  # words after a negation or report that it covers


def bare(word: str) -> str:
    return _EDGES.sub("", word)


def beginnings(words: set[str], learning: Learning) -> set[str]:
    """Features of distinct words: each beginning followed by ``*``, and whole words followed by ``$``."""
    out = set()
    for w in words:
        if len(w) >= learning.shortest:
            out.update(w[:n] + "*" for n in range(learning.shortest, min(len(w), learning.longest) + 1))
        out.add(w + "$")
    return out


class Grammar:
    """The insult automaton as a table of states and the clause transducer that runs on it."""

    def __init__(self, entries: dict[str, float], reach: int):
        self.reach = reach
        self.step: list[dict[str, int]] = [{}]
        self.accept: list[float] = [0.0]  # weight once the state is reached
        self.end: list[float] = [0.0]  # weight if the word ends in the state
        self.known: dict[str, float] = {}
        for entry, weight in entries.items():
            state = 0
            for letter in entry[:-1]:
                if letter not in self.step[state]:
                    self.step[state][letter] = len(self.step)
                    self.step.append({})
                    self.accept.append(0.0)
                    self.end.append(0.0)
                state = self.step[state][letter]
            table = self.accept if entry[-1] == "*" else self.end
            table[state] = max(table[state], weight)

    def insult(self, word: str) -> float:
        """Largest weight that the automaton accepts on a word."""
        state, best = 0, 0.0
        for letter in word:
            state = self.step[state].get(letter, -1)
            if state < 0:
                return best
            best = max(best, self.accept[state])
        return max(best, self.end[state])

    def mark(self, raw: str) -> float:
        """What a word is to the grammar: the weight of an insult, a mark below zero, or 0."""
        word = bare(raw)
        weight = self.insult(word)
        return NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else THREAT if word in THREATS else weight

    def clause(self, marks: list[tuple[int, float]], sums: dict[str, float]) -> None:
        """Add the weight of one clause's matches in each situation to ``sums``; ``marks`` are places and marks of its words."""
        if not any(m > 0 or m == THREAT for _, m in marks):
            return
        targeted = any(m == TARGET for _, m in marks)
        behind: list[bool] = []  # whether a report follows within reach, from the clause's end on
        ahead = math.inf
        for i, m in reversed(marks):
            ahead = i if m == REPORT else ahead
            behind.append(ahead - i <= self.reach)
        negation = report = -math.inf
        for (i, m), told in zip(marks, reversed(behind), strict=True):
            negation = i if m == NEGATION else negation
            report = i if m == REPORT else report
            if m <= 0 and m != THREAT:
                continue
            if told or i - report <= self.reach:
                situation = "reported"
            elif i - negation <= self.reach:
                situation = "negated"
            elif m == THREAT:
                situation = "threatened" if targeted else "threat"
            else:
                situation = "targeted" if targeted else "plain"
            if m != THREAT or situation.startswith("threat"):  # a threat that is denied or told is none
                sums[situation] += 1.0 if m == THREAT else m

    def read(self, text: str) -> list[float]:
        """Summed weight of each situation over all clauses, and the largest single weight. Clauses end at closing punctuation and
        line ends."""
        sums = dict.fromkeys(SITUATIONS, 0.0)
        top, known = 0.0, self.known
        if len(known) > 150_000:
            known.clear()
        for line in text.lower().split("\n"):
            marks: list[tuple[int, float]] = []
            for i, raw in enumerate(_WORD.findall(line)):
                mark = known.get(raw)
                if mark is None:
                    known[raw] = mark = self.mark(raw)
                if mark:
                    marks.append((i, mark))
                    top = max(top, mark)
                if raw[-1] in _CLOSES and marks:
                    self.clause(marks, sums)
                    marks = []
            if marks:
                self.clause(marks, sums)
        return [*(math.log1p(sums[s]) for s in SITUATIONS), top]


@dataclass(frozen=True)
class Model:
    entries: dict[str, float]
    reach: int
    weights: tuple[float, ...]
    intercept: float

    def scores(self, readings: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(readings @ np.array(self.weights) + self.intercept, -30, 30)))


def _counts(rows: DataFrame, learning: Learning, wanted: set[str] | None) -> DataFrame:
    """Documents per feature (``n``), summed inside each task first; only ``wanted`` features where given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    found = beginnings({w for w in map(bare, _WORD.findall(text.lower())) if w}, learning)
                    counts.update(found if wanted is None else found & wanted)
                    if len(counts) > MAX_COUNTED:
                        yield flush()
        if counts:
            yield flush()

    return rows.select("body").mapInArrow(run, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def lexicon(sample: DataFrame, learning: Learning) -> dict[str, float]:
    """Word beginnings and words whose documents are toxic far more often than chance, with their log odds.

    Evidence is documents times log odds, so a feature needs either many toxic documents or none that is not; at most
    ``max_entries`` reach the driver. A beginning stands for longer ones with about its odds, and gives way to a longer one
    that has most of its toxic documents and better odds.
    """
    n = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, fine = n.get(True, 0), n.get(False, 0)
    if not bad or not fine:
        return {}
    hits = _counts(sample.where("toxic = 1"), learning, None).where(F.col("n") >= learning.min_documents)
    hits = {r["feature"]: r["n"] for r in hits.orderBy(F.desc("n"), "feature").limit(20 * learning.max_entries).collect()}
    misses = {r["feature"]: r["n"] for r in _counts(sample.where("toxic = 0"), learning, set(hits)).collect()}
    found, least = {}, learning.min_evidence + math.log(len(hits) + 1)
    for feature, k in hits.items():
        odds = math.log((k + 0.5) / (bad + 1)) - math.log((misses.get(feature, 0) + 0.5) / (fine + 1))
        if k * odds >= least and odds > 2 and k > 2 * misses.get(feature, 0):
            found[feature] = (k, odds)
    beginnings_of = {f: [s for n in range(learning.shortest, len(f)) if (s := f[:n] + "*") != f and s in found] for f in found}
    blurred = {s for f, shorter in beginnings_of.items() for s in shorter if found[f][0] >= 0.9 * found[s][0] and found[f][1] >= found[s][1] + 0.5}
    kept: dict[str, float] = {}
    for feature in sorted(set(found) - blurred, key=lambda f: (len(f), f)):
        if not any(s in kept and found[s][1] >= found[feature][1] - 0.5 for s in beginnings_of[feature]):
            kept[feature] = found[feature][1]
    return dict(sorted(kept.items(), key=lambda x: (-found[x[0]][0] * x[1], x[0]))[: learning.max_entries])


def labelled_sample(docs: DataFrame, labels: DataFrame, learning: Learning, *, key: str, text: str, label: str, usable) -> DataFrame:
    """At most about ``sample`` labelled rows (body, toxic), chosen by hash of the key. Of repeated labels the largest counts."""
    usable_labels = labels.where((F.lit(True) if usable is None else usable) & F.col(label).isNotNull() & F.col(key).isNotNull())
    total = usable_labels.count()
    modulus = max(1, -(-total // learning.sample))
    some = usable_labels.where(F.pmod(F.xxhash64(F.col(key)), F.lit(modulus)) == 0).groupBy(F.col(key).alias("_label_key")).agg(F.max(F.col(label)).cast("int").alias("toxic"))
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    # about `sample` keys of eight bytes: a bounded broadcast
    return docs.select(F.col(key).alias("_key"), body).join(F.broadcast(some), F.col("_key") == F.col("_label_key")).select("body", "toxic")


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, learning: Learning = Learning()) -> Model:
    """Lexicon and clause weights from labelled rows where ``usable`` holds. The clause weights are fitted to readings of each
    half of the sample with a lexicon of the other half, so words that fit by chance get no credit. Without both kinds of labels every score is the
    share of toxic labels (0.5 where there is none)."""
    sample = stored(labelled_sample(docs, labels, learning, key=key, text=text, label=label, usable=usable), "labelled")
    entries = lexicon(sample, learning)
    width = len(SITUATIONS) + 1
    if not entries:
        share = sample.agg(F.avg("toxic")).first()[0]
        share = 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)
        return Model({}, learning.reach, (0.0,) * width, math.log(share / (1 - share)))
    half = F.pmod(F.xxhash64("body"), F.lit(2))
    parts = [sample.where(half == i) for i in (0, 1)]
    unseen = [readings(part, ["toxic"], lexicon(other, learning), learning.reach, "body") for part, other in (parts, parts[::-1])]
    rows = stored(unseen[0].unionAll(unseen[1]), "readings")
    vectors = rows.select(array_to_vector("reading").alias("features"), F.col("toxic").cast("double").alias("label"))
    fitted = LogisticRegression(maxIter=25, regParam=1e-3).fit(vectors)
    return Model(entries, learning.reach, tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))


def readings(docs: DataFrame, keep: list[str], entries: dict[str, float], reach: int, text: str) -> DataFrame:
    def build():
        grammar = Grammar(entries, reach)
        return lambda texts: [[grammar.read(t) for t in texts]]

    return map_texts(docs, text, keep, "reading array<double>", build)


def score(docs: DataFrame, keep: list[str], model: Model, *, text: str = "text") -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), from whole texts.

    Missing and empty texts match nothing and get the score of a text without matches. Repeated rows stay.
    """
    def build():
        grammar = Grammar(model.entries, model.reach)

        def compute(texts: list[str]):
            scores = model.scores(np.array([grammar.read(t) for t in texts], float).reshape(len(texts), -1))
            return scores, (scores >= 0.5).astype(np.int32)

        return compute

    return map_texts(docs, text, keep, "score double, predicted int", build)


def held_out(key: str = "doc_id"):
    return remainder(key, 5) == 0
