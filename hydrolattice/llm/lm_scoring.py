"""Hidden Markov language model over words.

Latent states emit word classes, and a class emits its words: P(word) = P(class | state) * P(word | class). A class is a
hash of how a word begins and ends, so the state tables have one size whatever the corpus, while P(word | class) comes
from exact counts of every word. Baum-Welch counts are summed inside each task, then across tasks; texts are scored by
the scaled forward recursion, which gives their exact likelihood. Words that training has not seen divide the mass that
absolute discounting leaves in their class by the number of unseen words that the training counts let expect.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import process_wide, remainder, slices, stored
from .shingles import words_of

MAX_WORDS = 250_000


@dataclass(frozen=True)
class Shape:
    """``rounds`` Baum-Welch rounds and one more, each over all training texts."""

    states: int = 8
    classes: int = 2048
    rounds: int = 8
    seed: int = 7
    block_bytes: int = 24 << 20
    least_blocks: int = 48


@dataclass(frozen=True)
class States:
    """Start, transition and class tables; class number ``classes`` is the end of a text."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # (classes + 1, states)


class Classes(dict):
    """Word to class number, kept up to a bound."""

    def __init__(self, classes: int):
        super().__init__()
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = c = xxhash.xxh3_64_intdigest(word[:2] + b" " + word[-3:]) % self.classes
        return c


def first_guess(shape: Shape) -> States:
    """Class tables that differ at random, alike on every machine; states tend to stay."""
    rng = np.random.default_rng(shape.seed)
    emit = rng.gamma(0.5, size=(shape.classes + 1, shape.states)) + 0.05
    emit[-1] = 1.0
    step = np.full((shape.states, shape.states), 0.1 / max(1, shape.states - 1))
    np.fill_diagonal(step, 0.9)
    return States(np.full(shape.states, 1 / shape.states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


class Batch:
    """Sequences in time order: the symbols at one time step of all texts that are long enough lie side by side."""

    def __init__(self, sequences: list[np.ndarray], kind=np.float64):
        self.kind = kind
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.alive = len(ordered) - np.searchsorted(ordered[::-1], np.arange(1, (ordered[0] if len(ordered) else 0) + 1))  # texts at each step
        self.at = np.concatenate([[0], np.cumsum(self.alive)]).astype(np.int64)
        self.symbols = np.empty(int(lengths.sum()), np.intp)
        for rank, i in enumerate(self.order.tolist()):
            self.symbols[self.at[: lengths[i]] + rank] = sequences[i]

    def forward(self, states: States, keep: bool = False):
        """Log likelihood (base e) of each text in the given order; with ``keep`` the scaled states and one over the scale of every
        step instead. States are rows, so that an operation runs along all texts of a step, and weights are looked up where a
        step needs them, so that a step stays in the processor's cache."""
        turned, start, emit = np.ascontiguousarray(states.step.T, self.kind), states.start.astype(self.kind)[:, None], np.ascontiguousarray(states.emit.T, self.kind)
        scale = np.empty(len(self.symbols), self.kind)
        held = np.empty((len(start), len(self.symbols)), self.kind) if keep else None
        now, at = None, self.at.tolist()
        for t, n in enumerate(self.alive.tolist()):
            a, b = at[t], at[t + 1]
            row = held[:, a:b] if keep else np.empty((len(start), n), self.kind)
            weight = emit.take(self.symbols[a:b], axis=1, mode="clip")
            if now is None:
                np.multiply(weight, start, out=row)
            else:
                np.matmul(turned, now[:, :n], out=row)
                row *= weight
            over = scale[a:b]
            np.add.reduce(row, axis=0, out=over)
            np.reciprocal(over, out=over)
            row *= over
            now = row
        if keep:
            return held, scale
        logs, result = np.log(scale), np.zeros(len(self.order))
        for t, n in enumerate(self.alive.tolist()):
            result[:n] -= logs[at[t] : at[t + 1]]
        out = np.empty_like(result)
        out[self.order] = result
        return out

    def expected(self, states: States) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts: starts, transitions, and classes by state."""
        width, size = len(states.start), len(states.emit)
        if not len(self.alive):
            return np.zeros(width), np.zeros_like(states.step), np.zeros((size, width))
        held, scale = self.forward(states, keep=True)
        step, emit = states.step.astype(self.kind), np.ascontiguousarray(states.emit.T, self.kind)
        at, alive, steps = self.at.tolist(), self.alive.tolist(), np.zeros_like(states.step)
        back = np.ones((width, alive[-1]), self.kind)
        for t in range(len(alive) - 1, 0, -1):
            a, b, n = at[t], at[t + 1], alive[t]
            pulled = emit.take(self.symbols[a:b], axis=1, mode="clip")
            pulled *= back
            pulled *= scale[a:b]
            share = held[:, a:b]
            share *= back
            steps += held[:, at[t - 1] : at[t - 1] + n] @ pulled.T  # the same texts one step earlier
            back = np.ones((width, alive[t - 1]), self.kind)
            np.matmul(step, pulled, out=back[:, :n])
        held[:, : at[1]] *= back  # now the share of each state everywhere
        classes = np.stack([np.bincount(self.symbols, share, size) for share in held], 1)
        return held[:, : at[1]].sum(1, dtype=np.float64), steps * states.step, classes


def batches_of(sequences: list[np.ndarray], kind=np.float64, tokens: int = 1_000_000) -> Iterator[tuple[list[int], Batch]]:
    """Sequences of like length together, about ``tokens`` at a time, each batch with the places of its sequences. A batch
    takes as many steps as its longest sequence has tokens, so long texts do not make short ones wait, and the more sequences
    are given at once, the more share a step."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    some, held = [], 0
    for i in order:
        some.append(i)
        held += len(sequences[i])
        if held >= tokens:
            yield some, Batch([sequences[k] for k in some], kind)
            some, held = [], 0
    if some:
        yield some, Batch([sequences[k] for k in some], kind)


def symbols_of(words: list[bytes], classes: Classes, end: int) -> np.ndarray:
    out = np.empty(len(words) + 1, np.int16)
    out[:-1] = np.fromiter(map(classes.__getitem__, words), np.int16, len(words))
    out[-1] = end
    return out


def encoded(texts: DataFrame, shape: Shape) -> DataFrame:
    """Both things that training takes from a text, from one reading: rows with the class numbers of a text as ``symbols``, so that
    rounds need not split texts again, and rows (word, c) with partial counts of words, summed inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = process_wide(f"classes {shape.classes}", lambda: Classes(shape.classes))
        counts: Counter = Counter()

        def rows(symbols: list, words: list, c: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(symbols, pa.binary()), pa.array(words, pa.binary()), pa.array(c, pa.int64())], names=["symbols", "word", "c"])

        def flush() -> pa.RecordBatch:
            out = rows([None] * len(counts), list(counts), list(counts.values()))
            counts.clear()
            return out

        for batch in batches:
            for piece in slices(batch, 0):
                symbols = []
                for text in piece.column(0).to_pylist():
                    words = words_of(text)
                    counts.update(words)
                    symbols.append(symbols_of(words, classes, shape.classes).tobytes())
                yield rows(symbols, [None] * len(symbols), [None] * len(symbols))
                if len(counts) > MAX_WORDS:
                    yield flush()
        if counts:
            yield flush()

    return texts.select("_text").mapInArrow(run, "symbols binary, word binary, c bigint")


def next_states(sums: np.ndarray, shape: Shape) -> States:
    """The M step over flat counts of starts, transitions and classes by state."""
    k, size = shape.states, shape.classes + 1
    starts, steps, emit = sums[:k] + 0.1, sums[k : k + k * k].reshape(k, k) + 0.1, sums[k + k * k :].reshape(size, k)
    emit = emit + 0.02 * (emit.sum(1, keepdims=True) + 1) / (emit.sum() + size) * emit.sum(0) + 1e-3
    return States(starts / starts.sum(), steps / steps.sum(1, keepdims=True), emit / emit.sum(0))


def train_states(rows: DataFrame, shape: Shape) -> States:
    """Baum-Welch over the ``symbols`` of encoded texts, every round over every text. Sums of fixed size reach the driver after
    each round."""
    states = first_guess(shape)
    k, size = shape.states, shape.classes + 1
    rows = rows.where("symbols is not null").select("symbols")
    for _ in range(shape.rounds + 1):

        def run(batches: Iterator[pa.RecordBatch], states=states) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for piece in slices(batch, 0, 16 << 20):
                    sequences = [np.frombuffer(b, np.int16) for b in piece.column(0).to_pylist()]
                    for _, some in batches_of(sequences, np.float32):
                        flat = np.concatenate([c.ravel() for c in some.expected(states)])
                        total = flat if total is None else total + flat
            if total is not None:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["place", "n"])

        sums = np.zeros(k + k * k + size * k)
        for r in rows.mapInArrow(run, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
            sums[r["place"]] = r["n"]
        if not sums.any():
            break
        states = next_states(sums, shape)
    return states


@dataclass(frozen=True)
class Corpus:
    """What the counts of all words come to: tokens and distinct tokens with the end, texts, by class tokens and words, and how many
    words training has not seen (Chao's estimate from words seen once and twice)."""

    tokens: int
    distinct: int
    texts: int
    discount: float
    class_tokens: np.ndarray
    class_words: np.ndarray
    unseen: float

    def word_logs(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(word | class). The mass that discounting leaves in a class, all of it in a class without training words, is
        divided evenly among the class's unseen words: by their estimated number, which is shared out in proportion to the words
        seen in each class, one at least."""
        total, kinds = self.class_tokens[classes], self.class_words[classes]
        words = self.class_words.sum()
        others = np.maximum(1.0, self.unseen * (kinds + 1) / (words + len(self.class_words)))
        mass = np.where(counts > 0, counts - self.discount, self.discount * kinds / others)
        return np.where(total > 0, np.log10(np.maximum(mass, 1e-300) / np.maximum(total, 1)), np.where(counts > 0, 0.0, -np.log10(others)))


def corpus_figures(counts: DataFrame, texts: int, shape: Shape) -> Corpus:
    """One row per class reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(shape.classes)
        sums = np.zeros((shape.classes, 4), np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            of = np.fromiter((classes.__missing__(w) for w in words), np.int64, len(words))
            classes.clear()
            for column, weight in enumerate((n, np.ones(len(n)), n == 1, n == 2)):
                sums[:, column] += np.bincount(of, weight, shape.classes).astype(np.int64)
        some = np.flatnonzero(sums[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(sums[some, c]) for c in range(4))], names=["class", "n", "v", "one", "two"])

    rows = counts.mapInArrow(run, "class bigint, n bigint, v bigint, one bigint, two bigint").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("n", "v", "one", "two")]).collect()
    tokens, words = np.zeros(shape.classes), np.zeros(shape.classes)
    for r in rows:
        tokens[r["class"]], words[r["class"]] = r["n"], r["v"]
    one, two = sum(r["one"] for r in rows), sum(r["two"] for r in rows)
    discount = min(max(one / (one + 2 * two) if one else 0.5, 0.1), 0.95)
    return Corpus(int(tokens.sum()) + texts, int(words.sum()) + (texts > 0), texts, discount, tokens, words, one * (one - 1) / (2 * (two + 1)))


def score_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, shape: Shape = Shape()) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10).

    Training takes the rows whose crc32 of the key as text, modulo ``folds``, is not ``fold``. A missing text is empty and
    has its end as its only token; a missing key counts as empty text in the fold. Repeated rows stay and count as often
    as they occur. Without training rows every base score is 0.

    Texts are dealt into blocks of about ``block_bytes``. Each block sends its distinct words to the word counts and gets
    their counts back, which moves far fewer rows than one per word of every text.
    """
    rows = docs.select(F.col(key).alias("_key"), (remainder(key, folds) == fold).alias("_held"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    train = rows.where("not _held")
    size = rows.agg(F.sum(F.octet_length("_text")).alias("b"), F.sum((~F.col("_held")).cast("long")).alias("t")).first()
    read = stored(encoded(train, shape), "encoded")
    states = train_states(read, shape)
    counts = stored(read.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "word_counts")
    corpus = corpus_figures(counts, size["t"] or 0, shape)
    blocks = max(shape.least_blocks, -(-(size["b"] or 0) // shape.block_bytes))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("_key", "_text"), F.lit(blocks)))

    def distinct(group: pa.Table) -> pa.Table:
        found: set[bytes] = set()
        for t in group.column("_text").to_pylist():
            found.update(words_of(t))
        return pa.table({"block": pa.array([group.column("block")[0].as_py()] * len(found), pa.int64()), "word": pa.array(list(found), pa.binary())})

    wanted = blocked.groupBy("block").applyInArrow(distinct, "block bigint, word binary")
    known = wanted.join(counts, "word", "left").select("block", "word", F.coalesce("c", F.lit(0)).alias("c"))
    unit = math.log10(corpus.tokens + corpus.distinct + 1)

    def score(group: pa.Table, dictionary: pa.Table) -> pa.Table:
        words, c = dictionary.column("word").to_pylist(), dictionary.column("c").to_numpy()
        number = dict(zip(words, range(len(words)), strict=True))
        del dictionary
        classes = Classes(shape.classes)
        kind = np.fromiter((classes.__missing__(w) for w in words), np.int64, len(words))
        within, base = corpus.word_logs(c, kind), np.log10(c + 1.0) - unit
        end_base = math.log10(corpus.texts + 1) - unit
        out = []
        for batch in group.combine_chunks().to_batches():
            for piece in slices(batch, batch.schema.get_field_index("_text"), 12 << 20):
                at = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in map(words_of, piece.column("_text").to_pylist())]
                likelihood = np.zeros(len(at))
                for places, some in batches_of([np.append(kind[a], shape.classes) for a in at]):
                    likelihood[places] = some.forward(states) / math.log(10)
                out.append(pa.table({
                    "_key": piece.column("_key"), "_held": piece.column("_held"),
                    "n_tokens": pa.array([len(a) + 1 for a in at], pa.int64()),
                    "n_known": pa.array([int((c[a] > 0).sum()) + (corpus.texts > 0) for a in at], pa.int64()),
                    "base_score": pa.array([float(base[a].sum()) + end_base for a in at], pa.float64()),
                    "score": pa.array([float(within[a].sum() + s) for a, s in zip(at, likelihood, strict=True)], pa.float64()),
                }))
        return pa.concat_tables(out) if out else pa.schema([("_key", group.schema.field("_key").type), ("_held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    kind_of_key = rows.schema["_key"].dataType.simpleString()
    scored = blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, f"_key {kind_of_key}, _held boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        F.col("_key").alias(key), F.col("_held").alias("held_out"), "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
