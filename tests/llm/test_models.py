"""Language model, toxicity and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from hydrolattice.llm import decontamination, lm_scoring, quality_rules, toxicity
from hydrolattice.llm.queries import QUERIES

from .common import documents, groups, words

FOLDER = "/root/testdata/sf0.001"
SMALL = lm_scoring.Shape(states=3, classes=32, rounds=2, least_blocks=4)


def fold(key, n):
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


def direct_log(symbols, states):
    now, total = states.start * states.emit[symbols[0]], 0.0
    for s in symbols[1:]:
        total += math.log(now.sum())
        now = (now / now.sum()) @ states.step * states.emit[s]
    return total + math.log(now.sum())


def test_forward_is_exact_and_counts_add_up():
    rng = np.random.default_rng(0)
    states = lm_scoring.first_guess(SMALL)
    sequences = [rng.integers(0, 33, n) for n in (1, 1, 2, 7, 300, 40)]
    for places, batch in lm_scoring.batches_of(sequences, tokens=50):
        assert batch.forward(states) == pytest.approx([direct_log(sequences[i], states) for i in places], abs=1e-9)
    for places, batch in lm_scoring.batches_of(sequences):
        starts, steps, emit = batch.expected(states)
        assert starts.sum() == pytest.approx(len(sequences)) and steps.sum() == pytest.approx(sum(len(s) - 1 for s in sequences))
        assert emit.sum(1) == pytest.approx(np.bincount(np.concatenate(sequences), minlength=33))


def direct_counts(symbols, states):
    """Forward and backward over one sequence, one symbol after another."""
    ahead, behind = [states.start * states.emit[symbols[0]]], [np.ones(len(states.start))]
    for s in symbols[1:]:
        ahead.append(ahead[-1] @ states.step * states.emit[s])
    for s in symbols[:0:-1]:
        behind.insert(0, states.step @ (states.emit[s] * behind[0]))
    whole = ahead[-1].sum()
    steps = sum((np.outer(a, states.emit[s] * b) * states.step for a, s, b in zip(ahead, symbols[1:], behind[1:])), np.zeros_like(states.step))
    classes = np.zeros_like(states.emit)
    for s, a, b in zip(symbols, ahead, behind, strict=True):
        classes[s] += a * b / whole
    return ahead[0] * behind[0] / whole, steps / whole, classes


@pytest.mark.parametrize(("kind", "near"), [(np.float64, 1e-9), (np.float32, 1e-4)])
def test_counts_are_those_of_each_text_alone(kind, near):
    rng = np.random.default_rng(2)
    states = lm_scoring.first_guess(SMALL)
    sequences = [rng.integers(0, 33, n) for n in (1, 5, 5, 1, 40, 12, 39, 2)]
    want = [sum(c) for c in zip(*(direct_counts(s, states) for s in sequences))]
    for got, right in zip(lm_scoring.Batch(sequences, kind).expected(states), want, strict=True):
        assert got == pytest.approx(right, rel=near, abs=near)


def test_rounds_put_the_texts_of_a_task_into_few_steps(spark, monkeypatch):
    """Each step of a batch costs the same few calls, so texts of a task must share their steps however many bytes they have."""
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 32, n).astype(np.int16) for n in [20_000] * 60 + [50] * 400]
    whole = lm_scoring.Batch.expected
    calls = []

    def watched(self, states):
        calls.append((len(self.alive), len(self.symbols)))
        return whole(self, states)

    monkeypatch.setattr(lm_scoring.Batch, "expected", watched)

    class Rows:
        """Stands for the rows of one task, run here."""

        def where(self, _):
            return self

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = lm_scoring.pa.RecordBatch.from_arrays([lm_scoring.pa.array([s.tobytes() for s in sequences], lm_scoring.pa.binary())], names=["symbols"])
            out = lm_scoring.pa.Table.from_batches(list(run(iter([batch]))))
            return spark.createDataFrame(out.to_pandas())

    lm_scoring.train_states(Rows(), lm_scoring.Shape(states=3, classes=32, rounds=0))
    assert sum(n for _, n in calls) == sum(map(len, sequences))
    assert sum(n for n, _ in calls) <= 2 * 20_000


def test_training_raises_the_likelihood(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(("aa ab ac ad" if i % 2 else "xx xy xz xw").split()) for _ in range(30)) for i in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "_text string")
    classes = lm_scoring.Classes(32)
    sequences = [lm_scoring.symbols_of(lm_scoring.words_of(t), classes, 32) for t in texts]

    def likelihood(states):
        return sum(b.forward(states).sum() for _, b in lm_scoring.batches_of(sequences))

    none, some = (lm_scoring.train_states(lm_scoring.encoded(frame, shape), shape) for shape in (lm_scoring.Shape(states=3, classes=32, rounds=n) for n in (0, 8)))
    assert likelihood(lm_scoring.first_guess(SMALL)) < likelihood(none) < likelihood(some)


def test_every_round_reads_every_text(spark):
    rng = random.Random(1)
    shape = lm_scoring.Shape(states=3, classes=32, rounds=3)
    texts = [" ".join(rng.choice(f"a{i % 5} b{i % 7} c{i} d".split()) for _ in range(1 + i % 9)) for i in range(80)]
    classes = lm_scoring.Classes(32)
    sequences = [lm_scoring.symbols_of(lm_scoring.words_of(t), classes, 32) for t in texts]
    want = lm_scoring.first_guess(shape)
    for _ in range(4):
        want = lm_scoring.next_states(np.concatenate([c.ravel() for c in lm_scoring.Batch(sequences).expected(want)]), shape)
    read = lm_scoring.encoded(spark.createDataFrame([(t,) for t in texts], "_text string"), shape)
    got = lm_scoring.train_states(read, shape)
    counts = {r["word"].decode() if isinstance(r["word"], bytes) else bytes(r["word"]).decode(): r["n"] for r in read.where("word is not null").groupBy("word").agg({"c": "sum"}).withColumnRenamed("sum(c)", "n").collect()}
    assert counts == Counter(w for t in texts for w in t.split())
    for a, b in ((got.start, want.start), (got.step, want.step), (got.emit, want.emit)):
        assert a == pytest.approx(b, rel=2e-3, abs=1e-5)


def test_word_model_sums_to_one():
    """Seen words with as many unseen ones as are expected make one; fewer unseen words stay below the mass left for them."""
    corpus = lm_scoring.Corpus(10, 6, 1, 0.5, np.array([8.0, 1.0, 0.0]), np.array([3.0, 1.0, 0.0]), 21.0)
    others = [21 * 4 / 7, 21 * 2 / 7, 21 * 1 / 7]
    seen = 10 ** corpus.word_logs(np.array([5, 2, 1, 1]), np.array([0, 0, 0, 1]))
    unseen = 10 ** corpus.word_logs(np.zeros(3), np.arange(3))
    assert unseen * others == pytest.approx([0.5 * 3 / 8, 0.5 / 1, 1.0])
    assert [seen[:3].sum() + unseen[0] * others[0], seen[3] + unseen[1] * others[1]] == pytest.approx([1.0, 1.0])
    assert 2 * unseen[0] < 0.5 * 3 / 8  # two unseen words of a class share its mass


def test_unseen_words_are_estimated_from_rare_ones(spark):
    rows = [(f"w{i}".encode(), 1 if i < 60 else 2 if i < 80 else 9) for i in range(100)]
    corpus = lm_scoring.corpus_figures(spark.createDataFrame(rows, "word binary, c long"), 5, lm_scoring.Shape(classes=32))
    assert corpus.unseen == 60 * 59 / (2 * 21) and corpus.discount == 60 / 100 and corpus.distinct == 101
    assert lm_scoring.corpus_figures(spark.createDataFrame([], "word binary, c long"), 0, lm_scoring.Shape(classes=32)).unseen == 0


def check_scores(rows, found):
    train = [t for i, t in rows if fold(i, 7) != 2]
    counts = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    unit = math.log10(n + v + 1)
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    want = Counter()
    for i, t in rows:
        w = [*words(t), None]
        want[(i, fold(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10(counts[x] + 1) - unit for x in w), 6))] += 1
    assert got == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in found)


def test_language_model_rows(spark):
    rows = [(i, f"the {'cat' if i % 2 else 'dog'} sat on n{i}") for i in range(40)] + [(50, None), (51, ""), (None, "the cat"), (52, "x " * 30_000), (52, "x " * 30_000)]
    check_scores(rows, lm_scoring.score_texts(documents(spark, rows), shape=SMALL).collect())
    assert lm_scoring.score_texts(documents(spark, []), shape=SMALL).count() == 0


def test_language_model_query_beats_its_base(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = QUERIES["op1_lm_scoring"].run(spark, FOLDER).collect()
    check_scores(rows, found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def toxic_rows(n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(3000)}" for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["nastyone", "nastytwo!", "Vile,", "VILE"])
        elif i % 6 == 1:
            at = rng.randrange(50)
            w[at : at + 3] = ["said", "not", "vile"]  # reported and negated
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_stems_and_clauses(spark):
    rows, labels = toxic_rows()
    docs = documents(spark, [*rows, (9000, None), (9001, ""), (None, "nastyone nastytwo vile"), (0, rows[0][1])])
    tags = spark.createDataFrame([*labels, (0, 0), (None, 1), (77_777, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, tags, usable=~toxicity.held_out())
    assert any("nastyone".startswith(e[:-1]) for e in model.entries)
    scored = toxicity.score(docs, ["doc_id"], model).collect()
    assert len(scored) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in scored if r["doc_id"] in truth and fold(r["doc_id"], 5) == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [r["predicted"] for r in scored if r["doc_id"] is None] == [1] and [r["predicted"] for r in scored if r["doc_id"] in (9000, 9001)] == [0, 0]
    assert toxicity.score(documents(spark, []), ["doc_id"], model).count() == 0


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, "b")])
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, ["doc_id"], model).collect()} == {0.5}


def test_clauses():
    grammar = toxicity.Grammar({"vil*": 3.0, "bad$": 2.0}, 3)
    read = lambda t: dict(zip((*toxicity.SITUATIONS, "top"), grammar.read(t), strict=True))
    assert read("a vile thing")["plain"] == pytest.approx(math.log1p(3)) and read("badly")["plain"] == 0 and read("bad.")["plain"] > 0
    assert read("you are vile")["targeted"] > 0 and read("you. vile")["targeted"] == 0
    assert read("not so vile")["negated"] > 0 and read("not. vile")["plain"] > 0 and read("not a b c d vile")["plain"] > 0
    assert read("he said vile")["reported"] > 0 and read("kill it")["threat"] > 0 and read("never kill")["threat"] == 0


def test_pipeline_equals_a_direct_version(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "pieces"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    rows = [r for r in rows if judged[r[0]]]
    from pyspark.sql import functions as F

    left = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    model = toxicity.learn(left, spark.read.parquet(f"{FOLDER}/labels.parquet"), usable=~toxicity.held_out())
    grammar = toxicity.Grammar(model.entries, model.reach)
    rows = [(i, t) for i, t in rows if model.scores(np.array([grammar.read(t)]))[0] < 0.5]
    root = groups(rows, 80)
    rows = [(i, t) for i, t in rows if root[i] == i]
    finder = decontamination.Benchmark([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()], decontamination.Matching())
    rows = [r for r, found in zip(rows, finder.matches([t for _, t in rows]), strict=True) if not found]
    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {i: len(coder.encode(t)) for i, t in rows}


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, " ".join(f"w{i}" for i in range(80)), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, FOLDER)
            assert out.columns == docs.columns and out.count() <= 3
