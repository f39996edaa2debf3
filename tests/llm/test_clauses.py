"""The clause grammar against a direct version that looks at every pair of words of a clause."""

from __future__ import annotations

import math
import random

import pytest

from hydrolattice.llm import toxicity

WORDS = ["vile", "bad", "badly", "you", "not", "said", "kill", "so", "a", "the", "Vile!", "you.", "it", "never", "he", "x;", "burn"]


def direct(text, insults, reach):
    sums, top = dict.fromkeys(toxicity.SITUATIONS, 0.0), 0.0
    clauses = []
    for line in text.lower().split("\n"):
        clause = []
        for w in line.split():
            clause.append(w)
            if w[-1] in ".!?;:":
                clauses.append(clause)
                clause = []
        clauses.append(clause)
    for clause in clauses:
        words = [w.strip(".!?;:") for w in clause]
        kind = lambda w: "n" if w in toxicity.NEGATIONS else "r" if w in toxicity.REPORTS else "t" if w in toxicity.TARGETS else "k" if w in toxicity.THREATS else "i" if insults(w) else ""
        kinds, best = [kind(w) for w in words], {}
        for i, k in enumerate(kinds):
            if k not in ("i", "k"):
                continue
            weight = insults(words[i]) if k == "i" else 1.0
            top = max(top, weight) if k == "i" else top
            if any(kinds[j] == "r" and abs(i - j) <= reach for j in range(len(kinds))):
                place = "reported"
            elif any(kinds[j] == "n" and 0 < i - j <= reach for j in range(len(kinds))):
                place = "negated"
            else:
                place = ("targeted" if "t" in kinds else "plain") if k == "i" else ("threatened" if "t" in kinds else "threat")
            if k == "i" or place.startswith("threat"):
                best[place] = best.get(place, 0.0) + weight
        for place, weight in best.items():
            sums[place] += weight
    return [*(math.log1p(sums[s]) for s in toxicity.SITUATIONS), top]


def test_grammar_equals_all_pairs_of_words():
    rng = random.Random(8)
    grammar = toxicity.Grammar({"vil*": 3.0, "bad$": 2.0}, 3)
    for _ in range(400):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randrange(30)))
        assert grammar.read(text) == pytest.approx(direct(text, lambda w: 3.0 if w.startswith("vil") else 2.0 if w == "bad" else 0.0, 3)), text


def test_both_directions_of_a_clause():
    grammar = toxicity.Grammar({"vil*": 3.0}, 3)
    read = lambda t: dict(zip((*toxicity.SITUATIONS, "top"), grammar.read(t), strict=True))
    assert read("vile you are")["targeted"] > 0 and read("vile you are")["plain"] == 0
    assert read("i kill you")["threatened"] > 0 and read("kill it")["threatened"] == 0 and read("kill it")["threat"] > 0
    assert read("vile, he said")["reported"] > 0 and read("vile. he said")["plain"] > 0
    assert read("vile vile vile")["plain"] == pytest.approx(math.log1p(9)) and read("vile. vile")["plain"] == pytest.approx(math.log1p(6))


def test_long_clauses_take_linear_time():
    text = "not vile said you kill " * 200_000
    assert toxicity.Grammar({"vil*": 3.0}, 3).read(text)[-1] == 3.0
