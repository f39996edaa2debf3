"""Source divergence and licence scans against direct versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from hydrolattice.llm import license_scan, source_audit
from hydrolattice.llm.license_scan import Joining, Phrase, Template

AUDIT = "text string, lang string, source string, term string, `count` string, `value` string, item string"
SCAN = "doc_id long, text string, labels string, score string, `present` string, _digest string, start string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def audited(rows, least, top):
    rows = [(lower(t), lang or "", source or "") for t, lang, source in rows]
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), lang, source) for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        spread, counts = Counter(), defaultdict(Counter)
        for terms, of, source in found:
            if of == lang:
                spread.update(set(terms))
                counts[source].update(terms)
        kept = [t for t, n in spread.items() if n >= least]
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        p = {s: {t: share(c[t], total[s]) for t in kept} for s, c in counts.items()}
        q = {t: share(sum(c[t] for c in counts.values()), sum(total.values())) for t in kept}
        for s in counts:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s],
                "term": [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]],
            }
            for part, values in parts.items():
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(values, 1) if part == "pair" or k <= top}
    return out


def audit_rows(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], AUDIT).repartition(3)
    out = source_audit.audit(docs, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("held", [200_000, 5])
def test_audit_equals_all_terms_and_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(source_audit, "HELD_TERMS", held)
    monkeypatch.setattr(source_audit, "HELD_CELLS", held)
    monkeypatch.setattr(source_audit, "TEXT_PIECE", 7 if held == 5 else 1 << 20)
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma", "délta", "x-ray", "ÉK", "one1two", "rare", "the", "THE"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 11), k=rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "é", "", None, "Z"])) for _ in range(160)]
    rows += [(None, "en", "empty"), ("", "xx", "p"), ("7 8", "xx", "q"), ("y " * 30_000, "en", "a"), ("alone here", "zz", "s")] + [("beta beta the", "en", "copies")] * 60
    assert audit_rows(spark, rows, min_docs=4, top=3) == audited(rows, 4, 3)


def test_audit_of_an_empty_table(spark):
    assert audit_rows(spark, []) == set()


def test_a_path_is_corrected_once_per_ancestor():
    tree = source_audit.PatternTree()
    rows = [([(0, 1, 9, 2), (1, 1, 8, 3), (4, 2, 7, 1)], 3), ([(0, 1, 9, 2), (1, 1, 8, 3), (5, 2, 6, 1)], 2), ([(1, 2, 5, 3), (5, 9, 9, 1)], 4)]
    closed = []
    leave = tree.leave
    tree.leave = lambda depth: (closed.append(len(tree.path) - depth), leave(depth))
    for row, times in rows:
        tree.insert(row, times)
    tree.leave(0)
    assert sum(closed) == 6  # nodes, the shared path once
    want = Counter()
    for row, times in rows:
        for j, (b, _, pb, qb) in enumerate(row):
            for a, _, pa, qa in row[:j]:
                want[a, b] += times * (abs(pa - pb) - abs(pa - qb) - abs(qa - pb) + abs(qa - qb))
    assert {(a, b): v for a, b, v in tree.take()} == {k: v for k, v in want.items() if v}


def test_terms_are_cut_between_words():
    data = "ab cdé ".encode() * 50
    for size in (1, 2, 5, 1000):
        pieces = list(source_audit.pieces_of(data, size))
        assert b"".join(pieces) == data and [t for p in pieces for t in source_audit.TERM.findall(p)] == source_audit.TERM.findall(data)


def scanned(rows, templates, phrases, joining):
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(k, p.label) for p in phrases for k in range(len(w)) if w[k : k + p.text.count(" ") + 1] == p.text.split()]
        hits = []
        for t in templates:
            own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t.text)))
            for s in range(0, max(len(w) - joining.block_words + joining.step, 1), joining.step):
                both = len(own & set(w[s : s + joining.block_words]))
                if own and both >= joining.threshold * len(own):
                    hits.append((both / len(own), t.label))
        base = {p[1] for p in places}
        starts = [p[0] for p in places]
        out.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[1] for h in hits})), 1.0 if places else max((h[0] for h in hits), default=0.0)))
    return sorted(out, key=repr)


def scan_rows(spark, rows, templates, phrases, joining):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCAN).repartition(3)
    return license_scan.scan(docs, ["doc_id"], templates=templates, phrases=phrases, joining=joining)


@pytest.mark.parametrize("threshold", [Fraction(1, 2), Fraction(4, 5), Fraction(1)])
def test_scan_equals_all_blocks_and_templates(spark, threshold):
    rng = random.Random(str(threshold))
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "é", "the", "MIT"]
    templates = [Template(f"t{k % 5}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for k in range(9)] + [Template("none", "--")]
    phrases = [Phrase("w1 w2", "p"), Phrase("the mit", "t1"), Phrase("w3", "q"), Phrase("w4 w4", "r")]
    joining = Joining(threshold=threshold, block_words=16, step=8)
    rows = [(k, " ".join(rng.choices(vocabulary + [f"z{j}" for j in range(60)], k=rng.randint(0, 70)))) for k in range(120)]
    rows += [(None, "W1 w2, w1-w2"), (5, "w1 w2"), (5, "w1 w2"), (6, None), (7, ""), (8, " .. "), (9, "w4 w4 w4 w4 w3"), (10, "the mit İ wK"), (11, "w3 the mit " * 3000)]
    rows += [(12, "w1 w2 w9")] * 50
    found = scan_rows(spark, rows, templates, phrases, joining)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == scanned(rows, templates, phrases, joining)


def test_scan_without_templates_or_rows(spark):
    assert scan_rows(spark, [], license_scan.TEMPLATES, license_scan.PHRASES, Joining()).count() == 0
    assert [tuple(r)[1:] for r in scan_rows(spark, [(1, "under the MIT license")], [], [], Joining()).collect()] == [(4, 0, None, None, "", "", 0.0)]
    with pytest.raises(ValueError, match="does not fit"):
        scan_rows(spark, [(1, "a")], [Template("x", "a-b " * 40)], [], Joining())


def test_notices_are_found_and_plain_prose_is_not(spark):
    mit = license_scan.TEMPLATES[8].text
    rows = [(1, f"Intro words. {mit} and more"), (2, mit.replace("charge", "cost").replace("person", "body")), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "the public may use this software in general, under any version")]
    got = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in scan_rows(spark, rows, license_scan.TEMPLATES, license_scan.PHRASES, Joining()).collect()}
    assert got == {1: ("", "mit"), 2: ("", "mit"), 3: ("", "gpl-3"), 4: ("", "")}


def test_no_python_in_the_plan(spark, capsys):
    found = scan_rows(spark, [(1, "under the mit license")], license_scan.TEMPLATES, license_scan.PHRASES, Joining())
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "Arrow" not in plan and "Python" not in plan
    assert np.isclose(found.first()["score"], 1.0)
