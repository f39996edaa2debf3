"""The Merkle manifest against a direct version."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hydrolattice.llm import merkle_manifest, queries
from hydrolattice.llm.shared import ascii_lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, leaf string, `group` string, digest string, n string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(leaves):
    """The last node, and for each leaf its (left, right) siblings from the leaf up."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, a in enumerate(at):
            run, d = runs[a // 8], a % 8
            paths[k].append(("".join(run[:d]), "".join(run[d + 1 :])))
            at[k] = a // 8
        level = [sha(*r) for r in runs]
    return level[0], paths


def direct(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    subs, inner = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        sub, paths = tree([leaf_of(r) for r in mine])
        subs.append(sub)
        inner.append(list(zip(mine, paths)))
    root, tops = tree(subs)
    out = []
    for sub, members, top in zip(subs, inner, tops):
        for row, path in members:
            whole = path + top
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            fold = leaf_of(row, changed)
            for left, right in whole:
                fold = sha(left, fold, right)
            out.append((row[0], leaf_of(row), sub, root, sha(*(a + b for a, b in whole)), fold, fold == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "g", "d", "n") for r in rows], SCHEMA)


def proofs(docs):
    """What the query derives, over any table."""
    manifest = merkle_manifest.build(docs, carried={"changed": queries._tampered()})
    found = merkle_manifest.prove(manifest)
    rows = found.select("key", "leaf", "subroot", "root", merkle_manifest.proof_digest().alias("proof"), merkle_manifest.folded(F.coalesce("changed", "leaf")).alias("fold"), (merkle_manifest.folded(F.coalesce("changed", "leaf")) == F.col("root")).alias("ok"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("case", ["mixed", "one", "eight", "nine", "langs"])
def test_equals_a_direct_tree(spark, case):
    rng = random.Random(case)
    row = lambda i, lang: (i, rng.choice([None, "", "Ab é", f"T {i}"]), lang, rng.choice([None, "s"]), rng.choice([None, 3]))
    rows = {
        "mixed": [row(i, rng.choice(["en", "de", None, ""])) for i in range(150)] + [(5, "Same", "en", "s", 1)] * 90 + [(5, "Other", "en", "s", 1), (None, "A", "en", None, None), (None, "A", "en", None, None), (1, "x" * 200_000, "fr", "s", 2)],
        "one": [row(4, None)], "eight": [row(i, "en") for i in range(8)], "nine": [row(i, "en") for i in range(9)],
        "langs": [row(i, f"l{i % 11}") for i in range(40)],
    }[case]
    assert proofs(table(spark, rows).repartition(3)) == sorted(direct(rows), key=repr)


def test_empty_table(spark):
    manifest = merkle_manifest.build(table(spark, []))
    assert manifest.root is None and merkle_manifest.prove(manifest).count() == 0


def test_some_requests_and_long_runs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "RUN_ROWS", 16)
    rows = [(i, f"T {i}", "en", "s", 1) for i in range(30)] + [(7, "copy", "en", "s", 1)] * 700 + [(1, "t", "de", "s", 1)]
    manifest = merkle_manifest.build(table(spark, rows))
    assert any(level.hot is not None for level in manifest.levels)  # runs of copies share their node
    want = direct(rows)
    assert sorted(manifest.leaves.where("`group` = 'en'").select("place").toPandas()["place"]) == list(range(730))
    asked = spark.createDataFrame([("en", 0, "a"), ("en", 729, "b"), ("en", 300, "c"), ("en", 300, "d"), ("en", 730, "no"), ("de", 0, "e"), ("fr", 0, "no")], "group string, place long, tag string")
    found = {r["tag"]: r for r in merkle_manifest.prove(manifest, asked).withColumn("fold", merkle_manifest.folded(F.col("leaf"))).collect()}
    assert sorted(found) == ["a", "b", "c", "d", "e"]
    english = [w for w in want if w[1] != want[0][1]]
    assert all(r["fold"] == r["root"] == want[0][3] for r in found.values())
    assert (found["a"]["leaf"], found["b"]["leaf"], found["e"]["leaf"]) == (english[0][1], english[-1][1], want[0][1])


def test_lower_case_touches_ascii_only(spark):
    df = spark.createDataFrame([("AbÉ\u212a",)], "t string")
    assert df.select(ascii_lower(F.col("t"))).first()[0] == "abÉ\u212a"


def test_records_are_content_addressed(spark):
    rows = [(i % 4, "same", "en", "s", 1) for i in range(256)]
    manifest = merkle_manifest.build(table(spark, rows))
    for level in manifest.levels:
        for r in level.records.collect():
            assert sha(*r["children"]) == r["digest"]
        assert level.records.count() == level.records.select("digest").distinct().count()
