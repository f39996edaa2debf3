"""Stages of the pipeline on documents whose columns have the names of results and of helpers."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

NAMES = ("kept", "n_words", "score", "predicted", "_hash", "_leaked", "_k0", "_text", "_maybe", "strict_host", "component_id")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stage", ["quality", "toxicity", "near_duplicates", "decontamination"])
def test_stages_keep_columns_of_any_name(spark, stage):
    rng = random.Random(stage)
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    schema = plain + "".join(f", `{n}` string" for n in NAMES)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(80)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(40, None, None, None, None), (41, "", "en", "s1", 0), (42, rows[0][1], "en", "s1", 0)]
    work = dict(corpus_pipeline.STAGES)[stage]
    wide = spark.createDataFrame([(*r, *(f"{n} of {r[0]}" for n in NAMES)) for r in rows], schema)
    narrow = spark.createDataFrame(rows, plain)
    got = work(spark, wide, FOLDER)
    assert got.columns == wide.columns
    found = got.collect()
    assert all(r[n] == f"{n} of {r['doc_id']}" for r in found for n in NAMES)
    assert sorted(tuple(r)[:5] for r in found if r["text"]) == sorted(tuple(r) for r in work(spark, narrow, FOLDER).collect() if r["text"])
    assert work(spark, wide.limit(0), FOLDER).count() == 0
