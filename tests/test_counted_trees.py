from __future__ import annotations

from collections import Counter
from dataclasses import replace
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolattice.operators import counted_trees, learn
from hydrolattice.operators.sampling import group_holdout, held_out
from hydrolattice.plans import score_queries
from hydrolattice.plans.registry import QUERIES
from hydrolattice.settings import Training

INPUTS = ("a", "b", "c")
SETTINGS = Training(features=INPUTS, target="label", label_inputs=("a",), forest_trees=1, forest_depth=5, boost_rounds=6, boost_depth=3, boost_subsample=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(3000):
        a, b, c = int(rng.integers(20)), int(rng.integers(15)), int(rng.integers(8))
        sure = 0 if a < 7 else 1 if b + c < 9 else 2
        data.append((i, f"G{i % 80}", date(2024, 1 + i % 3, 1), a * 1.5, float(b), c / 8, sure if rng.random() < 0.8 else int(rng.integers(3)), i % 4 == 0))
    return spark.createDataFrame(data, "id long, cell_id string, date date, a double, b double, c double, label int, flag boolean").persist()


def counts_of(df, columns):
    return Counter({tuple(round(float(v), 6) for v in r[:-1]): r[-1] for r in df.groupBy(*[F.round(c, 6).alias(c) for c in columns]).agg(F.sum("n").alias("n")).collect()})


@pytest.mark.parametrize("name", ["forest", "boosted_deep", "boosted_light"])
def test_counted_fits_are_those_of_spark(spark, rows, name):
    limits = counted_trees.bin_limits(rows, INPUTS, {"x": ~F.col("flag")}, 32)["x"]
    assert [len(v) for v in limits.values()] == [19, 14, 7] and limits["a"][0] == 0.75
    counted = counted_trees.counted_rows(rows, "label", "flag", limits).withColumn("test", F.lit(0))
    state = counted_trees.blocks(counted, 3, counted.count()).persist()
    counted_trees.checkpoint_folder(spark)
    n = [r["n"] for r in rows.filter("not flag").groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()]
    made = [{"weights": sum(n) / (3 * np.array(n)), "allowed": (0, 1, 2)}]
    common = {"classes": 3, "width": 32, "inputs": 3, "seed": 42}
    if name == "forest":
        forest = 0, counted_trees.forests(state, made, 0, 1, SETTINGS.forest_depth, **common, bootstrap=False)
        got = counted_trees.class_probabilities(state, spark, forest, [], 3)
    else:
        fitted = counted_trees.boosted(state, made, {0: learn.boosted_depth(name, SETTINGS)}, SETTINGS.boost_rounds, SETTINGS.boost_step, 1.0, **common)
        got = counted_trees.class_probabilities(fitted, spark, None, [0], 3)
    with learn.training_rows(rows.filter("not flag"), INPUTS, "label") as kept:
        estimator = learn.estimator(name, SETTINGS)
        model = (estimator.setBootstrap(False) if name == "forest" else estimator).fit(kept)
    told = learn.with_probabilities(model, learn.with_vector(rows.filter("flag"), INPUTS)).select(
        F.col("label").alias("actual"), learn.best_class().alias("stress_code"), *[F.get("probabilities", F.lit(i)).alias(f"p{i}") for i in range(3)], F.lit(1).alias("n")
    )
    columns = ["actual", "stress_code", "p0", "p1", "p2"]
    assert counts_of(got, columns) == counts_of(told, columns) and sum(counts_of(got, columns).values()) == 750
    state.unpersist()


def test_draws_of_equal_rows_are_many_draws():
    block = {"bins": np.zeros((1, 1), np.uint8), "train": np.array([1_000_000])}
    drawn = np.random.default_rng([42, 0, 0]).poisson(block["train"])[0]
    assert 995_000 < drawn < 1_005_000  # a draw of the counted row as a whole would be a multiple of 1,000,000


def test_sums_do_not_depend_on_how_histograms_meet(spark, rows, monkeypatch):
    models = ("forest", "boosted_light")
    once = learn.three_way_test(rows, replace(SETTINGS, forest_trees=4, boost_subsample=0.8), models).collect()
    monkeypatch.setattr(counted_trees, "BYTES_ON_DRIVER", 0)
    monkeypatch.setattr(counted_trees, "BYTES_PER_JOB", 20_000)
    monkeypatch.setattr(counted_trees, "CHECKPOINT_ROUNDS", 2)
    assert learn.three_way_test(rows.repartition(5), replace(SETTINGS, forest_trees=4, boost_subsample=0.8), models).collect() == once
    assert len(once) == 6


def test_scores_are_those_of_separate_fits(rows):
    got = {(r["model"], r["test"]): r for r in learn.three_way_test(rows, SETTINGS).collect()}
    assert [k[0] for k in got] == [m for m in learn.MODELS for _ in range(3)]
    past, later = rows.filter("date < '2024-02-01'"), rows.filter("date >= '2024-02-01'")
    for test, features in (("later_dates", INPUTS), ("later_dates_without_label_inputs", INPUTS[1:])):
        for name, apart in (("forest", 0.1), ("boosted_light", 2e-4)):  # draws of a forest differ
            told = learn.evaluate(learn.train(past, name, features, "label", SETTINGS), later, features, "label").first()
            assert [got[name, test][c] for c in ("accuracy", "macro_f1", "weighted_f1", "macro_auc")] == pytest.approx(list(told), abs=apart)


def test_all_fits_share_their_jobs(spark, rows):
    """Three models in three tests take the jobs of the deepest one, not of all 21 series of trees."""
    spark.sparkContext.setJobGroup("fits", "fits")
    try:
        learn.three_way_test(rows, SETTINGS)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fits")) < 120


def test_the_query_fits_all_models_at_the_published_sizes(spark, monkeypatch):
    seen = {}

    def look(df, settings, models=learn.MODELS, **names):
        seen.update(settings=settings, models=tuple(models), rows=df.count())
        return df.limit(0)

    monkeypatch.setattr(learn, "three_way_test", look)
    QUERIES["three_way_test"].run(spark, "/root/testdata/sf0.001")
    published = Training()
    assert seen["models"] == ("forest", "boosted_deep", "boosted_light")
    assert seen["rows"] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for part in ("forest_trees", "forest_depth", "boost_rounds", "boost_depth", "boost_step", "boost_subsample", "max_bins", "test_share"):
        assert getattr(seen["settings"], part) == getattr(published, part)
    assert seen["settings"].features == score_queries.MODEL_COLUMNS


def test_flags_without_a_join_are_those_of_the_holdout(spark):
    df = spark.createDataFrame([(i, None if i % 50 == 0 else f"G{i % 37}") for i in range(500)], "id long, g string")
    flagged = df.withColumn("is_test", held_out(df, "g")).filter("is_test is not null")
    assert sorted(flagged.select("id", "is_test").collect()) == sorted(group_holdout(df, "g").select("id", "is_test").collect())
    assert df.withColumn("t", held_out(df, "g", 0.0)).filter("t").count() == 0
    assert df.withColumn("t", held_out(df, "g", 1.0)).filter("t").count() == 490


def test_bin_limits_are_exact_quantiles_of_the_subset(spark):
    df = spark.range(10_000).select((F.col("id") * 7 % 10_000).cast("double").alias("a"), F.pmod("id", F.lit(5)).cast("double").alias("b"), (F.col("id") < 9_990).cast("double").alias("rare"))
    found = counted_trees.bin_limits(df, ("a", "b", "rare"), {"all": F.lit(True), "low": F.col("a") < 5000}, 4)
    assert [round(v, 3) for v in found["all"]["a"]] == [2499, 4999, 7499] and [round(v, 3) for v in found["low"]["a"]] == [1249, 2499, 3749]
    assert len(found["all"]["b"]) == 3 and found["all"]["rare"] == [0.5]


def test_odd_rows(spark, rows):
    odd = rows.withColumn("a", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("a"))).withColumn("label", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("label")))
    odd = odd.withColumn("date", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("date"))).withColumn("b", F.lit(3.0)).drop("c")  # one value, absent
    assert len(learn.three_way_test(odd, SETTINGS).collect()) == 9
    with pytest.raises(ValueError, match="no rows to train on"):
        learn.three_way_test(rows.filter("date >= '2024-02-01'"), SETTINGS)
    late = learn.three_way_test(rows.filter("date < '2024-02-01'"), SETTINGS, ("forest",)).collect()
    assert [(r["accuracy"], r["macro_auc"]) for r in late if r["test"] == "later_dates"] == [(0.0, None)]
    wide = counted_trees.bin_limits(spark.createDataFrame([(float(v),) for v in (1, float("inf"), -float("inf"), 2)], "a double"), ("a",), {"x": F.lit(True)}, 32)["x"]["a"]
    assert wide == sorted(set(wide)) and len(wide) == 3
