from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolattice.operators import learn
from hydrolattice.plans import score_queries  # noqa: F401
from hydrolattice.plans.registry import QUERIES
from hydrolattice.settings import Training

FEATURES = ("ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day", "ndvi_mean")
SMALL = Training(split=date(2024, 2, 1), features=FEATURES, label_inputs=("ndwi_mean",), forest_trees=8, forest_depth=4, boost_rounds=3, boost_depth=3)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(600):
        ndwi = rng.uniform(-0.3, 0.3)
        label = 2 if ndwi < -0.1 else 1 if ndwi < 0.1 else 0
        data.append((f"C{i % 60}", date(2024, 1, 1) + timedelta(days=int(i / 10)), float(ndwi), float(rng.uniform(20, 40)), float(rng.uniform(10, 50)), float(rng.uniform(0, 20)), 0.4, label))
    return spark.createDataFrame(data, "cell_id string, date date, ndwi_mean double, temp_max_c double, et0_8day_sum double, rainfall_8day double, ndvi_mean double, target_stress_class int")


@pytest.fixture(scope="module")
def forest(rows):
    return learn.train(rows, "forest", FEATURES, "target_stress_class", SMALL)


def test_scores_follow_the_learned_input(spark, forest, rows):
    asked = spark.createDataFrame([("dry", -0.25), ("wet", 0.25)], "k string, ndwi_mean double")
    told = {r["k"]: r for r in learn.what_if(forest, asked, FEATURES, "HI").collect()}
    assert told["dry"]["stress_code"] == 2 and told["wet"]["stress_code"] == 0
    assert told["dry"]["advisory"]["priority"] == 1 and told["dry"]["advisory"]["language"] == "hi"
    assert sum(told["dry"]["probabilities"]) == pytest.approx(1.0, abs=1e-9)
    scored = learn.score(forest, rows, FEATURES)
    assert scored.filter(F.col("stress_code") == F.col("target_stress_class")).count() > 570
    assert scored.filter(~F.col("confidence").between(0.33, 1.0)).count() == 0


def test_advice_defaults_fill_missing_inputs(spark, forest):
    asked = spark.createDataFrame([(1, -0.25), (2, None)], "k int, ndwi_mean double")
    told = {r["k"]: r["advisory"] for r in learn.what_if(forest, asked, FEATURES).collect()}
    assert "32.0" in told[1]["recommendation"] and told[1]["priority"] == 1  # et0 default reaches the limit


def test_form_defaults_and_ranges(spark, forest):
    asked = spark.createDataFrame([(1, -0.25, None), (2, -2.0, 30.0), (3, 0.25, 60.0)], "k int, ndwi_mean double, temp_max_c double")
    accepted, rejected = learn.request_form(asked)
    row = accepted.first()
    assert accepted.count() == 1 and (row["temp_max_c"], row["et0_8day_sum"], row["ndvi_mean"]) == (34.0, 38.0, 0.28)
    assert {r["k"] for r in rejected.collect()} == {2, 3}
    told = learn.what_if(forest, accepted, FEATURES).first()
    assert set(told["class_probabilities"]) == {"LOW", "MODERATE", "HIGH"}
    assert sum(told["class_probabilities"].values()) == pytest.approx(1.0, abs=2e-4)
    assert told["confidence"] == max(told["class_probabilities"].values())


def test_boosted_probabilities(rows):
    model = learn.train(rows, "boosted_light", FEATURES, "target_stress_class", SMALL)
    out = learn.score(model, rows, FEATURES, keep_probabilities=True)
    r = out.select(F.min(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)), F.max(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)), F.avg((F.col("stress_code") == F.col("target_stress_class")).cast("int"))).first()
    assert r[0] == pytest.approx(1.0) and r[1] == pytest.approx(1.0) and r[2] > 0.9
    with pytest.raises(ValueError, match="unknown model"):
        learn.estimator("other")


def test_importances_add_up(spark, forest):
    ranked = learn.importances(forest, FEATURES, spark)
    top = ranked.collect()
    assert top[0]["feature"] == "ndwi_mean" and sum(r["share"] for r in top) == pytest.approx(1.0)
    asked = spark.createDataFrame([(1, -0.25)], "k int, ndwi_mean double")
    drivers = learn.importance_drivers(ranked, asked, ["k"], FEATURES, 2).collect()
    assert len(drivers) == 2 and sum(r["impact_pct"] for r in drivers) == pytest.approx(100, abs=0.2)


def test_drivers(rows, forest):
    means = learn.feature_means(rows, FEATURES)
    found = learn.impacts(forest, rows.limit(50).withColumn("id", F.monotonically_increasing_id()), ["id"], FEATURES, means)
    assert found.count() == 50 * len(FEATURES)
    # Rows of the middle class already sit near the mean, so setting an input to it changes little there.
    top = learn.top_drivers(found, ["id"]).filter("rank = 1 AND class != 1")
    assert top.count() > 20 and top.filter(F.col("feature") == "ndwi_mean").count() == top.count()
    every = learn.top_drivers(found, ["id"], 4)
    assert every.groupBy("id").count().filter("count != 4").count() == 0
    assert every.filter(~F.col("direction").isin("increases_stress", "mitigates_stress")).count() == 0


def test_global_attribution(rows, forest):
    unique = rows.withColumn("id", F.monotonically_increasing_id())
    out = learn.global_attribution(forest, unique, ["id"], FEATURES, learn.feature_means(rows, FEATURES), rows=100, top=3).collect()
    assert len(out) == 3 and out[0]["feature"] == "ndwi_mean"


@pytest.mark.parametrize("classes", [1000, 1001])
def test_class_weights_do_not_depend_on_the_number_of_classes(spark, classes):
    df = spark.range(classes * 2).select((F.col("id") % classes).cast("double").alias("label")).unionByName(spark.createDataFrame([(None,)], "label double"))
    out = learn.with_weights(df, "label")
    assert out.count() == classes * 2 and out.filter("class_weight <> 1.0").count() == 0


def test_no_row_moves_to_meet_the_weight_of_its_class(spark):
    """A table whose size Spark cannot tell is small must not be dealt out by label, one task per class."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = learn.with_weights(spark.range(100).select((F.col("id") % 3).cast("double").alias("label")), "label")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan


def test_training_rows_are_dealt_out_once_and_given_back(spark, rows):
    with learn.training_rows(rows, FEATURES, "target_stress_class") as kept:
        assert {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()} == {
            float(r["target_stress_class"]): r["n"] for r in rows.groupBy("target_stress_class").agg(F.count("*").alias("n")).collect()
        }
        assert "InMemoryTableScan" in kept._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in kept.select("*")._jdf.queryExecution().executedPlan().toString()


def test_global_attribution_takes_all_rows(spark, forest, rows):
    unique = rows.withColumn("id", F.monotonically_increasing_id())
    means = learn.feature_means(rows, FEATURES)
    every = learn.impacts(forest, unique, ["id"], FEATURES, means, 2).groupBy("feature").agg(F.round(F.avg(F.abs("impact")), 6).alias("v"))
    got = {r["feature"]: r["mean_abs_impact"] for r in learn.global_attribution(forest, unique, ["id"], FEATURES, means).collect()}
    assert got == pytest.approx({r["feature"]: r["v"] for r in every.collect()}, abs=2e-6) and rows.count() > 500


def test_three_way(rows):
    out = learn.three_way_test(rows, SMALL, ("forest",)).collect()
    assert {r["test"] for r in out} == {"unseen_cells", "later_dates", "later_dates_without_label_inputs"}
    by = {r["test"]: r for r in out}
    assert by["unseen_cells"]["macro_f1"] > 0.9 and by["later_dates"]["macro_auc"] > 0.95
    assert by["later_dates_without_label_inputs"]["macro_f1"] < by["later_dates"]["macro_f1"]


@pytest.mark.parametrize(("name", "dealt"), [("global_attribution", 0), ("attribution_topk", 1)])  # the drivers' key holds a column that becomes a double
def test_unique_rows_and_their_means_share_one_shuffle(spark, name, dealt):
    out = QUERIES[name].run(spark, "/root/testdata/sf0.001")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "l_partkey" in line and "ReusedExchange" not in line]
    assert "isFinalPlan=true" in plan and "ReusedExchange" in plan
    assert len([line for line in moved if "REPARTITION" in line]) == dealt and len(moved) == 1 + dealt
    assert "struct(date" not in plan  # columns of the order move once


def test_means_of_a_plan_are_those_of_the_driver(spark, forest, rows):
    unique = rows.withColumn("id", F.monotonically_increasing_id())
    means = learn.feature_means(unique, FEATURES)
    assert list(learn.means_row(unique, FEATURES).first()) == pytest.approx(means)
    assert list(learn.means_row(unique.limit(0), FEATURES).first()) == [0.0] * len(FEATURES)
    both = [{r["feature"]: r["mean_abs_impact"] for r in learn.global_attribution(forest, unique, ["id"], FEATURES, m).collect()} for m in (means, learn.means_row(unique, FEATURES))]
    assert both[0] == pytest.approx(both[1], abs=2e-6)
