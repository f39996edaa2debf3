from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolattice.functions.advice import advisory, advisory_in, localised
from hydrolattice.operators import kpi, maps, scores
from hydrolattice.operators.ordering import exact_quantiles, ranked, smallest_draws
from hydrolattice.operators.sampling import fixed_sample, group_holdout
from hydrolattice.settings import Gate


def test_gate(spark):
    rows = [(1, 0.8, None), (2, 0.8, 0.8), (3, 0.79, 0.8), (4, 0.4, None), (5, 0.4, 0.3)]
    df = spark.createDataFrame(rows, "k int, candidate double, champion double")
    out = {r["k"]: (r["promoted"], r["reason"]) for r in scores.gate_verdict(df, "candidate", "champion", Gate(0.5, 0.0)).collect()}
    assert [out[k][0] for k in range(1, 6)] == [True, True, False, False, False]
    assert "minimum" in out[4][1]
    strict = scores.gate_verdict(df.filter("k = 2"), "candidate", "champion", Gate(0.5, 0.01)).first()
    assert strict["promoted"] is False


def test_gate_history(spark):
    champion, verdicts = None, []
    for score in (0.90, 0.86, 0.95, 0.84):
        row = scores.gate_verdict(spark.createDataFrame([(score, champion)], "c double, h double"), "c", "h").first()
        champion = score if row["promoted"] else champion
        verdicts.append(row["promoted"])
    assert verdicts == [True, False, True, False]


@pytest.mark.parametrize(("values", "best"), [((0.7, 0.9, 0.8), "deep"), ((0.9, 0.9, 0.9), "forest")])
def test_best_model(spark, values, best):
    df = spark.createDataFrame([(n, i, v) for i, (n, v) in enumerate(zip(("forest", "deep", "light"), values))], "model string, priority int, score double")
    assert scores.best_model(df, "model", "score", "priority").first()["best_model"] == best


def test_macro_f1_has_two_definitions(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "a int, p int")
    whole = scores.class_scores(df, "a", "p").first()
    assert whole["macro_f1"] == round(0.8 / 3, 4)  # all three labels
    part = scores.group_scores(df, [], "a", "p").first()
    assert (part["macro_f1"], part["high_stress_recall"], part["classes_present"]) == (0.4, None, 2)


@pytest.mark.parametrize("bucket", [1_000_000, 40])
def test_auc_with_ties(spark, bucket):
    rng = np.random.default_rng(4)
    s, y = np.round(rng.random(600), 2), rng.integers(0, 2, 600)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert scores.roc_auc(df, "y", {1: "s"}, digits=9, rows_per_bucket=bucket).first()["auc"] == pytest.approx(want, abs=1e-8)


def test_latency_summary(spark):
    rng = np.random.default_rng(8)
    ms = {"map": rng.gamma(2, 30, 301), "cell": rng.gamma(2, 10, 100)}
    df = spark.createDataFrame([(k, float(v), i == 0) for k, vs in ms.items() for i, v in enumerate(vs)], "label string, ms double, bad boolean")
    out = {r["request"]: r for r in scores.latency_summary(df, "label", "ms", F.col("bad"), 10.0).collect()}
    for name, vs in (*ms.items(), ("overall", np.concatenate(list(ms.values())))):
        r = out[name]
        assert (r["requests"], r["errors"]) == (len(vs), 2 if name == "overall" else 1)
        assert r["throughput_rps"] == round(len(vs) / 10, 2)
        for q in (50, 95, 99):
            assert r[f"p{q}"] == pytest.approx(np.percentile(vs, q), abs=0.051)


def test_running_totals_do_not_depend_on_buckets(spark):
    rng = np.random.default_rng(6)
    # One group holds most rows, one group name is missing, and a few values repeat very often.
    rows = [("hot", float(v)) for v in np.concatenate([rng.normal(size=4000), np.zeros(2000)])] + [(None, float(v)) for v in rng.normal(size=300)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("id", F.monotonically_increasing_id())
    one = {(r["id"]): (r["rank"], r["rows"]) for r in ranked(df, ["g"], ["v", "id"]).collect()}
    many = {(r["id"]): (r["rank"], r["rows"]) for r in ranked(df, ["g"], ["v", "id"], rows_per_bucket=97).collect()}
    assert one == many and len(one) == len(rows)
    q = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], ["v"], {"m": 0.37}, rows_per_bucket=50).collect()}
    for g in ("hot", None):
        assert q[g] == pytest.approx(np.percentile([v for k, v in rows if k == g], 37), abs=1e-12)


def test_smallest_draws_is_exact(spark):
    df = spark.range(5000).withColumn("d", (F.col("id") * 7919) % 997)  # many equal draws
    got = {r["id"] for r in smallest_draws(df, ["id"], 1234, F.col("d")).filter("chosen").collect()}
    want = {r["id"] for r in df.orderBy("d", "id").limit(1234).collect()}
    assert got == want


def test_group_holdout_keeps_groups_whole(spark):
    df = spark.range(1000).select((F.col("id") % 101).cast("string").alias("cell"), "id")
    flagged = group_holdout(df, "cell")
    per = flagged.groupBy("cell").agg(F.count_distinct("is_test").alias("n"), F.max("is_test").alias("t")).collect()
    assert all(r["n"] == 1 for r in per) and sum(r["t"] for r in per) == 26  # ceil(101 / 4)
    assert flagged.count() == 1000
    assert {r["cell"] for r in per if r["t"]} == {r["cell"] for r in group_holdout(df.repartition(3), "cell").filter("is_test").collect()}


def test_fixed_sample_repeats(spark):
    df = spark.range(1000)
    s = fixed_sample(df, ["id"], 200).collect()
    assert len(s) == 200
    assert {r["id"] for r in s} == {r["id"] for r in fixed_sample(df.repartition(5), ["id"], 200).collect()}
    assert fixed_sample(df, ["id"], 5000).count() == 1000


ADVICE = "stress int, conf double, ndwi double, temp double, et0 double, rain double"
CASES = [((2, 34.0, 10.0, 0.1, 0.0), 1, "#dc3545"), ((2, 20.0, 36.0, 0.1, 0.0), 1, "#dc3545"), ((2, 20.0, 10.0, 0.01, 0.0), 1, "#dc3545"),
         ((2, 20.0, 10.0, 0.1, 0.0), 2, "#ffc107"), ((1, 40.0, 40.0, 0.0, 5.1), 3, "#28a745"), ((1, 40.0, 40.0, 0.0, 5.0), 2, "#fd7e14"), ((0, 40.0, 40.0, 0.0, 0.0), 3, "#28a745")]


def test_advisory_rules(spark):
    rows = [(s, 0.876, n, t, e, r) for (s, t, e, n, r), _, _ in CASES]
    df = spark.createDataFrame(rows, ADVICE).withColumn("k", F.monotonically_increasing_id())
    out = df.orderBy("k").select(advisory("stress", "conf", "ndwi", "temp", "et0", "rain").alias("a")).collect()
    assert [(r["a"]["priority"], r["a"]["color"]) for r in out] == [(p, c) for _, p, c in CASES]
    first = out[0]["a"]
    assert set(first["texts"]) == {"en", "mr", "hi"} and first["confidence_pct"] == 87.6
    assert "34.0°C" in first["texts"]["en"]["recommendation"] and "0.10" in first["texts"]["hi"]["recommendation"]
    assert "5.1" in out[4]["a"]["texts"]["mr"]["recommendation"]
    assert isinstance(first["texts"]["en"]["actionable_steps"], list)


def test_one_language_equals_the_view_of_all(spark):
    df = spark.createDataFrame([(2, 0.9, 0.0, 34.0, 10.0, 0.0, "MR"), (1, 0.9, 0.0, 34.0, 10.0, 9.0, "xx"), (0, 0.9, 0.3, 34.0, 10.0, 9.0, "hi")], ADVICE + ", lang string")
    inputs = ("stress", "conf", "ndwi", "temp", "et0", "rain")
    a = df.select(localised(advisory(*inputs), F.col("lang")).alias("a")).collect()
    b = df.select(advisory_in(F.col("lang"), *inputs).alias("a")).collect()
    assert a == b and [r["a"]["language"] for r in a] == ["mr", "en", "hi"]


def cycle(spark, cells=30):
    rows = [(f"C{i}", d, i % 3, i % 3 + 1 if i % 3 < 3 else 1, 0.4, 0.1 * (i % 3)) for d in (date(2023, 12, 1), date(2024, 1, 1)) for i in range(cells)]
    return spark.createDataFrame(rows, "cell_id string, date date, stress_code int, priority int, ndvi_mean double, ndwi_mean double")


def test_kpis(spark):
    bare = cycle(spark, 4).filter(F.col("date") == date(2024, 1, 1)).withColumn("cell_id", F.concat(F.lit("B"), F.col("cell_id"))).withColumn("ndvi_mean", F.lit(None).cast("double"))
    out = kpi.cycle_kpis(cycle(spark).unionByName(bare), vegetated=F.col("ndvi_mean") >= 0.15)
    rows = {r["cycle_date"]: r for r in out.collect()}
    r = rows[date(2024, 1, 1)]
    assert (r["total_culturable_cells"], r["active_cultivated_cells"], r["fallow_or_bare_cells"], r["total_cultivated_hectares"]) == (34, 30, 4, 187.5)
    assert r["low_stress_pct"] + r["moderate_stress_pct"] + r["high_stress_pct"] == pytest.approx(100, abs=0.2)
    assert r["priority_1_urgent_ha"] + r["priority_2_scheduled_ha"] + r["priority_3_normal_ha"] == 187.5
    assert (r["mean_ndvi"], r["mean_ndwi"]) == (0.4, 0.1)
    assert {x["stress_class"]: x["hectares"] for x in kpi.class_areas(out.filter(F.col("cycle_date") == date(2024, 1, 1))).collect()} == {"LOW": 62.5, "MODERATE": 62.5, "HIGH": 62.5}


def test_half_hectares_round_to_even(spark):
    one = cycle(spark, 541).filter(F.col("date") == date(2024, 1, 1))
    r = kpi.cycle_kpis(one, vegetated=F.lit(True)).first()
    assert r["total_cultivated_hectares"] == 3381.2  # 541 cells are 3381.25 ha


def test_latest_date_needs_coverage(spark):
    df = cycle(spark).filter((F.col("date") == date(2023, 12, 1)) | F.col("cell_id").isin("C1", "C2"))
    assert kpi.latest_covered_date(df).first()[0] == date(2023, 12, 1)
    assert kpi.latest_covered_date(cycle(spark)).first()[0] == date(2024, 1, 1)
    with pytest.raises(ValueError, match="not in the table"):
        kpi.require_date(df, date(1999, 1, 1))


def test_drift_by_scenario_leaves_out_missing(spark):
    one = spark.createDataFrame([(0.36,)], "drifted_share double")
    assert [tuple(r) for r in kpi.drift_by_scenario({"simulated": one}).collect()] == [("simulated", 0.36)]


@pytest.mark.parametrize(("n", "limit", "want"), [(10, 4, [0, 2, 4, 6]), (10, 3, [0, 3, 6]), (10, 10, list(range(10))), (10, 0, list(range(10))), (11, 20, list(range(11)))])
def test_stride(spark, n, limit, want):
    df = spark.range(n).select(F.lit(date(2024, 1, 1)).alias("date"), F.format_string("C%03d", "id").alias("cell_id"), "id")
    got = maps.stride_sample(df, limit=limit, rows_per_bucket=3)
    assert sorted(r["id"] for r in got.collect()) == want
    meta = maps.sample_metadata(got).first()
    assert (meta["total_cells"], meta["sampled_cells"], meta["is_sampled"]) == (n, len(want), len(want) < n)


def test_confusion_and_weights(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (2, 2)], "a int, p int")
    cells = {(r["actual"], r["predicted"]): (r["rows"], r["row_share"]) for r in scores.confusion(df, "a", "p").collect()}
    assert len(cells) == 9 and cells[0, 1] == (1, 0.5) and cells[1, 1] == (0, 0.0) and cells[2, 2] == (2, 1.0)
    weights = {r["a"]: r["weight"] for r in scores.class_weights(df.union(df.limit(1)), "a").collect()}
    assert weights == {0: pytest.approx(5 / (2 * 3)), 2: pytest.approx(5 / 4)}


def test_counted_rows_score_like_rows(spark):
    rows = spark.range(3000).select(
        (F.xxhash64("id") % 3).cast("int").alias("seen"), (F.col("id") % 3).cast("int").alias("said"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)) / 7).alias("p"),
    ).withColumn("actual", F.abs("seen")).drop("seen")
    counted = rows.groupBy("actual", "said", "p").agg(F.count("*").alias("n"))
    assert counted.count() < 70
    assert sorted(scores.class_scores(counted, "actual", "said", rows="n").collect()) == sorted(scores.class_scores(rows, "actual", "said").collect())
    areas = [sorted(scores.roc_auc(df, "actual", {1: "p", 2: "p"}, **more).collect()) for df, more in ((counted, {"rows": "n"}), (rows, {}))]
    assert areas[0] == areas[1]
