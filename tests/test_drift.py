from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolattice.operators import drift
from hydrolattice.plans.registry import QUERIES
from hydrolattice.plans import score_queries  # noqa: F401
from hydrolattice.settings import Drift


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(9)
    a = {"x": rng.normal(size=1500), "y": np.round(rng.gamma(2, 2, 1500), 1)}
    b = {"x": rng.normal(0.5, 1.2, size=900), "y": np.round(rng.gamma(2, 2, 900), 1)}

    def frame(d):
        return spark.createDataFrame([(float(x), float(y)) for x, y in zip(d["x"], d["y"])], "x double, y double")

    return a, b, frame(a), frame(b)


def direct(u, v):
    values = np.sort(np.concatenate([u, v]))
    f = np.searchsorted(np.sort(u), values, "right") / len(u)
    g = np.searchsorted(np.sort(v), values, "right") / len(v)
    return np.abs(f - g).max(), np.sum(np.abs(f - g)[:-1] * np.diff(values))


@pytest.mark.parametrize("bucket", [1_000_000, 60])
def test_statistics_match_numpy(samples, bucket):
    a, b, ref, cur = samples
    out = {r["feature"]: r for r in drift.two_sample_statistics(ref, cur, ["x", "y"], rows_per_bucket=bucket).collect()}
    for name in ("x", "y"):
        ks, w = direct(a[name], b[name])
        assert out[name]["ks"] == pytest.approx(ks, abs=1e-12)
        assert out[name]["wasserstein"] == pytest.approx(w, abs=1e-9)
        assert out[name]["reference_std"] == pytest.approx(a[name].std(), abs=1e-9)


@pytest.mark.parametrize("rows", [1000, 1001])
def test_method_does_not_depend_on_rows(samples, rows):
    _, _, ref, cur = samples
    ref = ref.limit(rows)
    far = {r["feature"]: r for r in drift.drift_scores(ref, cur, ["x", "y"]).collect()}
    assert far["x"]["test"].startswith("Wasserstein") and far["x"]["drift"] and not far["y"]["drift"]
    likely = {r["feature"]: r for r in drift.drift_scores(ref, cur, ["x", "y"], Drift(method="p_value")).collect()}
    assert likely["x"]["test"] == "K-S p_value" and likely["x"]["drift"] and likely["y"]["score"] > 0.05
    for name in ("x", "y"):
        assert (far[name]["distance"], far[name]["p_value"]) == (likely[name]["distance"], likely[name]["p_value"])
    with pytest.raises(ValueError, match="unknown drift method"):
        drift.drift_scores(ref, cur, ["x"], Drift(method="size"))


def test_direction(spark):
    rows = [("Wasserstein distance (normed)", 0.2, 0.1, True), ("Wasserstein distance (normed)", 0.05, 0.1, False), ("K-S p_value", 0.01, 0.05, True), ("K-S p_value", 0.5, 0.05, False), ("PSI", 0.2, 0.1, True)]
    df = spark.createDataFrame(rows, "m string, v double, t double, want boolean")
    assert all(r[0] == r[1] for r in df.select(drift.is_drifted(F.col("m"), F.col("v"), F.col("t")), "want").collect())


def test_p_value(spark):
    # Kolmogorov distribution: Q(1.0) = 0.26999967, Q(1.5) = 0.02221796.
    df = spark.createDataFrame([(1.0,), (1.5,), (0.0,), (0.1,)], "lam double")
    n = F.lit(2_000_000)
    p = [r[0] for r in df.select(drift.ks_p_value(F.col("lam") / 1000.0, n, n)).collect()]
    assert p[0] == pytest.approx(0.26999967, abs=1e-7) and p[1] == pytest.approx(0.02221796, abs=1e-7) and p[2:] == [1.0, 1.0]


def test_summary_and_errors(spark, samples):
    _, _, ref, cur = samples
    row = drift.drift_summary(drift.drift_scores(ref, cur, ["x", "y"])).first()
    assert (row["drifted_share"], row["drift_detected"], row["retrain_recommended"]) == (0.5, True, True)
    with pytest.raises(ValueError, match="reference rows"):
        drift.require_both(ref.limit(0), cur)


def test_sensitivity_flags_only_what_moved(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(25, 3, 6000), rng.normal(10, 2, 6000)))], "id long, temp_max_c double, wind double")
    out = drift.sensitivity(df, ["id"], ["temp_max_c", "wind"])
    assert not any(r["drift"] for r in out["control"].collect())
    assert {r["feature"]: r["drift"] for r in out["simulated"].collect()} == {"temp_max_c": True, "wind": False}
    moved = spark.createDataFrame([("temp_max_c",), ("ndwi_mean",)], "feature string")
    assert {tuple(r) for r in drift.flagged_sets(out["simulated"], moved).collect()} == {("temp_max_c", "flagged"), ("ndwi_mean", "missed")}


def test_halves_share_the_rows_and_an_empty_side_is_an_error(spark):
    df = spark.range(4000).select("id", F.col("id").cast("double").alias("x"))
    first = df.filter(drift.hash_share(["id"], 42) < (1 << 31)).count()
    assert 1800 < first < 2200
    with pytest.raises(Exception, match="no value on one side"):
        drift.drift_scores(df.limit(0), df, ["x"]).collect()
    with pytest.raises(Exception, match="no value on one side"):
        drift.drift_summary(drift.drift_scores(df, df.limit(0), ["x"])).collect()
    with pytest.raises(Exception, match="no value on one side"):
        drift.sensitivity(df, ["id"], ["x"], half=F.lit(False))["control"].collect()


def _distance(a, b):
    values = np.unique(np.concatenate([a, b]))
    share = [np.searchsorted(np.sort(side), values, side="right") / len(side) for side in (a, b)]
    return float((np.abs(share[0] - share[1])[:-1] * np.diff(values)).sum())


def test_halves_query_equals_direct_distances(spark):
    folder = "/root/testdata/sf0.001"
    got = {(r["scenario"], r["feature"]): r for r in QUERIES["drift_halves"].run(spark, folder).collect()}
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_totalprice", (F.col("o_orderkey") % 97).cast("double").alias("k97"), (drift.hash_share(["o_orderkey"], 42) < (1 << 31)).alias("first")).toPandas()
    first, second = orders[orders["first"]], orders[~orders["first"]]
    for scenario, moved in (("control", 0.0), ("simulated", 90000.0)):
        for feature in ("o_totalprice", "k97"):
            a, b = first[feature].to_numpy(), second[feature].to_numpy() + (moved if feature == "o_totalprice" else 0.0)
            assert got[scenario, feature]["distance"] == pytest.approx(_distance(a, b) / a.std(), abs=1e-4)
    assert got["simulated", "o_totalprice"]["drift"] and not got["control", "o_totalprice"]["drift"]
