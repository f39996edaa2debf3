from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hydrolattice.operators import profile, quality
from hydrolattice.settings import MANIFEST_COLUMNS, MODEL_FEATURES, WEATHER_RANGES
from tests import oracle


def failed(checks):
    return {r["check"] for r in checks.collect() if not r["passed"]}


@pytest.fixture(scope="module")
def weather(spark):
    days = spark.range(517).select(F.date_add(F.lit(date(2023, 1, 1)), F.col("id").cast("int")).alias("date"), F.lit("WX_000").alias("weather_point_id"))
    return days.withColumns({c: F.lit((lo + hi) / 2) for c, (lo, hi) in WEATHER_RANGES.items()})


@pytest.fixture(scope="module")
def features(spark):
    start = date(2024, 2, 1) - timedelta(days=85)
    rows = [(f"C{k}", start + timedelta(days=5 * i), True, k) for i in range(20) for k in (0, 1, 2)]
    df = spark.createDataFrame(rows, "cell_id string, date date, is_vegetated boolean, target_stress_class int")
    return df.withColumns({c: F.lit(0.1) for c in MODEL_FEATURES})


def test_good_tables_pass(weather, features):
    assert failed(quality.weather_suite(weather)) == set()
    assert failed(quality.feature_suite(features)) == set()


def test_weather_problems(weather):
    assert failed(quality.weather_suite(weather.drop("et0_mm"))) == {"required_columns"}
    first = F.col("date") == date(2023, 1, 1)
    hot = quality.weather_suite(weather.withColumn("temp_max_c", F.when(first, 90.0).otherwise(F.col("temp_max_c"))))
    assert failed(hot) == {"value_ranges"}
    assert hot.filter("check = 'value_ranges'").first()["offending"] == ["temp_max_c=1"]
    empty = quality.weather_suite(weather.withColumn("et0_mm", F.lit(None).cast("double")))
    assert failed(empty) == {"missing_values"}
    assert empty.filter("check = 'missing_values'").first()["offending"] == ["et0_mm=1.0"]
    assert failed(quality.weather_suite(weather.filter(F.col("date") < date(2024, 5, 1)))) == {"date_coverage"}
    gap = weather.unionByName(weather.filter(~first).withColumn("weather_point_id", F.lit("WX_001")))
    assert failed(quality.weather_suite(gap)) == {"no_gaps_between_points"}


def test_feature_problems(features):
    assert failed(quality.feature_suite(features.drop("ndvi_mean"))) == {"required_columns"}
    first = (F.col("cell_id") == "C0") & (F.col("date") == date(2023, 11, 8))
    assert failed(quality.feature_suite(features.withColumn("ndvi_mean", F.when(first, 5.0).otherwise(F.col("ndvi_mean"))))) == {"value_ranges"}
    bad = quality.feature_suite(features.withColumn("target_stress_class", F.when(first, 7).otherwise(F.col("target_stress_class"))))
    assert failed(bad) == {"label_values"}
    assert bad.filter("check = 'label_values'").first()["offending"] == ["7"]
    twice = quality.feature_suite(features.unionByName(features.filter(first)))
    assert failed(twice) == {"one_row_per_cell_and_date"}
    early = features.filter(F.col("date") < date(2024, 2, 1))
    assert failed(quality.feature_suite(early)) == {"date_coverage", "all_classes_in_later_dates"}


@pytest.mark.parametrize("labels", [20, 21, 57])
def test_every_unexpected_label_is_listed(features, labels):
    odd = features.withColumn("target_stress_class", F.when(F.col("cell_id") == "C0", F.col("target_stress_class") + 10 + F.pmod(F.hash("date"), F.lit(100_000))).otherwise(F.col("target_stress_class")))
    more = odd.unionByName(features.filter("cell_id = 'C1'").limit(1).withColumn("target_stress_class", F.explode(F.sequence(F.lit(200_000), F.lit(200_000 + labels - 1)))))
    row = quality.feature_suite(more).filter("check = 'label_values'").first()
    want = more.filter("target_stress_class not in (0, 1, 2)").select("target_stress_class").distinct().count()
    assert want >= labels and len(row["offending"]) == want and row["observed"] == str(want)


def test_scene_problems(spark):
    days = spark.range(20).select(F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("acquisition_date"))
    manifest = days.withColumns({c: F.lit("x") for c in MANIFEST_COLUMNS if c != "acquisition_date"})
    wide = spark.createDataFrame([(date(2023, 1, 1),), (date(2025, 1, 1),)], "date date")
    narrow = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),)], "date date")
    assert failed(quality.scene_suite(manifest, wide)) == set()
    assert failed(quality.scene_suite(manifest, narrow)) == {"weather_covers_scenes"}
    assert failed(quality.scene_suite(manifest.limit(19), wide)) == {"scene_count"}


def test_report_repeats_and_enforces(spark, features):
    checks = quality.feature_suite(features)
    one, two = (quality.report(checks, "features", {"features": features}).toJSON().first() for _ in range(2))
    assert one == two and '"features":60' in one
    quality.enforce(checks)
    with pytest.raises(ValueError, match="date_coverage"):
        quality.enforce(quality.feature_suite(features.filter(F.col("date") < date(2024, 2, 1))))


def test_suite_scans_once_for_row_rules(weather):
    plan = quality.value_range_check(weather, WEATHER_RANGES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_describe_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=501)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)] + [(None, 0)], "v double, g int")
    row = profile.describe(df, ["v"], rows_per_bucket=50).first()
    assert row["count"] == 501
    for name, want in {"mean": values.mean(), "std": values.std(ddof=1), "q25": np.percentile(values, 25), "q50": np.median(values), "q75": np.percentile(values, 75), "min": values.min(), "max": values.max()}.items():
        assert row[name] == pytest.approx(want, abs=5.1e-5), name


def test_shares_keep_absent_classes(spark):
    df = spark.createDataFrame([("LOW",), ("LOW",), ("HIGH",), (None,)], "label string")
    rows = {r["label"]: (r["rows"], r["pct"]) for r in profile.class_shares(df, "label", ("LOW", "MODERATE", "HIGH")).collect()}
    assert rows == {"LOW": (2, 66.67), "MODERATE": (0, 0.0), "HIGH": (1, 33.33)}


@pytest.mark.parametrize("clicks", [(10.41, 1.22, 6.93, 1.44), (10.41, 6.93, 1.44, 1.22)])
def test_a_sum_on_a_limit_is_on_it_in_any_order(spark, tmp_path, clicks):
    """Added one by one, the first order gives 20.000000000000004, the second 20.0; the limit is 20."""
    rows = [(i, datetime(2024, 1, 1 + day), 1, "click", v) for day in (0, 29) for i, v in enumerate(clicks)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    out = entry.queries()["weather_suite"](spark, str(tmp_path))
    assert {r["check"]: r["offending"] for r in out.collect()}["value_ranges"] == ""
    assert oracle.differences(out, con, entry.oracle_sql()["weather_suite"]) == (5, [])


def test_small_shares_are_plain_numbers(spark):
    df = spark.range(10_000).select(F.when(F.col("id") >= 5, F.col("id")).alias("x"), F.when(F.col("id") >= 1000, F.col("id")).alias("y"), F.col("id").alias("z"))
    told = quality.missing_value_check(df, ["x", "y", "z"], 0.0002).first()
    assert (told["observed"], told["offending"]) == ("0.1", ["x=0.0005", "y=0.1"])
    assert quality.missing_value_check(df, ["z"], 0.01).first()["observed"] == "0.0"
