from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrolattice.operators.labels import climatic_labels, training_table
from hydrolattice.operators.nearest import nearest_points
from hydrolattice.operators.weather import ROLLING_FEATURES, Rolling, rolling, weather_features, with_label_inputs
from hydrolattice.settings import WaterBalance
from hydrolattice.sources.weather_payloads import issue_forecast, parse_payloads

SCHEMA = "weather_point_id string, date date, rainfall_mm double, temp_mean_c double, temp_max_c double, et0_mm double"


def series(days, points=("WX_000", "WX_001")):
    rng = np.random.default_rng(3)
    rows = []
    for p in points:
        for d in range(days):
            gap = rng.random() < 0.05
            rows.append((p, date(2024, 1, 1) + timedelta(d), None if gap else float(rng.gamma(1.0, 3.0)), float(20 + rng.normal()), 30.0 + d % 7, float(rng.random() * 6)))
    return rows


def test_rolling_is_per_point(spark):
    rows = [(p, date(2024, 1, d), rain, 25.0, 30.0, 4.0) for p, rain in (("WX_000", 1.0), ("WX_001", 10.0)) for d in (1, 2, 3)]
    out = weather_features(spark.createDataFrame(rows, SCHEMA)).filter(F.col("date") == date(2024, 1, 3))
    assert {r["weather_point_id"]: r["rainfall_8day"] for r in out.collect()} == {"WX_000": 3.0, "WX_001": 30.0}


@pytest.mark.parametrize("rows_per_task", [None, 40])
def test_rolling_matches_pandas(spark, rows_per_task):
    rows = series(150)
    out = weather_features(spark.createDataFrame(rows, SCHEMA), rows_per_task=rows_per_task)
    got = out.toPandas().sort_values(["weather_point_id", "date"]).reset_index(drop=True)
    assert len(got) == len(rows)
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for f in ROLLING_FEATURES:
        how = {"sum": "sum", "avg": "mean", "max": "max"}[f.how]
        want = frame.groupby("weather_point_id")[f.source].transform(lambda s, f=f, how=how: getattr(s.rolling(f.rows, min_periods=1), how)().round(2))
        pd.testing.assert_series_equal(got[f.output], want, check_names=False)
    gap = (got["et0_8day_sum"] - got["rainfall_8day"]).clip(lower=0).round(2)
    pd.testing.assert_series_equal(got["climatic_water_deficit_8day"], gap, check_names=False)


def test_one_shuffle_for_all_windows(spark):
    plan = weather_features(spark.createDataFrame(series(5), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_thresholds(spark):
    balance = WaterBalance()
    df = spark.createDataFrame([(1, 11 / 0.95, 0.0), (2, 29 / 0.95, 0.0), (3, None, 0.0), (4, 12 / 0.95, 0.0), (5, 28 / 0.95, 0.0)], "k int, et0_8day_sum double, rainfall_8day double")
    out = {r["k"]: r["target_stress_label"] for r in climatic_labels(df, balance).collect()}
    assert out == {1: "LOW", 2: "HIGH", 3: "MODERATE", 4: "MODERATE", 5: "MODERATE"}


def test_missing_sums_are_made_per_point(spark):
    rows = [(p, date(2024, 1, d), rain, 25.0, 30.0, 4.0) for p, rain in (("A", 1.005), ("B", 10.0)) for d in (1, 2)]
    out = with_label_inputs(spark.createDataFrame(rows, SCHEMA))
    last = {r["weather_point_id"]: (r["rainfall_8day"], r["et0_8day_sum"]) for r in out.filter(F.col("date") == date(2024, 1, 2)).collect()}
    assert last == {"A": (2.01, 8.0), "B": (20.0, 8.0)}


def test_nearest_point_of_two(spark):
    cells = spark.createDataFrame([("A", 74.01, 18.0), ("B", 74.29, 18.0)], "cell_id string, centroid_lon double, centroid_lat double")
    points = spark.createDataFrame([("WX_000", 74.0, 18.0), ("WX_001", 74.3, 18.0)], "weather_point_id string, longitude double, latitude double")
    assert dict(nearest_points(cells, points).collect()) == {"A": "WX_000", "B": "WX_001"}


def test_nearest_point_matches_brute_force_on_clusters(spark):
    rng = np.random.default_rng(5)
    # A third of all points sit almost on one place, some exactly on it.
    xy = np.vstack([rng.normal(74, 1, (400, 2)), 74 + rng.random((150, 2)) * 1e-4, np.full((50, 2), 74.00001)])
    ids = [f"P{i:04d}" for i in range(len(xy))]
    queries = np.vstack([rng.normal(74, 2, (500, 2)), np.full((3, 2), 74.00002)])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in zip(ids, xy)], "weather_point_id string, longitude double, latitude double")
    cells = spark.createDataFrame([(f"C{i}", float(x), float(y)) for i, (x, y) in enumerate(queries)], "cell_id string, centroid_lon double, centroid_lat double")
    scale = np.cos(np.radians(xy[:, 1].mean()))
    want = {}
    for i, (x, y) in enumerate(queries):
        d = (xy[:, 0] * scale - x * scale) ** 2 + (xy[:, 1] - y) ** 2
        want[f"C{i}"] = min(zip(d, ids))[1]
    assert dict(nearest_points(cells, points).collect()) == want


@pytest.mark.parametrize("n", [60, 61, 64, 65, 101])
def test_missing_coordinates_do_not_depend_on_the_number_of_points(spark, n):
    points = spark.createDataFrame([(f"P{i:03d}", 70.0 + i / 100, 18.0) for i in range(n)] + [("P_none", None, 18.0)], "weather_point_id string, longitude double, latitude double")
    cells = spark.createDataFrame([("A", 70.004, 18.1), ("B", None, 18.0), ("C", 70.0 + (n - 1) / 100, 17.0)], "cell_id string, centroid_lon double, centroid_lat double")
    assert dict(nearest_points(cells, points).collect()) == {"A": "P000", "B": None, "C": f"P{n - 1:03d}"}


@pytest.mark.parametrize("rows_per_task", [1, 10, 28, 29, 30, 40])
def test_short_chunks_give_the_same_windows(spark, rows_per_task):
    daily = spark.range(100).select(F.lit("P").alias("p"), F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("d"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    features = [Rolling("s30", "sum", "v", 30), Rolling("m8", "max", "v", 8)]
    whole = sorted(map(tuple, rolling(daily, "p", "d", features).collect()))
    assert sorted(map(tuple, rolling(daily, "p", "d", features, rows_per_task=rows_per_task).select("p", "d", "v", "s30", "m8").collect())) == whole


def test_training_table_joins_and_buffers(spark):
    satellite = spark.createDataFrame(
        [("C1", date(2024, 1, 2), 74.01, 18.0, 0.5, 0.02), ("C2", date(2024, 1, 2), 74.29, 18.0, 0.1, 0.5), ("C3", date(2024, 3, 1), 74.0, 18.0, 0.5, 0.1)],
        "cell_id string, date date, centroid_lon double, centroid_lat double, ndvi_mean double, ndwi_mean double",
    )
    weather = spark.createDataFrame(
        [(p, lon, 18.0, date(2024, 1, 2), 40.0, 10.0) for p, lon in (("WX_000", 74.0), ("WX_001", 74.3))],
        "weather_point_id string, longitude double, latitude double, date date, et0_8day_sum double, rainfall_8day double",
    )
    rows = {r["cell_id"]: r for r in training_table(satellite, weather).collect()}
    assert set(rows) == {"C1", "C2"}  # no weather on C3's date
    assert rows["C1"]["weather_point_id"] == "WX_000" and rows["C2"]["weather_point_id"] == "WX_001"
    assert rows["C1"]["water_deficit_8day_mm"] == 30.0 and rows["C1"]["target_stress_label"] == "HIGH"
    assert rows["C2"]["water_deficit_8day_mm"] == 1.5 and rows["C2"]["target_stress_class"] == 0
    assert rows["C1"]["is_vegetated"] and not rows["C2"]["is_vegetated"]


def test_payload_rows(spark):
    text = '{"daily": {"time": ["2024-01-01", "2024-01-02"], "wind_speed_10m_max": [4.0, null]}}'
    rows = parse_payloads(spark.createDataFrame([("P", text)], "id string, value string"), keys=["id"]).orderBy("date").collect()
    assert [(r["date"], r["wind_speed_mps"], r["et0_mm"]) for r in rows] == [(date(2024, 1, 1), 4.0, None), (date(2024, 1, 2), None, None)]
    stamped = issue_forecast(spark.createDataFrame([(1,)], "a int"), F.lit(date(2024, 5, 1))).first()
    assert stamped["forecast_issued_on"] == date(2024, 5, 1)


def test_payload_without_time_fails(spark):
    with pytest.raises(Exception, match="no daily time list"):
        parse_payloads(spark.createDataFrame([('{"daily": {}}',)], "value string")).collect()
