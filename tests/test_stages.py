"""The stages end to end on a small area, and sources and sinks on files."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolattice.operators import grid
from hydrolattice.plans.stages import Stages
from hydrolattice.settings import DEFAULTS, Quality, Training
from hydrolattice.sources import areas, catalogue, schemas, tables, weather_payloads


@pytest.fixture(scope="module")
def area_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("area") / "area.geojson"
    ring = [[74.5, 18.0], [74.51, 18.0], [74.51, 18.008], [74.5, 18.008], [74.5, 18.0]]
    features = [{"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
                {"type": "Feature", "properties": {"name": "A", "sentinel2_mgrs_tiles": ["43QDA"]}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(path)


def test_area_file(spark, area_file, tmp_path):
    area = areas.read_areas(spark, area_file)
    info = areas.area_info(area).first()
    assert (info["min_lon"], info["max_lat"], info["tiles"]) == (74.5, 18.008, ["43QDA"])
    empty = tmp_path / "none.geojson"
    empty.write_text('{"features": []}')
    with pytest.raises(Exception, match="no polygon feature"):
        areas.read_areas(spark, str(empty)).collect()


def test_csv_scan_prunes_and_drops_nan(spark, tmp_path):
    df = spark.createDataFrame([("A", date(2024, 1, 1), 1.5), ("B", date(2024, 1, 2), None)], "cell_id string, date date, ndvi_mean double")
    tables.write_csv(df.withColumn("ndvi_mean", F.coalesce("ndvi_mean", F.lit(float("nan")))), str(tmp_path / "t"), gzip=True)
    back = tables.read_csv(spark, str(tmp_path / "t"), "cell_id string, date date, ndvi_mean double", ["cell_id", "ndvi_mean"])
    assert {tuple(r) for r in back.collect()} == {("A", 1.5), ("B", None)}
    tables.write_parquet(df, str(tmp_path / "p"))
    scan = spark.read.parquet(str(tmp_path / "p")).select("cell_id").filter(F.col("cell_id") == "A")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<cell_id:string>" in scan and "EqualTo(cell_id,A)" in scan


def test_scene_cache_skips_known_scenes(spark, tmp_path):
    seen, path = [], str(tmp_path / "cache")

    def compute(todo):
        seen.append(sorted(r["scene_id"] for r in todo.collect()))
        return todo.withColumn("cells", F.lit(1))

    tables.extend_scene_cache(spark.createDataFrame([("S1",)], "scene_id string"), path, compute)
    tables.extend_scene_cache(spark.createDataFrame([("S1",), ("S2",)], "scene_id string"), path, compute)
    assert seen == [["S1"], ["S2"]] and tables.cached_scenes(spark, path).count() == 2


def test_forecasts_replace_their_issue_date(spark, tmp_path):
    path = str(tmp_path / "f")
    for day, rows in ((1, 3), (2, 2), (2, 4)):
        weather_payloads.append_forecast(weather_payloads.issue_forecast(spark.range(rows), F.lit(date(2024, 1, day))), path)
    assert {r["forecast_issued_on"].day: r["count"] for r in spark.read.parquet(path).groupBy("forecast_issued_on").count().collect()} == {1: 3, 2: 4}


def test_path_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "2024-01-05_S9"))
    row = catalogue.with_path_columns(spark.read.parquet(str(tmp_path / "2024-01-05_S9"))).first()
    assert (row["date"], row["scene_id"]) == (date(2024, 1, 5), "S9")


def test_partition_filter_reaches_the_scan(spark, tmp_path):
    df = spark.range(100).select(F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 5).cast("int")).alias("date"), "id")
    tables.write_parquet(df, str(tmp_path / "t"), ["date"])
    plan = spark.read.parquet(str(tmp_path / "t")).filter(F.col("date") == date(2024, 1, 3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_grid_is_stored_once(spark, tmp_path, area_file):
    area = areas.read_areas(spark, area_file)
    made = []

    def make():
        made.append(1)
        projected = grid.projected_rings(area)
        return grid.spatial_grid(projected.withColumn("edges", areas.shape_edges("rings")), id_prefix="T")

    one = areas.load_grid(spark, str(tmp_path / "g"), make)
    two = areas.load_grid(spark, str(tmp_path / "g"), make)
    assert one.count() == two.count() > 10 and len(made) == 1
    row = one.filter("cell_id = 'T_0001'").first()
    assert (row["centroid_lon"], row["centroid_lat"]) == (pytest.approx(74.5, abs=0.003), pytest.approx(18.0, abs=0.003))


def test_all_stages(spark, tmp_path, area_file):
    rng = np.random.default_rng(12)
    area = areas.read_areas(spark, area_file)
    projected = grid.projected_rings(area).withColumn("edges", areas.shape_edges("rings"))
    cells = grid.spatial_grid(projected, id_prefix="T")
    corner = cells.agg(F.min("minx"), F.min("miny"), F.max("maxy")).first()
    points = grid.weather_lattice(area, spacing=0.01).drop("area_id")
    assert points.count() >= 2

    days = [date(2023, 1, 1) + timedelta(days=i) for i in range(420)]
    texts = []
    for i, p in enumerate(points.collect()):
        wave = [20 + 15 * np.sin(d.timetuple().tm_yday / 58.0) + i * 0.1 for d in days]
        daily = {"time": [str(d) for d in days], "temperature_2m_max": [float(w + 5) for w in wave], "temperature_2m_min": [float(w - 5) for w in wave],
                 "temperature_2m_mean": [float(w) for w in wave], "precipitation_sum": [float(v) for v in rng.gamma(0.3, 2, len(days))],
                 "rain_sum": [0.0] * len(days), "relative_humidity_2m_mean": [50.0] * len(days), "wind_speed_10m_max": [3.0] * len(days),
                 "shortwave_radiation_sum": [20.0] * len(days), "et0_fao_evapotranspiration": [float(max(0.5, w / 6)) for w in wave]}
        texts.append((p["weather_point_id"], json.dumps({"daily": daily})))
    payloads = spark.createDataFrame(texts, "weather_point_id string, value string")

    scene_days = [date(2023, 9, 1) + timedelta(days=8 * i) for i in range(21)]
    size = 50
    frame = spark.createDataFrame([(f"S{i:02d}", d) for i, d in enumerate(scene_days)], "scene_id string, date date")
    pixels = frame.crossJoin(spark.range(size).select(F.col("id").cast("int").alias("row"))).crossJoin(spark.range(size).select(F.col("id").cast("int").alias("col")))
    noise = lambda k: (F.pmod(F.xxhash64("scene_id", "row", "col", F.lit(k)), F.lit(1000)) / 1000.0)
    pixels = pixels.withColumns({
        "b02": noise(1) * 400 + 300, "b03": noise(2) * 400 + 400, "b04": noise(3) * 500 + 300, "b08": noise(4) * 1000 + 2500,
        "b11": F.col("col") * 60 + noise(5) * 500 + 300, "b12": noise(6) * 900 + 800, "scl": F.when(noise(7) < 0.9, 4).otherwise(9),
    })

    settings = replace(
        DEFAULTS,
        quality=Quality(weather_start=days[0], weather_end=days[-1], min_dates=20),
        training=Training(split=date(2023, 12, 10), forest_trees=6, forest_depth=5),
    )
    job = Stages(spark, str(tmp_path / "run"), settings)
    assert job.weather(payloads, points).count() == len(days) * points.count()
    manifest = frame.select("scene_id", F.col("date").alias("acquisition_date"), F.lit(1.0).alias("cloud_cover_pct"), F.lit("43QDA").alias("mgrs_tile"))
    assert job.check_raw(manifest).first()["passed"]
    satellite = job.satellite(pixels, cells, origin_x=corner[0], origin_y=corner[2], pixel=20.0, grid_x=corner[0], grid_y=corner[1], cell=250.0)
    kept = cells.count()
    assert satellite.groupBy("date").count().filter(F.col("count") > kept).count() == 0
    features = job.features()
    assert set(schemas.TRAINING.replace(",", "").split()[::2]) == set(features.columns)
    assert job.check_features().first()["passed"]

    model, results, best = job.train(("forest",))
    assert best == "forest" and results.count() == 3
    assert job.gate(None).first()["promoted"] in (True, False)
    cycle = job.predict(model, cells)
    assert cycle == scene_days[-1]
    by_date = spark.read.json(f"{job.root}/kpi_by_date")
    published = spark.read.json(f"{job.root}/kpi_published")
    assert by_date.count() == len(scene_days) and published.count() == 1
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{job.root}/stress_map").collect()]
    assert len(lines) == published.first()["active_cultivated_cells"]
    assert {f["properties"]["date"] for f in lines} == {str(cycle)} and lines[0]["geometry"]["type"] == "Polygon"
    irrigation = [json.loads(r["value"]) for r in spark.read.text(f"{job.root}/irrigation_map").collect()]
    assert {f["properties"]["cell_id"] for f in irrigation} == {f["properties"]["cell_id"] for f in lines}
    assert set(irrigation[0]["properties"]) >= {"title_en", "urgency_mr", "recommendation_hi", "actionable_steps_en", "priority_label"}
    # A date's map agrees with its KPIs.
    other = scene_days[3]
    one = by_date.filter(F.col("cycle_date") == str(other)).first()
    assert job.map_of(other, cells).count() == one["active_cultivated_cells"]
    assert job.map_of(other, cells, limit=5).count() == 5
    detail = job.cell(other, json.loads(job.map_of(other, cells, limit=1).first()["value"])["properties"]["cell_id"], "mr").first()
    assert detail["advisory"]["language"] == "mr"
    scores, summary = job.drift(cycle)
    assert scores.count() == 25 and summary.first()["drifted_share"] >= 0
    with pytest.raises(ValueError, match="not in the table"):
        job.predict(model, cells, date(1999, 1, 1))


def test_blocks_to_features(spark, tmp_path):
    """Raw 1500 and 4000 are 500 and 3000 after the offset of baseline 05.10."""
    ten = [("S1", date(2024, 1, 1), b, 0, 0, [[v] * 4] * 4) for b, v in (("B02", 1500.0), ("B03", 1500.0), ("B04", 1500.0), ("B08", 4000.0))]
    twenty = [("S1", date(2024, 1, 1), b, 0, 0, [[v] * 2] * 2) for b, v in (("B11", 2000.0), ("B12", 2500.0), ("SCL", 4.0))]
    blocks = spark.createDataFrame(ten + twenty, schemas.PIXEL_BLOCKS)
    scenes = spark.createDataFrame([("S1", "05.10")], "scene_id string, baseline string")
    cells = spark.createDataFrame([("C1", 0, 0, 74.0, 18.0)], "cell_id string, ix long, iy long, centroid_lon double, centroid_lat double")
    job = Stages(spark, str(tmp_path / "run"))
    row = job.satellite_from_blocks(blocks, scenes, cells, origin_y=40.0, pixel=10.0, cell=40.0).first()
    assert row["ndvi_mean"] == pytest.approx(2500 / 3500, abs=1e-4) and (row["b04_mean"], row["b11_mean"], row["valid_pixel_pct"]) == (500.0, 1000.0, 100.0)
    job.spark.createDataFrame([("C1", "x")], "cell_id string, ndvi_mean string").write.parquet(f"{job.root}/features")
    with pytest.raises(ValueError, match="ndvi_mean is string, not double"):
        job.table("features")
