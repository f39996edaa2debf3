from __future__ import annotations

import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolattice.operators import kpi, learn
from hydrolattice.plans import stream_queries
from hydrolattice.plans.registry import Tables
from hydrolattice.streaming import kpi_view, requests, retries, runs, scenes, scoring, windows
from hydrolattice.sources.tables import stored
from tests.test_learn import FEATURES, SMALL

LOG = "ts timestamp, route string, status int, ms double, stress_class string"


@pytest.fixture(scope="module")
def log_folder(spark, tmp_path_factory):
    """Three files in time order."""
    folder = tmp_path_factory.mktemp("log")
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=7 * i), f"/r{i % 3}", 500 if i % 11 == 0 else 200, float(i * 37 % 900), ("LOW", "HIGH")[i % 2]) for i in range(900)]
    for k in range(3):
        part = spark.createDataFrame(rows[k * 300:(k + 1) * 300], LOG).coalesce(1)
        part.write.parquet(str(folder / f"p{k}"))
    return str(folder)


JOBS = {
    "rate": lambda log: requests.request_rate(log, ["route"]),
    "errors": lambda log: requests.error_ratio(log, F.col("status") >= 500),
    "p95": lambda log: requests.latency_quantile(log, ["route"], "ms"),
    "classes": lambda log: requests.class_counts(log, "stress_class"),
}


def read_stream(spark, folder):
    return requests.request_log(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"))


@pytest.mark.parametrize("job", JOBS)
def test_updated_stream_equals_batch(spark, log_folder, tmp_path, job):
    batch = JOBS[job](requests.request_log(spark.read.schema(LOG).parquet(f"{log_folder}/*")))
    keys = [c for c in batch.columns if c in ("window_start", "route", "stress_class")]
    stream = runs.run_available(JOBS[job](read_stream(spark, log_folder)), str(tmp_path / "run"), keys)
    assert sorted(map(tuple, stream.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_append_stream_is_part_of_batch(spark, log_folder, tmp_path):
    batch = {tuple(r) for r in JOBS["classes"](requests.request_log(spark.read.schema(LOG).parquet(f"{log_folder}/*"))).collect()}
    stream = {tuple(r) for r in runs.append_available(JOBS["classes"](read_stream(spark, log_folder)), str(tmp_path / "run")).collect()}
    assert stream and stream < batch


def test_latency_interpolates_in_its_bucket(spark):
    rows = [(datetime(2024, 1, 1), "/a", 200, float(v), "LOW") for v in [10.0] * 90 + [60.0] * 10]
    out = requests.latency_quantile(requests.request_log(spark.createDataFrame(rows, LOG)), ["route"], "ms").first()
    assert out["latency_ms"] == 62.5  # rank 95 is half way through the 50-75 bucket
    high = [(datetime(2024, 1, 1), "/a", 200, 99999.0, "LOW")]
    assert requests.latency_quantile(requests.request_log(spark.createDataFrame(high, LOG)), ["route"], "ms").first()["latency_ms"] == 10000.0
    assert requests.latency_quantile(requests.request_log(spark.createDataFrame(high, LOG)), ["route"], "ms").first()["over_bound"]
    assert not out["over_bound"]


def test_closed_windows_leave_the_state(spark, tmp_path):
    source, start = tmp_path / "log", datetime(2024, 1, 1)
    for k in range(6):  # files an hour apart
        rows = [(start + timedelta(hours=k, seconds=i), "/a", 200, 1.0, "LOW") for i in range(50)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(source))
    log = requests.request_log(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = (
        requests.class_counts(log, "stress_class").writeStream.outputMode("update").format("memory").queryName("closed_windows")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 6 and max(held) <= 3


class OneFileEach(Tables):
    def stream(self, name, **options):
        return super().stream(name, **options | {"maxFilesPerTrigger": 1})


@pytest.mark.parametrize("name", ["request_rate", "error_ratio", "p95_by_route", "class_counts"])
def test_files_out_of_order_lose_nothing(spark, tmp_path, name):
    start = datetime(2024, 1, 1)
    for k in (5, 0, 3, 1):  # hours; each file is a batch
        rows = [(start + timedelta(hours=k, seconds=9 * i), ("error", "view", None)[i % 3], float(i * 37 % 900)) for i in range(80)]
        rows += [(start + timedelta(hours=2), "view", 5.0 * k)]
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(0.02)
    batch = getattr(stream_queries, name)(Tables(spark, str(tmp_path)))
    stream = getattr(stream_queries, f"{name}_stream")(OneFileEach(spark, str(tmp_path)))
    assert sorted(map(str, stream.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


@pytest.fixture(scope="module")
def late_log(spark, tmp_path_factory):
    """Six files, each a batch: an hour, an hour later, the first hour again, and so on."""
    folder, start = tmp_path_factory.mktemp("late"), datetime(2024, 1, 1)
    for k, hour in enumerate((0, 1, 0, 3, 2, 4)):
        rows = [(start + timedelta(hours=hour, seconds=9 * i + k), ("error", "view", None)[i % 3], float(i * 37 % 900)) for i in range(80)]
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
        time.sleep(0.02)
    return str(folder)


@pytest.mark.parametrize(("count", "options"), [(stream_queries._classes, {}), (stream_queries._rate, {"minutes": 1})])
def test_late_rows_go_to_the_ledger_and_state_is_freed(spark, late_log, count, options):
    run = stream_queries.window_run(OneFileEach(spark, late_log), "late", count, **options)
    whole = count(requests.request_log(spark.read.parquet(f"{late_log}/events.parquet")))
    assert sorted(map(str, run.windows().select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    report = {r["batch"]: r for r in run.report().collect()}
    assert len(report) == 6 and sum(r["rows"] for r in report.values()) == 480
    assert {k for k, r in report.items() if r["late_counts"]} == {2, 4}  # files of hours that had closed
    assert all(r["dropped_rows"] == 0 for r in report.values())
    windows = whole.count()
    assert max(r["state_rows"] for r in report.values()) <= windows // 2 + 6  # open windows only, never all of the log
    assert run.late().count() > 0 and report[0]["closed_before"] is None


def test_a_batch_that_runs_again_adds_nothing(spark, late_log, tmp_path):
    log = requests.request_log(spark.read.parquet(f"{late_log}/events.parquet"))
    count = stream_queries._classes
    run = windows.WindowRun(spark, str(tmp_path / "run"), count(log).schema, ("window_start", "event_type"), timedelta(minutes=5), timedelta(minutes=10))
    hours = [log.filter(F.hour("ts") == h) for h in (1, 0)]
    for number, batch in enumerate([hours[0], hours[1]]):
        run.add(batch, number, count, "ts")
        run.add(batch, number, count, "ts")
    want = count(log.filter(F.hour("ts") < 2))
    assert sorted(map(str, run.windows().select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert [r["late_counts"] for r in run.report().orderBy("batch").collect()] == [0, 160]


def test_a_stream_without_files_has_no_windows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "none"))
    run = windows.run_windows(stream, str(tmp_path / "run"), lambda rows: stream_queries._classes(requests.request_log(rows)), ("window_start", "event_type"), width=timedelta(minutes=5))
    assert run.windows().count() == 0 and run.report().count() == 0


def test_hidden_routes_are_left_out(spark):
    rows = [(datetime(2024, 1, 1), r, 200, 1.0, "LOW") for r in ("/a", "/metrics/prometheus", None)]
    log = requests.request_log(spark.createDataFrame(rows, LOG), hidden=["/metrics/prometheus"])
    assert {r["route"] for r in log.collect()} == {"/a", None}


SCENE = "scene_id string, acquired timestamp, cloud_cover double, tile string, baseline string"


def scene(i, day, baseline="05.09", tile="43QDA"):
    return (f"S{i}", datetime(2024, 1, day), 5.0, tile, baseline)


def test_scene_batches(spark, tmp_path):
    log, feats, attempts = str(tmp_path / "log"), str(tmp_path / "feats"), []

    def extract(found):
        attempts.append(sorted(r["scene_id"] for r in found.select("scene_id").collect()))
        first_time = len(attempts) == 1
        cells = found.filter(F.col("scene_id") != "S3").select("scene_id", F.explode(F.array(F.lit("C1"), F.lit("C2"))).alias("cell_id"))
        return cells.withColumn("failed", (F.col("scene_id") == "S4") & F.lit(first_time))

    def run(rows, batch):
        scenes.process_batch(spark.createDataFrame(rows, SCENE), batch, log, feats, extract, date(2023, 10, 1))

    run([scene(1, 1), scene(2, 1, "05.10"), scene(3, 2), scene(4, 3)], 0)
    assert attempts[0] == ["S2", "S3", "S4"]  # S1 is an older copy of S2
    status = {r["scene_id"]: (r["status"], r["cells"]) for r in scenes.manifest_of(spark.read.parquet(log)).collect()}
    assert status == {"S2": ("complete", 2), "S3": ("no_clear_cells", 0), "S4": ("failed", 0)}
    run([scene(2, 1, "05.10"), scene(4, 3), scene(5, 4)], 1)
    assert attempts[1] == ["S4", "S5"]  # S2 is before the newest known date, S4 is retried
    run([scene(2, 1, "05.10"), scene(4, 3), scene(5, 4)], 1)  # the same batch again, after a restart
    assert attempts[2] == ["S4", "S5"]
    status = {r["scene_id"]: r["status"] for r in scenes.manifest_of(spark.read.parquet(log)).collect()}
    assert status == {"S2": "complete", "S3": "no_clear_cells", "S4": "complete", "S5": "complete"}
    assert spark.read.parquet(feats).groupBy("scene_id").count().filter("count = 2").count() == 3


def test_scene_stream_retries_and_backfills(spark, tmp_path):
    source, log, attempts = tmp_path / "items", str(tmp_path / "log"), []

    def extract(found):
        attempts.append(sorted(r["scene_id"] for r in found.select("scene_id").collect()))
        return found.select("scene_id", F.lit("C").alias("cell_id")).withColumn("failed", (F.col("scene_id") == "S4") & F.lit(len(attempts) < 3))

    def land(*rows):
        spark.createDataFrame(list(rows), SCENE).coalesce(1).write.mode("append").json(str(source))
        stream = scenes.item_stream(spark, str(source), SCENE)
        scenes.start(stream, log, str(tmp_path / "f"), str(tmp_path / "cp"), extract, date(2023, 1, 1)).awaitTermination()

    land(scene(4, 1), scene(5, 20, "05.10"))
    land(scene(4, 1), scene(5, 20, "05.10"), scene(1, 20, "05.09"))  # S1 is an older copy of what is complete
    old = ("S9", datetime(2023, 12, 1), 5.0, "43QDA", "05.09")
    land(scene(4, 1), old, scene(6, 2, tile=None), scene(7, 2, tile=None))
    land(scene(4, 1), old)
    assert attempts == [["S4", "S5"], ["S4"], ["S4", "S6", "S7", "S9"], []]
    status = {r["scene_id"]: r["status"] for r in scenes.manifest_of(spark.read.parquet(log)).collect()}
    assert status == dict.fromkeys(["S4", "S5", "S6", "S7", "S9"], "complete")


def test_a_failed_scene_is_tried_again_after_its_delay(spark, tmp_path):
    """Fails twice, is listed once, and succeeds by timers alone; a scene without failures is tried once."""
    source, tries = tmp_path / "items", []

    def extract(found):
        names = sorted(r["scene_id"] for r in found.select("scene_id").collect())
        if names:
            tries.append((time.monotonic(), names))
        failing = sum("S4" in n for _, n in tries) < 3
        return found.select("scene_id", F.lit("C").alias("cell_id")).withColumn("failed", (F.col("scene_id") == "S4") & F.lit(failing))

    spark.createDataFrame([scene(4, 1), scene(5, 2)], SCENE).coalesce(1).write.json(str(source))
    stream = scenes.item_stream(spark, str(source), SCENE)
    query = retries.start(spark, stream, str(tmp_path / "run"), extract, date(2023, 1, 1), first=1.0, longest=60.0, processingTime="500 milliseconds")
    try:
        limit, status = time.monotonic() + 200, {}
        while time.monotonic() < limit and query.isActive and status != {"S4": "complete", "S5": "complete"}:
            time.sleep(1)
            log = stored(spark, str(tmp_path / "run" / "log"))
            status = {} if log is None else {r["scene_id"]: r["status"] for r in scenes.manifest_of(log).collect()}
        assert query.exception() is None
    finally:
        query.stop()
    assert [n for _, n in tries] == [["S4", "S5"], ["S4"], ["S4"]]
    assert tries[1][0] - tries[0][0] >= 1.0 and tries[2][0] - tries[1][0] >= 2.0  # the delay doubles
    assert status == {"S4": "complete", "S5": "complete"}


def test_scoring_refreshes_touched_dates(spark, tmp_path):
    def rows(day, cells, ndwi, veg=True):
        return [(f"C{i}", date(2024, 1, day), ndwi, 35.0, 40.0, 0.0, 0.4 if veg else 0.1, veg, 2 if ndwi < 0 else 0) for i in cells]

    schema = "cell_id string, date date, ndwi_mean double, temp_max_c double, et0_8day_sum double, rainfall_8day double, ndvi_mean double, is_vegetated boolean, target_stress_class int"
    both = spark.createDataFrame(rows(1, range(20), -0.2) + rows(2, range(20), 0.2), schema)
    model = learn.train(both, "forest", FEATURES, "target_stress_class", SMALL)
    source = tmp_path / "in"
    view = kpi_view.KpiView(spark, str(tmp_path / "results"), str(tmp_path / "changes"))

    def land(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        scoring.start(stream, model, FEATURES, view, str(tmp_path / "cp")).awaitTermination()

    land(rows(1, range(3), -0.2) + rows(2, range(4), 0.2) + rows(2, [9], 0.2, veg=False))
    land(rows(2, [0, 7], -0.2))
    out = {r["cycle_date"]: r for r in view.kpis().collect()}
    assert (out[date(2024, 1, 1)]["active_cultivated_cells"], out[date(2024, 1, 1)]["high_stress_pct"]) == (3, 100.0)
    second = out[date(2024, 1, 2)]
    assert (second["total_culturable_cells"], second["active_cultivated_cells"], second["high_stress_pct"], second["low_stress_pct"]) == (6, 5, 40.0, 60.0)
    assert view.current().count() == 3 + 6
    changes = spark.read.parquet(view.changes).groupBy("batch").agg(F.collect_set("date").alias("d")).collect()
    assert {r["batch"]: len(r["d"]) for r in changes} == {0: 2, 1: 1}  # the second batch touched one date alone


def test_kpi_view_adds_and_takes_back(spark, tmp_path):
    schema = "date date, cell_id string, stress_code int, priority int, ndvi_mean double, ndwi_mean double, is_vegetated boolean"
    rng = np.random.default_rng(4)
    view = kpi_view.KpiView(spark, str(tmp_path / "results"), str(tmp_path / "changes"))
    now = {}
    for number in range(4):
        rows = [
            (date(2024, 1, int(d)), f"C{c}", int(rng.integers(0, 3)), int(rng.integers(1, 4)), float(rng.random()), None if rng.random() < 0.2 else float(rng.random()), bool(rng.random() < 0.7))
            for d in rng.choice(5, 3, replace=False) + 1 for c in rng.choice(12, 8, replace=False)
        ]
        now |= {r[:2]: r for r in rows}
        batch = spark.createDataFrame(rows, schema)
        view.add(batch, number)
        if number == 2:
            view.add(batch, number)  # again, after a failure
        want = kpi.cycle_kpis(spark.createDataFrame(list(now.values()), schema), vegetated=F.col("is_vegetated"))
        assert sorted(map(tuple, view.kpis().collect())) == sorted(map(tuple, want.collect()))
    assert view.current().count() == len(now)
