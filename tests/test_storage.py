"""The scene cache, bucketed tables and checks collected while writing."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hydrolattice.operators import quality
from hydrolattice.plans import scene_queries
from hydrolattice.plans.registry import Tables
from hydrolattice.settings import BANDS
from hydrolattice.sources import scene_cache, tables
from hydrolattice.sources.scene_cache import SceneCache, ingest

ITEM = "scene_id string, acquired timestamp, cloud_cover double, tile string, baseline string"


def item(name, day, tile="43QDA", baseline="05.10", cloud=5.0):
    return (name, datetime(2024, 1, day), cloud, tile, baseline)


@pytest.fixture
def landed(spark):
    items = spark.createDataFrame([item("S1", 1), item("S2", 2), item("S2old", 2, baseline="05.09"), item("S3", 3), item("S4", 4, cloud=90.0), item("S5", 5)], ITEM)
    files = spark.createDataFrame([(s, b, 5000) for s in ("S1", "S2", "S2old", "S4", "S5") for b in BANDS] + [("S3", b, 10) for b in BANDS], "scene_id string, band string, length long")
    return items, files


def extract(scenes):
    cells = scenes.filter("scene_id <> 'S5'").select("scene_id", F.explode(F.array(F.lit("C1"), F.lit("C2"))).alias("cell_id"))
    return cells.withColumn("failed", F.col("scene_id") == "S2")


def status(cache):
    return {r["scene_id"]: (r["status"], r["version"]) for r in cache.snapshot().collect()}


def test_ingest_from_catalogue_to_cache(spark, landed, tmp_path):
    items, files = landed
    cache, seen = SceneCache(spark, str(tmp_path)), []

    def watched(scenes):
        seen.append(sorted(r["scene_id"] for r in scenes.collect()))
        return extract(scenes)

    assert cache.features() is None and cache.snapshot().count() == 0
    assert ingest(cache, items, files, watched, "v1") == 0
    assert status(cache) == {"S1": ("complete", "v1"), "S2": ("failed", "v1"), "S3": ("incomplete", "v1"), "S5": ("no_clear_cells", "v1")}
    whole = files.filter("scene_id <> 'S3'").unionByName(files.filter("scene_id = 'S3'").withColumn("length", F.lit(9000).cast("long")))
    assert ingest(cache, items, whole, lambda s: watched(s).withColumn("failed", F.lit(False)), "v1") == 1
    assert seen == [["S1", "S2", "S5"], ["S2", "S3"]]  # what is done is not done again
    assert status(cache)["S2"] == status(cache)["S3"] == ("complete", "v1")
    assert sorted((r["scene_id"], r["cell_id"]) for r in cache.features().collect()) == [(s, c) for s in ("S1", "S2", "S3") for c in ("C1", "C2")]
    assert {r["scene_id"] for r in cache.features(0).collect()} == {"S1"}  # an older snapshot still reads
    ingest(cache, items.filter("scene_id = 'S1'"), whole, watched, "v2")
    assert seen[-1] == ["S1"] and status(cache)["S1"] == ("complete", "v2") and cache.features().count() == 6


def test_scenes_to_do_are_worked_out_once(spark, landed, tmp_path):
    """What is extracted and what is committed come from one kept table, not from the catalogue and the files again."""
    items, files = landed
    read = []

    def watched(scenes):
        read.extend(scenes.inputFiles())
        return extract(scenes)

    ingest(SceneCache(spark, str(tmp_path)), items, files, watched, "v1")
    assert read and all("/staged/todo-" in f for f in read)


@pytest.mark.parametrize("step", ["_write_snapshot", "_point"])
def test_a_commit_that_breaks_off_shows_nothing(spark, landed, tmp_path, monkeypatch, step):
    items, files = landed
    cache = SceneCache(spark, str(tmp_path))
    ingest(cache, items.filter("scene_id = 'S1'"), files, extract, "v1")
    before = status(cache)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(scene_cache.SceneCache, step, broken)
        with pytest.raises(RuntimeError):
            ingest(cache, items, files, extract, "v1")
    assert status(cache) == before and {r["scene_id"] for r in cache.features().collect()} == {"S1"}
    ingest(cache, items, files, extract, "v1")
    assert status(cache)["S5"] == ("no_clear_cells", "v1") and cache.features().count() == 2


def test_bucketed_tables_join_without_an_exchange(spark):
    pair = scene_queries.bucketed_pair(Tables(spark, "/root/testdata/sf0.001"), buckets=4)
    plan = pair._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    grouped = pair.groupBy("order_key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in grouped


def test_partitions_of_a_bucketed_table_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(f"C{i % 5}", date(2024, 1, 1 + i % 6), float(i)) for i in range(60)], "cell_id string, date date, v double")
    stored = tables.write_bucketed(rows, "pruned_rows", str(tmp_path / "rows"), ["cell_id"], 4, ["date"])
    one = stored.filter(F.col("date") == F.lit(date(2024, 1, 2)))
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 10 and len(one.inputFiles()) <= 4
    spark.sql("DROP TABLE pruned_rows")


def test_checks_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, "a"), (99.0, None), (None, "b")], "x double, y string")
    checks = {r["check"]: r for r in quality.checked_write(rows, str(tmp_path / "t"), {"x": (0, 50)}, ["x", "y"], 0.5).collect()}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert not checks["value_ranges"]["passed"] and checks["value_ranges"]["offending"] == ["x=1"] and checks["missing_values"]["passed"]
    same = quality.value_range_check(rows, {"x": (0, 50)}).unionAll(quality.missing_value_check(rows, ["x", "y"], 0.5))
    assert sorted(map(str, same.collect())) == sorted(map(str, checks.values()))
    empty = quality.checked_write(rows.limit(0), str(tmp_path / "e"), {"x": (0, 50)}, ["x"], 0.5).collect()
    assert len(empty) == 2
