from __future__ import annotations

import hashlib
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hydrolattice.functions.scene_names import path_date, path_scene, scene_tile
from hydrolattice.functions.spectral import baseline_offset
from hydrolattice.operators import manifest
from hydrolattice.plans import scene_queries  # noqa: F401
from hydrolattice.plans.registry import QUERIES
from hydrolattice.settings import BANDS
from hydrolattice.sources.catalogue import list_band_files, read_items

MANIFEST = "scene_id string, acquisition_date date, status string"


def test_upsert_keeps_old_and_replaces_retried(spark):
    old = spark.createDataFrame([("S1", date(2024, 1, 1), "failed"), ("S0", date(2024, 1, 1), "complete")], MANIFEST)
    new = spark.createDataFrame([("S1", date(2024, 1, 1), "complete"), ("S2", date(2024, 1, 6), "found")], MANIFEST)
    rows = manifest.chronological(manifest.upsert(old, new)).collect()
    assert [(r["scene_id"], r["status"]) for r in rows] == [("S0", "complete"), ("S1", "complete"), ("S2", "found")]


def test_keep_last_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = manifest.keep_last(df, "k", [F.col("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_resume_point(spark):
    one = spark.createDataFrame([("S1", date(2024, 3, 29), "failed")], MANIFEST)
    two = spark.createDataFrame([("S2", date(2024, 4, 3), "complete")], MANIFEST)
    none = spark.createDataFrame([], MANIFEST)
    start = date(2023, 10, 1)
    assert manifest.resume_point(one, two, default=start).first()[0] == date(2024, 4, 3)
    assert manifest.resume_point(none, one, default=start).first()[0] == date(2024, 3, 29)
    assert manifest.resume_point(none, default=start).first()[0] == start


def test_completeness_from_files(spark, tmp_path):
    for scene, bands in (("2024-01-01_FULL", BANDS), ("2024-01-02_SHORT", BANDS[1:])):
        folder = tmp_path / scene
        folder.mkdir()
        for band in bands:
            (folder / f"{band}.tif").write_bytes(b"0" * 2000)
    tiny = tmp_path / "2024-01-03_TINY"
    tiny.mkdir()
    for band in BANDS:
        (tiny / f"{band}.tif").write_bytes(b"0" * 1000)
    files = list_band_files(spark, str(tmp_path))
    done = {r["scene_dir"]: r["complete"] for r in manifest.scene_completeness(files).collect()}
    assert done == {"2024-01-01_FULL": True, "2024-01-02_SHORT": False, "2024-01-03_TINY": False}
    assert files.filter(F.col("scene_id") == "FULL").select("date").first()[0] == "2024-01-01"


def test_latest_copy_and_offsets(spark):
    items = spark.createDataFrame(
        [("old_copy", "2024-01-01", "43QDA", "05.09", 1), ("new_copy", "2024-01-01", "43QDA", "05.10", 2), ("other", "2024-01-01", "43QDV", "02.14", 3), ("same", "2024-01-01", "43QDV", "02.14", 4)],
        "id string, day string, tile string, baseline string, seq int",
    )
    kept = manifest.latest_copies(items, keys=["day", "tile"], baseline="baseline", sequence=["seq"])
    assert {r["id"] for r in kept.collect()} == {"new_copy", "other"}
    offsets = {r["id"]: r["o"] for r in items.select("id", baseline_offset("baseline").alias("o")).collect()}
    assert offsets["new_copy"] == -1000.0 and offsets["other"] == 0.0
    with pytest.raises(Exception, match="baseline is missing"):
        spark.createDataFrame([(None,)], "b string").select(baseline_offset("b")).collect()


def test_names(spark):
    df = spark.createDataFrame(
        [("S2A_MSIL2A_T43QDA_x", None, "2024-01-01_S1"), ("a_43qdv_b", "", "short"), ("nothing", None, "2024-01-01_"), ("x_T43QDA", "TT43QZZ", "2024-01-011")],
        "id string, prop string, folder string",
    )
    rows = df.select(scene_tile("prop", "id").alias("t"), path_date("folder").alias("d"), path_scene("folder").alias("s")).collect()
    assert [r["t"] for r in rows] == ["43QDA", "43QDV", None, "43QZZ"]
    assert [r["s"] for r in rows] == ["S1", "short", "2024-01-01_", "2024-01-011"]
    assert rows[0]["d"] == "2024-01-01"


def test_catalogue_items(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"id": "S_T43QDA_1", "properties": {"datetime": "2024-01-02T05:30:00Z", "eo:cloud_cover": 3.5, "s2:processing_baseline": "05.09"}}\n'
        '{"id": "S_2", "properties": {"datetime": "2024-01-03T05:30:00Z", "s2:high_proba_clouds_percentage": 14.0}}\n'
        '{"id": "S_T44QAA_3", "properties": {"datetime": "2024-01-04T05:30:00Z", "eo:cloud_cover": 1.0}}\n'
        '{"id": "S_T43QDA_4", "properties": {"datetime": "2024-01-05T05:30:00Z"}}\n'
    )
    items = read_items(spark, str(tmp_path / "a.json"))
    kept = manifest.usable_scenes(items, tiles=["T43QDA"]).orderBy("scene_id").collect()
    assert [r["scene_id"] for r in kept] == ["S_2", "S_T43QDA_1"]  # an unknown tile passes, unknown cloud does not
    assert manifest.usable_scenes(items, tiles=["43QDA"], start=date(2024, 1, 3)).count() == 1


def test_pending_order_and_limit(spark):
    scenes = spark.createDataFrame([(f"S{i}", date(2024, 1, i), "found") for i in range(1, 6)], MANIFEST)
    known = spark.createDataFrame([("S5", date(2024, 1, 5), "complete")], MANIFEST)
    assert [r["scene_id"] for r in manifest.pending(scenes, known, newest_first=True, limit=2).collect()] == ["S4", "S3"]
    assert [r["scene_id"] for r in manifest.pending(scenes, known).collect()] == ["S1", "S2", "S3", "S4"]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("v"))
    same = df.repartition(7).orderBy(F.col("id").desc())
    changed = df.withColumn("v", F.when(F.col("id") == 500, 1).otherwise(F.col("v")))
    first = manifest.fingerprint(df).first()
    assert first == manifest.fingerprint(same).first()
    assert first["content"] != manifest.fingerprint(changed).first()["content"]


def test_whole_fingerprint_equals_a_direct_one_and_sees_every_column(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(300).cache()

    def fingerprint(df):
        return QUERIES["whole_content_fingerprint"].run(SimpleNamespace(read=SimpleNamespace(parquet=lambda path: df)), "").first()

    total = 0
    for row in lines.collect():
        texts = ["-" if row[c] is None else f"={row[c]}" for c in sorted(lines.columns)]
        total += int(hashlib.md5("\x1f".join(texts).encode()).hexdigest()[:15], 16)
    first = fingerprint(lines)
    assert tuple(first) == (300, str(total))
    one = (F.col("l_orderkey") == lines.first()["l_orderkey"]) & (F.col("l_linenumber") == lines.first()["l_linenumber"])
    for name, kind in lines.dtypes:
        other = {"string": F.lit("?"), "timestamp": F.lit("1970-01-01").cast("timestamp"), "timestamp_ntz": F.lit("1970-01-01").cast("timestamp_ntz")}.get(kind, F.lit(-1).cast(kind))
        assert fingerprint(lines.withColumn(name, F.when(one, other).otherwise(F.col(name))))["content"] != first["content"], name
