"""Block rasters as strips of lines against the pixel form and a direct formula."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolattice.operators import raster, strips
from hydrolattice.plans.registry import QUERIES
from hydrolattice.plans import raster_queries  # noqa: F401
from hydrolattice.sources.pixels import bands_to_columns, explode_blocks

DAY = date(2024, 1, 1)
SCHEMA = "scene_id string, date date, band string, row0 int, col0 int, px array<array<float>>"


def cut(band, values, row0, col0, heights, widths):
    """Blocks of the given heights and widths over an array of values."""
    out, r = [], 0
    for h in heights:
        c = 0
        for w in widths:
            part = values[r : r + h, c : c + w]
            out.append(("S", DAY, band, row0 + r, col0 + c, [[None if np.isnan(v) else float(v) for v in line] for line in part]))
            c += w
        r += h
    return out


def scene_blocks(seed=5, hole=True):
    """Blocks of unlike shapes: 12 x 14 fine pixels from (4, 6), over 6 x 7 coarse ones from (2, 3)."""
    rng = np.random.default_rng(seed)
    rows = []
    for band in strips.FINE:
        rows += cut(band, rng.integers(500, 4000, (12, 14)).astype(float), 4, 6, (5, 7), (14,) if band == "B02" else (3, 4, 7))
    for band in (*strips.SMOOTH, "SCL"):
        values = rng.integers(1, 9, (6, 7)).astype(float) * (1 if band == "SCL" else 100)
        if hole and band == "B11":
            values[2, 3] = np.nan
        rows += cut(band, values, 2, 3, (1, 2, 3), (2, 5))
    return rows


@pytest.mark.parametrize("columns", [2, 3, 1024])
def test_strips_equal_the_pixel_form(spark, columns):
    blocks = spark.createDataFrame(scene_blocks(), SCHEMA).repartition(4)
    scenes = spark.createDataFrame([("S", "05.10")], "scene_id string, baseline string")
    long = explode_blocks(blocks)
    wide = [bands_to_columns(long.filter(F.col("band").isin(*bands)), bands=bands) for bands in (strips.FINE, (*strips.SMOOTH, "SCL"))]
    names = ["scene_id", "date", "row", "col", "b02", "b03", "b04", "b08", "b11", "b12", "scl", "offset"]
    want = sorted(map(tuple, raster.raw_pixels(*wide, scenes, scene=["scene_id", "date"]).select(names).collect()), key=repr)
    got = sorted(map(tuple, strips.block_pixels(blocks, scenes, columns=columns).select(names).collect()), key=repr)
    assert len(want) == 12 * 14
    for a, b in zip(want, got, strict=True):
        assert a[:8] == b[:8] and a[10:] == b[10:]
        for x, y in zip(a[8:10], b[8:10], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9))


def test_missing_bands_and_pixels_outside(spark):
    rows = [("S", DAY, "B02", 0, 0, [[1.0, None], [], [3.0, 4.0]]), ("S", DAY, "B11", 0, 0, [[100.0, 200.0, 300.0], [50.0]]), ("S", DAY, "B99", 0, 0, [[7.0]])]
    scenes = spark.createDataFrame([("S", "02.14")], "scene_id string, baseline string")
    found = {(r["row"], r["col"]): r for r in strips.block_pixels(spark.createDataFrame(rows, SCHEMA), scenes).collect()}
    assert sorted(found) == [(0, 0), (0, 1), (2, 0), (2, 1)]  # an empty line covers nothing
    assert found[0, 1]["b02"] is None and found[0, 0]["b03"] is None and found[0, 0]["scl"] is None
    assert (found[0, 0]["b11"], found[0, 1]["b11"], found[2, 1]["b11"]) == (100.0, 125.0, 50.0 * 0.75 + 125.0 * 0.25)
    assert strips.block_pixels(spark.createDataFrame([], SCHEMA), scenes).count() == 0


def test_overlapping_blocks_count_once(spark):
    rows = [("S", DAY, "B02", 0, 0, [[1.0, 2.0, 3.0]]), ("S", DAY, "B02", 0, 1, [[9.0, 9.0, 9.0]])]
    scenes = spark.createDataFrame([("S", "02.14")], "scene_id string, baseline string")
    out = strips.block_pixels(spark.createDataFrame(rows, SCHEMA), scenes).select("col", "b02").collect()
    assert sorted(map(tuple, out)) == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 9.0)]


def test_a_scene_without_a_baseline_fails(spark):
    blocks = spark.createDataFrame(scene_blocks(), SCHEMA)
    with pytest.raises(Exception, match="baseline is missing"):
        strips.block_pixels(blocks, spark.createDataFrame([], "scene_id string, baseline string")).collect()


def test_no_single_pixel_is_shuffled(spark):
    """The query's exchanges carry blocks, line pieces or partial sums: none hashes a row and a column, and no window runs over pixels."""
    plan = QUERIES["satellite_features"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("col#" in e for e in exchanges)
    assert "Window" not in plan


def test_features_of_blocks_equal_those_of_pixels(spark):
    blocks = spark.createDataFrame(scene_blocks(hole=False), SCHEMA)
    scenes = spark.createDataFrame([("S", "05.10")], "scene_id string, baseline string")
    cells = spark.createDataFrame([(f"C{x}{y}", x, y, 74.0, 18.0) for x in range(5) for y in range(5)], "cell_id string, ix long, iy long, centroid_lon double, centroid_lat double")
    long = explode_blocks(blocks)
    wide = [bands_to_columns(long.filter(F.col("band").isin(*bands)), bands=bands) for bands in (strips.FINE, (*strips.SMOOTH, "SCL"))]
    place = dict(offset="offset", origin_y=200.0, pixel=10.0, cell=50.0)
    want = sorted(map(tuple, raster.scene_features(raster.raw_pixels(*wide, scenes), cells, **place).collect()))
    got = sorted(map(tuple, raster.scene_features(strips.block_pixels(blocks, scenes), cells, **place).collect()))
    assert want and len(got) == len(want)
    for a, b in zip(want, got, strict=True):
        assert all(x == y or x == pytest.approx(y, abs=1.1e-1 if isinstance(x, float) and abs(x) > 10 else 1.1e-4) for x, y in zip(a, b, strict=True))
