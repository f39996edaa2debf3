from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolattice.functions import geodesy, geometry, spectral
from hydrolattice.operators import grid, raster
from hydrolattice.sources.pixels import bands_to_columns, explode_blocks

BANDS = {"b02": 100.0, "b03": 200.0, "b04": 300.0, "b08": 400.0, "b11": 500.0, "b12": 600.0}


def square_raster(spark, clear, n=20):
    """An n x n raster of 10 m pixels with constant indices; ``clear(row, col)`` says which pixels are clear."""
    rows = [(r, c, bool(clear(r, c))) for r in range(n) for c in range(n)]
    df = spark.createDataFrame(rows, "row int, col int, clear boolean").withColumns({k: F.lit(v) for k, v in BANDS.items()})
    return df.withColumns({"scene_id": F.lit("SCENE"), "ndvi": F.lit(0.5), "ndwi": F.lit(0.1), "evi": F.lit(0.3)})


def zonal(pixels, cell=200.0, **place):
    paired = raster.pixel_cells(pixels, origin_y=200.0, pixel=10.0, cell=cell, **place)
    return raster.zonal_statistics(paired, keys=("scene_id", "ix", "iy"))


def test_cloudy_half_is_left_out(spark):
    row = zonal(square_raster(spark, lambda r, c: r >= 10)).first()
    assert (row["valid_pixel_pct"], row["ndvi_mean"], row["b08_mean"], row["ndvi_std"]) == (50.0, 0.5, 400.0, 0.0)


def test_few_clear_pixels_drop_the_cell(spark):
    assert zonal(square_raster(spark, lambda r, c: r == 0 and c < 4)).count() == 0
    assert zonal(square_raster(spark, lambda r, c: r == 0 and c < 5)).count() == 1


@pytest.mark.parametrize(("cell", "gx", "gy"), [(50.0, 0.0, 0.0), (37.0, 3.0, -5.0), (64.0, -11.0, 7.0)])
def test_zonal_matches_array_windows(spark, cell, gx, gy):
    """Unaligned cells against floor/ceil windows over an array."""
    n = 20
    rng = np.random.default_rng(7)
    value, clear = rng.normal(0.3, 0.2, (n, n)), rng.random((n, n)) < 0.6
    rows = [(r, c, bool(clear[r, c]), float(value[r, c])) for r in range(n) for c in range(n)]
    df = spark.createDataFrame(rows, "row int, col int, clear boolean, ndvi double").withColumns(
        {k: F.lit(v) for k, v in BANDS.items()} | {"scene_id": F.lit("S"), "ndwi": F.lit(0.1), "evi": F.lit(0.2)}
    )
    got = {(r["ix"], r["iy"]): r for r in zonal(df, cell, grid_x=gx, grid_y=gy).collect()}
    want = {}
    for ix in range(-2, 30):
        for iy in range(-2, 30):
            x0, y0 = gx + ix * cell, gy + iy * cell
            if x0 >= 200 or y0 >= 200 or x0 + cell <= 0 or y0 + cell <= 0:
                continue
            c0, c1 = max(0, int(np.floor(x0 / 10))), min(n, int(np.ceil((x0 + cell) / 10)))
            r0, r1 = max(0, int(np.floor((200 - y0 - cell) / 10))), min(n, int(np.ceil((200 - y0) / 10)))
            inside = clear[r0:r1, c0:c1]
            if inside.sum() >= 5:
                v = value[r0:r1, c0:c1][inside]
                want[ix, iy] = (round(inside.sum() / inside.size * 100, 2), v.mean(), v.std())
    assert set(got) == set(want)
    for k, (pct, mean, std) in want.items():
        assert got[k]["valid_pixel_pct"] == pytest.approx(pct, abs=0.0051)
        assert got[k]["ndvi_mean"] == pytest.approx(mean, abs=5.1e-5)
        assert got[k]["ndvi_std"] == pytest.approx(std, abs=5.1e-5)


def test_indices_and_offsets(spark):
    raw = spark.createDataFrame([(4, 1300, 1500, 4000, 3000), (9, 1300, 1500, 4000, 3000), (4, 0, 500, 900, 1000)], "scl int, b02 int, b04 int, b08 int, b11 int")
    out = raster.with_indices(raw, bands=("b02", "b04", "b08", "b11"), offset=-1000.0).collect()
    assert out[0]["ndvi"] == pytest.approx(2500 / 3500, abs=1e-3)
    assert out[1]["ndvi"] is None and not out[1]["clear"]
    assert out[2]["b04"] == 0.0 and out[2]["ndvi"] is None and out[2]["clear"]  # clear, but no denominator
    values = spark.createDataFrame([(0,), (500,), (1500,), (None,)], "v int").select(spectral.remove_offset("v", -1000.0)).collect()
    assert [r[0] for r in values] == [0.0, 0.0, 500.0, None]


def test_scene_features_and_overlaps(spark):
    pixels = square_raster(spark, lambda r, c: True).drop("clear", "ndvi", "ndwi", "evi").withColumns({"scl": F.lit(4), "date": F.lit(date(2024, 1, 1))})
    both = pixels.unionByName(pixels.withColumns({"scene_id": F.lit("ALPHA"), "b08": F.lit(800.0)}))
    cells = spark.createDataFrame([("C1", 0, 0, 74.0, 18.0)], "cell_id string, ix long, iy long, centroid_lon double, centroid_lat double")
    per_scene = raster.scene_features(both, cells, origin_y=200.0, pixel=10.0, cell=100.0)
    assert per_scene.count() == 2
    row = raster.merge_overlaps(per_scene).first()
    assert (row["b08_mean"], row["scene_id"], row["cell_id"], row["valid_pixel_pct"]) == (600.0, "ALPHA", "C1", 100.0)


def test_raw_bands_are_corrected_by_their_baseline(spark):
    fine = spark.createDataFrame([(s, date(2024, 1, 1), r, c, 1500.0, 1500.0, 1500.0, 4000.0) for s in ("OLD", "NEW") for r in range(4) for c in range(4)], "scene_id string, date date, row int, col int, b02 double, b03 double, b04 double, b08 double")
    coarse = spark.createDataFrame([(s, date(2024, 1, 1), r, c, 2000.0, 2500.0, 4) for s in ("OLD", "NEW") for r in range(2) for c in range(2)], "scene_id string, date date, row int, col int, b11 double, b12 double, scl int")
    scenes = spark.createDataFrame([("OLD", "02.14"), ("NEW", "05.10")], "scene_id string, baseline string")
    cells = spark.createDataFrame([("C1", 0, 0, 74.0, 18.0)], "cell_id string, ix long, iy long, centroid_lon double, centroid_lat double")
    raw = raster.raw_pixels(fine, coarse, scenes)
    found = {r["scene_id"]: r for r in raster.scene_features(raw, cells, offset="offset", origin_y=40.0, pixel=10.0, cell=40.0).collect()}
    assert found["NEW"]["ndvi_mean"] == pytest.approx((3000 - 500) / (3000 + 500), abs=1e-4) and found["NEW"]["b11_mean"] == 1000.0
    assert found["OLD"]["ndvi_mean"] == pytest.approx((4000 - 1500) / (4000 + 1500), abs=1e-4)
    with pytest.raises(Exception, match="baseline is missing"):
        raster.raw_pixels(fine, coarse, scenes.filter("scene_id = 'OLD'")).collect()


def test_pixels_of_an_area_meet_its_own_cells(spark):
    pixels = square_raster(spark, lambda r, c: True).drop("clear", "ndvi", "ndwi", "evi").withColumns({"scl": F.lit(4), "date": F.lit(date(2024, 1, 1)), "area_id": F.lit("A")})
    cells = spark.createDataFrame([("A", "C1", 0, 0, 74.0, 18.0), ("B", "C2", 0, 0, 75.0, 18.0)], "area_id string, cell_id string, ix long, iy long, centroid_lon double, centroid_lat double")
    assert [r["cell_id"] for r in raster.scene_features(pixels, cells, origin_y=200.0, pixel=10.0, cell=100.0).collect()] == ["C1"]


def test_ids_of_several_areas_differ(spark):
    areas = box_area(spark, 0.0, 0.0, 700.0, 500.0).unionByName(box_area(spark, 0.0, 0.0, 500.0, 500.0).withColumn("area_id", F.lit("ZZ")))
    ids = [r["cell_id"] for r in grid.spatial_grid(areas, cell_size=250.0, central_meridian=None).collect()]
    assert len(ids) == 10 and len(set(ids)) == 10


def test_bilinear_matches_direct_formula(spark):
    rng = np.random.default_rng(2)
    h, w = 5, 6
    v = rng.random((h, w))
    df = spark.createDataFrame([("S", r, c, float(v[r, c])) for r in range(h) for c in range(w)], "scene_id string, row int, col int, b11 double")
    got = {(r["row"], r["col"]): r["b11"] for r in raster.resample_bilinear(df, ["b11"]).collect()}
    assert len(got) == 4 * h * w
    for (r, c), value in got.items():
        y, x = (r + 0.5) / 2 - 0.5, (c + 0.5) / 2 - 0.5
        top, left = int(np.floor(y)), int(np.floor(x))
        num = den = 0.0
        for i in (top, top + 1):
            for j in (left, left + 1):
                if 0 <= i < h and 0 <= j < w:
                    weight = (1 - abs(y - i)) * (1 - abs(x - j))
                    num, den = num + weight * v[i, j], den + weight
        assert value == pytest.approx(num / den, abs=1e-12)


def test_window_rounding(spark):
    one = spark.range(1)
    exact = one.select(*[v.alias(k) for k, v in raster.window_of(F.lit(15.0), F.lit(25.0), F.lit(95.0), F.lit(101.0), F.lit(0.0), F.lit(200.0), 10.0).items()]).first()
    assert (exact["col_from"], exact["col_to"], exact["row_from"], exact["row_to"]) == (1, 10, 9, 18)


def test_blocks_become_pixels(spark):
    rows = [("S", date(2024, 1, 1), b, 10, 20, [[1.0, 2.0], [3.0, 4.0]]) for b in ("B04", "SCL")]
    blocks = spark.createDataFrame(rows, "scene_id string, date date, band string, row0 int, col0 int, px array<array<float>>")
    wide = bands_to_columns(explode_blocks(blocks), bands=("B04", "SCL")).orderBy("row", "col").collect()
    assert [(r["row"], r["col"], r["b04"], r["scl"]) for r in wide] == [(10, 20, 1.0, 1), (10, 21, 2.0, 2), (11, 20, 3.0, 3), (11, 21, 4.0, 4)]


def test_utm_reference_points(spark):
    # The zone's meridian maps to the false easting, and the equator to northing 0.
    df = spark.createDataFrame([(75.0, 0.0), (75.0, 18.0), (74.25, 18.35), (76.9, 17.2)], "lon double, lat double")
    east, north = geodesy.to_utm("lon", "lat")
    rows = df.select("lon", "lat", east.alias("e"), north.alias("n")).collect()
    assert (rows[0]["e"], rows[0]["n"]) == (pytest.approx(500000.0, abs=1e-6), pytest.approx(0.0, abs=1e-6))
    # Meridian arc to 18 degrees by numeric integration.
    a, e2 = 6378137.0, (1 / 298.257223563) * (2 - 1 / 298.257223563)
    phi = np.linspace(0, np.radians(18.0), 200001)
    radius = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = np.trapezoid(radius, phi) * 0.9996
    assert rows[1]["n"] == pytest.approx(arc, abs=1e-3)
    lon, lat = geodesy.from_utm("e", "n")
    back = df.select("lon", "lat", east.alias("e"), north.alias("n")).select("lon", "lat", lon.alias("x"), lat.alias("y")).collect()
    for r in back:
        assert (r["x"], r["y"]) == (pytest.approx(r["lon"], abs=1e-9), pytest.approx(r["lat"], abs=1e-9))


def box_area(spark, minx, miny, maxx, maxy, area="A"):
    ring = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)]
    df = spark.createDataFrame([(area, [{"x": float(x), "y": float(y)} for x, y in ring])], "area_id string, ring array<struct<x:double,y:double>>")
    return df.select("area_id", geometry.ring_edges("ring").alias("edges"))


def test_lattice_covers_the_area(spark):
    rows = grid.weather_lattice(box_area(spark, 74.0, 18.0, 74.3, 18.2), spacing=0.1).collect()
    assert len(rows) >= 12 and len({r["weather_point_id"] for r in rows}) == len(rows)
    assert all(73.9 <= r["longitude"] <= 74.4 for r in rows)
    first = min(rows, key=lambda r: r["weather_point_id"])
    assert first["weather_point_id"] == "WX_000" and first["latitude"] == min(r["latitude"] for r in rows)


def test_grid_order_and_ids(spark):
    rows = grid.spatial_grid(box_area(spark, 0.0, 0.0, 700.0, 500.0), cell_size=250.0, central_meridian=None, id_prefix="G").collect()
    ids = {r["cell_id"]: (r["ix"], r["iy"]) for r in rows}
    assert len(ids) == 6
    assert [ids[f"G_{i:04d}"] for i in range(1, 7)] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_grid_leaves_out_holes_and_outside(spark):
    """An L shape with a hole: boxes fully in the hole or outside are not cells."""
    outer = [(0, 0), (1000, 0), (1000, 400), (400, 400), (400, 1000), (0, 1000)]
    hole = [(110, 110), (290, 110), (290, 290), (110, 290)]
    rings = [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in (outer, hole)]
    df = spark.createDataFrame([("A", rings)], "area_id string, rings array<array<struct<x:double,y:double>>>")
    areas = df.select("area_id", geometry.shape_edges("rings").alias("edges"))
    cells = {(r["ix"], r["iy"]) for r in grid.spatial_grid(areas, cell_size=50.0, central_meridian=None).collect()}
    assert (3, 3) not in cells and (4, 4) not in cells  # 150-250 lies in the hole
    assert (2, 2) in cells and (15, 15) not in cells and (15, 3) in cells and (3, 15) in cells
    assert (8, 8) in cells  # touches the inner corner
    assert (9, 9) not in cells


def test_bands_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 2.5, 3)], "v double")
    out = {r["v"]: r["reach"] for r in grid.equal_width_bands(df, "v").collect()}
    assert out == {0.0: "head", 1.0: "head", 2.0: "middle", 2.5: "tail", 3.0: "tail"}
    same = grid.equal_width_bands(spark.createDataFrame([(5.0,), (None,)], "v double"), "v").collect()
    assert sorted(str(r["reach"]) for r in same) == ["None", "middle"]


def test_empty_result_raises(spark):
    with pytest.raises(ValueError, match="no weather points"):
        grid.require_rows(spark.range(0), "no weather points")
