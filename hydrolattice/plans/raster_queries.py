"""Pixels, cells and grids. Line items and parts are read as pixels, suppliers and customers as places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy
from ..functions.geometry import ring_edges
from ..functions.numeric import round_even
from ..operators import grid, raster, strips
from ..operators.nearest import nearest_points
from .registry import Tables, query, r

# Line items as 10 m pixels of a scene per ship month; cells of 75 m do not line up with the pixels.
PIXEL, CELL, WIDTH = 10.0, 75.0, 200


def line_pixels(t: Tables) -> DataFrame:
    """One pixel per (scene, part position, supplier position), whole digital numbers, the highest where line items share it."""
    lines = t.lineitem.withColumns({
        "scene_id": F.date_format("l_shipdate", "yyyy-MM"), "row": (F.col("l_partkey") % WIDTH).cast("int"), "col": (F.col("l_suppkey") % WIDTH).cast("int"),
    })
    raw = {
        "b02": F.col("l_tax") * 20000 + 900, "b03": F.col("l_tax") * 30000 + 900, "b04": F.col("l_discount") * 25000 + 800,
        "b08": F.col("l_quantity") * 80, "b11": F.col("l_extendedprice") / 40, "b12": F.col("l_extendedprice") / 50,
    }
    pixels = lines.withColumns(raw).groupBy("scene_id", "row", "col").agg(
        *[F.round(F.max(b)).alias(b) for b in raw], F.max("l_linenumber").alias("scl")
    )
    return raster.with_indices(pixels.withColumn("date", F.to_date(F.concat("scene_id", F.lit("-01")))), offset=-1000.0)


PIXELS_SQL = """
raw AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS scene_id, (l_partkey % 200)::INTEGER AS "row", (l_suppkey % 200)::INTEGER AS col,
    round(max(l_tax * 20000 + 900)) AS b02, round(max(l_tax * 30000 + 900)) AS b03, round(max(l_discount * 25000 + 800)) AS b04,
    round(max(l_quantity * 80)) AS b08, round(max(l_extendedprice / 40)) AS b11, round(max(l_extendedprice / 50)) AS b12, max(l_linenumber) AS scl
  FROM lineitem GROUP BY 1, 2, 3),
band AS (
  SELECT scene_id, "row", col, scl IN (4, 5, 6, 7) AS clear, greatest(b02 - 1000, 0) AS b02, greatest(b03 - 1000, 0) AS b03, greatest(b04 - 1000, 0) AS b04,
    greatest(b08 - 1000, 0) AS b08, greatest(b11 - 1000, 0) AS b11, greatest(b12 - 1000, 0) AS b12 FROM raw),
pixel AS (
  SELECT *,
    CASE WHEN clear AND b08 / 1e4 + b04 / 1e4 > 0 THEN least(greatest((b08 / 1e4 - b04 / 1e4) / (b08 / 1e4 + b04 / 1e4 + 1e-6), -1), 1) END AS ndvi,
    CASE WHEN clear AND b08 / 1e4 + b11 / 1e4 > 0 THEN least(greatest((b08 / 1e4 - b11 / 1e4) / (b08 / 1e4 + b11 / 1e4 + 1e-6), -1), 1) END AS ndwi,
    CASE WHEN clear AND b08 / 1e4 + 6 * (b04 / 1e4) - 7.5::DOUBLE * (b02 / 1e4) + 1 > 0 THEN least(greatest(
      2.5::DOUBLE * (b08 / 1e4 - b04 / 1e4) / (b08 / 1e4 + 6 * (b04 / 1e4) - 7.5::DOUBLE * (b02 / 1e4) + 1 + 1e-6), -1), 2.5::DOUBLE) END AS evi
  FROM band)"""

_CELLS_SQL = """
paired AS (
  SELECT p.*, i.ix, j.iy FROM pixel p,
    LATERAL (SELECT unnest(generate_series(floor(col * 10 / 75.0::DOUBLE)::BIGINT, ceil((col + 1) * 10 / 75.0::DOUBLE)::BIGINT - 1)) AS ix) i,
    LATERAL (SELECT unnest(generate_series(floor((2000 - ("row" + 1) * 10) / 75.0::DOUBLE)::BIGINT, ceil((2000 - "row" * 10) / 75.0::DOUBLE)::BIGINT - 1)) AS iy) j)"""

_STATS_SQL = ", ".join(
    [f"{r(f'avg({i}) FILTER (WHERE clear)', 4)} AS {i}_mean, {r(f'stddev_pop({i}) FILTER (WHERE clear)', 4)} AS {i}_std" for i in ("ndvi", "ndwi", "evi")]
    + [f"{r(f'avg({b}) FILTER (WHERE clear)', 1)} AS {b}_mean" for b in ("b02", "b03", "b04", "b08", "b11", "b12")]
)
ZONAL_SQL = f"""{PIXELS_SQL}, {_CELLS_SQL}, zonal AS (
  SELECT scene_id, ix, iy, {_STATS_SQL}, {r("count(*) FILTER (WHERE clear)::DOUBLE / count(*) * 100", 2)} AS valid_pixel_pct
  FROM paired GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE clear) >= 5)"""


def line_zonal(t: Tables) -> DataFrame:
    paired = raster.pixel_cells(line_pixels(t), origin_y=WIDTH * PIXEL, pixel=PIXEL, cell=CELL)
    return raster.zonal_statistics(paired, keys=("scene_id", "ix", "iy"))


@query(f"""WITH {PIXELS_SQL} SELECT scene_id, "row", col, clear, b04, b08, {r("ndvi", 4)} AS ndvi, {r("ndwi", 4)} AS ndwi, {r("evi", 4)} AS evi FROM pixel""")
def spectral_indices(t: Tables) -> DataFrame:
    return line_pixels(t).select("scene_id", "row", "col", "clear", "b04", "b08", *[round_even(i, 4).alias(i) for i in ("ndvi", "ndwi", "evi")])


@query(f"WITH {ZONAL_SQL} SELECT * FROM zonal")
def zonal_stats(t: Tables) -> DataFrame:
    return line_zonal(t)


@query(f"""WITH {ZONAL_SQL} SELECT ix, iy, left(scene_id, 4) AS period, round(avg(ndvi_mean), 9) AS ndvi_mean, round(avg(b08_mean), 9) AS b08_mean,
  round(avg(valid_pixel_pct), 9) AS valid_pixel_pct, min(scene_id) AS scene_id FROM zonal GROUP BY 1, 2, 3""")
def overlap_mean(t: Tables) -> DataFrame:
    features = line_zonal(t).select("ix", "iy", F.substring("scene_id", 1, 4).alias("period"), "scene_id", "ndvi_mean", "b08_mean", "valid_pixel_pct")
    merged = raster.merge_overlaps(features, keys=("ix", "iy", "period"))
    return merged.withColumns({c: F.round(c, 9) for c in ("ndvi_mean", "b08_mean", "valid_pixel_pct")})


def part_raster(t: Tables) -> DataFrame:
    """Parts as complete 20 m rasters of 25 x 40 pixels, a thousand parts to a scene."""
    at = F.col("p_partkey") % 1000
    return t.part.select(
        F.floor(F.col("p_partkey") / 1000).alias("scene_id"), F.floor(at / 40).alias("row"), (at % 40).alias("col"),
        F.col("p_retailprice").alias("b11"), F.col("p_size").cast("double").alias("b12"), F.col("p_size").alias("scl"),
    )


_PART_SQL = """part_pixel AS (SELECT p_partkey // 1000 AS scene_id, (p_partkey % 1000) // 40 AS "row", p_partkey % 40 AS col,
  p_retailprice AS b11, p_size::DOUBLE AS b12, p_size AS scl FROM part)"""


@query(f"""WITH {_PART_SQL} SELECT scene_id, "row" * 2 + dr AS "row", col * 2 + dc AS col, scl
FROM part_pixel, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc)""")
def resample_nearest(t: Tables) -> DataFrame:
    return raster.resample_nearest(part_raster(t).select("scene_id", "row", "col", "scl"))


@query(f"""WITH {_PART_SQL},
fine AS (SELECT scene_id, "row" * 2 + dr AS "row", col * 2 + dc AS col FROM part_pixel, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc)),
around AS (
  SELECT f.scene_id, f."row", f.col, s.b11, s.b12,
    CASE WHEN s."row" = f."row" // 2 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END * CASE WHEN s.col = f.col // 2 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS w
  FROM fine f JOIN part_pixel s ON s.scene_id = f.scene_id
    AND s."row" IN (f."row" // 2, CASE WHEN f."row" % 2 = 0 THEN f."row" // 2 - 1 ELSE f."row" // 2 + 1 END)
    AND s.col IN (f.col // 2, CASE WHEN f.col % 2 = 0 THEN f.col // 2 - 1 ELSE f.col // 2 + 1 END))
SELECT scene_id, "row", col, round(sum(w * b11) / sum(w), 4) AS b11, round(sum(w * b12) / sum(w), 4) AS b12 FROM around GROUP BY 1, 2, 3""")
def resample_bilinear(t: Tables) -> DataFrame:
    out = raster.resample_bilinear(part_raster(t), ["b11", "b12"])
    return out.withColumns({b: F.round(b, 4) for b in ("b11", "b12")})


_FINE = {"b02": (5, 900), "b03": (7, 950), "b04": (11, 800), "b08": (17, 1500)}
_FINE_SQL = ", ".join(f'(("row" * {k} + col * {k + 2} + scene_id * 13) % 4000 + {low})::DOUBLE AS {b}' for b, (k, low) in _FINE.items())


@query(f"""WITH {_PART_SQL.replace("p_retailprice AS b11, p_size::DOUBLE AS b12, p_size AS scl", "p_retailprice * 1.0135719::DOUBLE AS b11, p_retailprice * 1.3791357::DOUBLE AS b12, p_size % 12 AS scl")},
spots AS (SELECT scene_id, "row" * 2 + dr AS "row", col * 2 + dc AS col FROM part_pixel, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc)),
around AS (
  SELECT f.scene_id, f."row", f.col, s.b11, s.b12,
    CASE WHEN s."row" = f."row" // 2 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END * CASE WHEN s.col = f.col // 2 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS w
  FROM spots f JOIN part_pixel s ON s.scene_id = f.scene_id
    AND s."row" IN (f."row" // 2, CASE WHEN f."row" % 2 = 0 THEN f."row" // 2 - 1 ELSE f."row" // 2 + 1 END)
    AND s.col IN (f.col // 2, CASE WHEN f.col % 2 = 0 THEN f.col // 2 - 1 ELSE f.col // 2 + 1 END)),
sharp AS (SELECT scene_id, "row", col, sum(w * b11) / sum(w) AS b11, sum(w * b12) / sum(w) AS b12 FROM around GROUP BY 1, 2, 3),
raw AS (SELECT *, {_FINE_SQL}, CASE WHEN scene_id % 2 = 1 THEN -1000 ELSE 0 END AS o,
  (SELECT scl FROM part_pixel c WHERE c.scene_id = s.scene_id AND c."row" = s."row" // 2 AND c.col = s.col // 2) AS scl FROM sharp s),
band AS (SELECT scene_id, "row", col, scl IN (4, 5, 6, 7) AS clear, {", ".join(f"greatest({b} + o, 0) AS {b}" for b in ("b02", "b03", "b04", "b08", "b11", "b12"))} FROM raw),
{PIXELS_SQL[PIXELS_SQL.index("pixel AS ("):]},
paired AS (SELECT *, col // 10 AS ix, (49 - "row") // 10 AS iy FROM pixel),
zonal AS (SELECT scene_id, ix, iy, {_STATS_SQL}, {r("count(*) FILTER (WHERE clear)::DOUBLE / count(*) * 100", 2)} AS valid_pixel_pct
  FROM paired GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE clear) >= 5)
SELECT scene_id, 'C' || ix || '_' || iy AS cell_id, * EXCLUDE (scene_id, ix, iy) FROM zonal""")
def satellite_features(t: Tables) -> DataFrame:
    """Parts as raw 20 m blocks under 10 m blocks, one block per raster line: resampled, corrected by baseline, reduced to cells."""
    coarse = part_raster(t).withColumns({"b11": F.col("b11") * 1.0135719, "b12": F.col("b11") * 1.3791357, "scl": F.col("scl") % 12})
    keys = ["scene_id"]

    def lines(df: DataFrame, bands: list[str]) -> DataFrame:
        entry = F.struct("col", *[F.col(b).cast("float" if b == "scl" else "double").alias(b) for b in bands])
        line = df.groupBy("scene_id", "row").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
        blocks = F.array(*[F.struct(F.lit(b.upper()).alias("band"), F.array(F.col(f"_l.{b}").cast("array<double>")).alias("px")) for b in bands])
        return line.select("scene_id", F.inline(blocks), F.col("row").alias("row0"), F.lit(0).alias("col0"))

    position = coarse.select("scene_id", "row", "col")
    fine = raster.resample_nearest(position).withColumns({b: F.pmod(F.col("row") * k + F.col("col") * (k + 2) + F.col("scene_id") * 13, F.lit(4000)) + F.lit(low) for b, (k, low) in _FINE.items()})
    blocks = lines(fine, list(_FINE)).unionByName(lines(coarse, ["b11", "b12", "scl"]))
    scenes = position.select("scene_id").distinct().withColumn("baseline", F.when(F.col("scene_id") % 2 == 1, "05.10").otherwise("02.14"))
    raw = strips.block_pixels(blocks, scenes, keys=keys).withColumn("date", F.lit("2024-01-01").cast("date"))
    columns = t.spark.range(8).withColumnRenamed("id", "ix")
    cells = columns.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4)))).select(
        F.format_string("C%d_%d", "ix", "iy").alias("cell_id"), "ix", "iy", F.lit(0.0).alias("centroid_lon"), F.lit(0.0).alias("centroid_lat"),
    )
    return raster.scene_features(raw, cells, offset="offset", origin_y=500.0, pixel=10.0, cell=100.0).drop("date", "centroid_lon", "centroid_lat")


@query(f"""WITH {_PART_SQL}, fine AS (SELECT scene_id, "row" * 2 AS "row", col * 2 + 1 AS col, b11 FROM part_pixel)
SELECT f.scene_id, f."row", f.col, f.b11, c.scl FROM fine f LEFT JOIN part_pixel c ON c.scene_id = f.scene_id AND c."row" = f."row" // 2 AND c.col = f.col // 2""")
def align_scene_class(t: Tables) -> DataFrame:
    fine = part_raster(t).select("scene_id", (F.col("row") * 2).alias("row"), (F.col("col") * 2 + 1).alias("col"), "b11")
    return raster.align_nearest(fine, part_raster(t), ["scl"])


@query(f"""WITH {_PART_SQL} SELECT scene_id, "row", col, b11 FROM part_pixel WHERE "row" >= 4 AND "row" < 17 AND col >= 5 AND col < 31""")
def clip_window(t: Tables) -> DataFrame:
    return raster.clip_window(part_raster(t), 4, 17, 5, 31).select("scene_id", "row", "col", "b11")


@query("""SELECT s_suppkey, n_nationkey, floor((s_nationkey - n_nationkey) / 0.3::DOUBLE)::BIGINT AS col_from,
  ceil((s_nationkey - n_nationkey) / 0.3::DOUBLE + 2 / 0.3::DOUBLE)::BIGINT AS col_to FROM supplier JOIN nation
ON n_regionkey = s_suppkey % 5 WHERE s_nationkey + 2 > n_nationkey AND s_nationkey < n_nationkey + 3 AND s_acctbal / 1000 + 1 > n_regionkey AND s_acctbal / 1000 < n_regionkey + 2""")
def bbox_overlap(t: Tables) -> DataFrame:
    """Suppliers' boxes against the boxes of the nations listed for them, and the pixel columns of the box."""
    pairs = t.supplier.join(t.nation, F.col("n_regionkey") == F.col("s_suppkey") % 5)
    x, y = F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 1000
    nx, ny = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    hit = pairs.filter(raster.boxes_overlap((x, y, x + 2, y + 1), (nx, ny, nx + 3, ny + 2)))
    window = raster.window_of(x, y, x + 2, y + 1, nx, ny, 0.3)
    return hit.select("s_suppkey", "n_nationkey", window["col_from"].alias("col_from"), window["col_to"].alias("col_to"))


@query("""WITH d AS (
  SELECT c_custkey, s_suppkey, pow(c_nationkey + c_acctbal / 10000 - (s_nationkey + s_acctbal / 10000), 2) + pow(c_acctbal / 1000 - s_acctbal / 1000, 2) AS d
  FROM customer, supplier)
SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey FROM d GROUP BY 1""")
def nearest_point(t: Tables) -> DataFrame:
    cells = t.customer.select("c_custkey", (F.col("c_nationkey") + F.col("c_acctbal") / 10000).alias("x"), (F.col("c_acctbal") / 1000).alias("y"))
    points = t.supplier.select("s_suppkey", (F.col("s_nationkey") + F.col("s_acctbal") / 10000).alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    return nearest_points(
        cells, points, cell_id="c_custkey", cell_x="x", cell_y="y", point_id="s_suppkey", point_x="x", point_y="y", geographic=False
    )


@query("""WITH e AS (SELECT min(s_acctbal) AS lo, (max(s_acctbal) - min(s_acctbal)) / 3 AS w FROM supplier)
SELECT s_suppkey, CASE WHEN s_acctbal <= lo + w THEN 'head' WHEN s_acctbal <= lo + 2 * w THEN 'middle' ELSE 'tail' END AS reach FROM supplier, e""")
def reach_bands(t: Tables) -> DataFrame:
    return grid.equal_width_bands(t.supplier, "s_acctbal").select("s_suppkey", "reach")


def supplier_areas(t: Tables) -> DataFrame:
    """A diamond around each supplier's place, half axes from its balance."""
    x, y = F.col("s_nationkey") * 1000.0, F.col("s_acctbal").cast("double")
    a, b = F.lit(333.3) + y / 30, F.lit(271.7) + y / 40
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    zero = F.lit(0.0)
    ring = F.array(corner(-a, zero), corner(zero, b), corner(a, zero), corner(zero, -b))
    return t.supplier.select(F.col("s_suppkey").alias("area_id"), ring_edges(ring).alias("edges"))


_AREAS_SQL = """area AS (SELECT s_suppkey AS area_id, s_nationkey * 1000::DOUBLE AS x, s_acctbal AS y, 333.3::DOUBLE + s_acctbal / 30 AS a, 271.7::DOUBLE + s_acctbal / 40 AS b FROM supplier)"""


@query(f"""WITH {_AREAS_SQL},
cells AS (
  SELECT area_id, x, y, a, b, i.ix, j.iy, x - a + i.ix * 100 AS minx, y - b + j.iy * 100 AS miny FROM area,
    LATERAL (SELECT unnest(range(0, ceil(2 * a / 100)::BIGINT)) AS ix) i, LATERAL (SELECT unnest(range(0, ceil(2 * b / 100)::BIGINT)) AS iy) j),
kept AS (
  SELECT * FROM cells WHERE greatest(minx - x, x - minx - 100, 0) / a + greatest(miny - y, y - miny - 100, 0) / b <= 1)
SELECT area_id, format('CELL_{{:04d}}', row_number() OVER (ORDER BY area_id, ix, iy)) AS cell_id, ix, iy,
  round(minx, 6) AS minx, round(miny, 6) AS miny FROM kept""")
def grid_cells(t: Tables) -> DataFrame:
    cells = grid.spatial_grid(supplier_areas(t), cell_size=100.0, central_meridian=None)
    return cells.select("area_id", "cell_id", "ix", "iy", F.round("minx", 6).alias("minx"), F.round("miny", 6).alias("miny"))


def _segment_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    dx, dy = f"({x2} - ({x1}))", f"({y2} - ({y1}))"
    t = f"least(greatest(((px - ({x1})) * {dx} + (py - ({y1})) * {dy}) / ({dx} * {dx} + {dy} * {dy}), 0), 1)"
    return f"sqrt(pow(px - ({x1} + {t} * {dx}), 2) + pow(py - ({y1} + {t} * {dy}), 2))"


_EDGE_SQL = ", ".join([
    _segment_sql("x - a", "y", "x", "y + b"), _segment_sql("x", "y + b", "x + a", "y"),
    _segment_sql("x + a", "y", "x", "y - b"), _segment_sql("x", "y - b", "x - a", "y"),
])


@query(f"""WITH {_AREAS_SQL},
places AS (
  SELECT area_id, x, y, a, b, j.r, i.c, i.c * 100::DOUBLE AS px, j.r * 100::DOUBLE AS py FROM area,
    LATERAL (SELECT unnest(generate_series(floor((x - a) / 100)::BIGINT, ceil((x + a) / 100)::BIGINT)) AS c) i,
    LATERAL (SELECT unnest(generate_series(floor((y - b) / 100)::BIGINT, ceil((y + b) / 100)::BIGINT)) AS r) j),
kept AS (SELECT * FROM places WHERE abs(px - x) / a + abs(py - y) / b < 1 OR least({_EDGE_SQL}) < 50)
SELECT area_id, 'WX_' || lpad((row_number() OVER (PARTITION BY area_id ORDER BY r, c) - 1)::VARCHAR, 3, '0') AS weather_point_id, py AS latitude, px AS longitude FROM kept""")
def weather_lattice(t: Tables) -> DataFrame:
    return grid.weather_lattice(supplier_areas(t), spacing=100.0)


# Series of the transverse Mercator projection on the WGS 84 ellipsoid, written out for the SQL side.
_SERIES = (0.0008377318206303529, 7.608527714248998e-07, 1.1976380015605232e-09, 2.4433761945220637e-12)
_ECCENTRICITY, _SCALED_RADIUS = 0.08181919084262149, 6364902.166165086


def _utm_sql() -> tuple[str, str]:
    east = " + ".join(["eta", *[f"{a!r}::DOUBLE * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(_SERIES, 1)]])
    north = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(_SERIES, 1)]])
    k = f"{_SCALED_RADIUS!r}::DOUBLE"
    return f"500000 + {k} * ({east})", f"{k} * ({north})"


_EAST, _NORTH = _utm_sql()


@query(f"""WITH p AS (SELECT c_custkey, 72.1::DOUBLE + c_nationkey / 5::DOUBLE AS lon, 18 + c_acctbal / 5000 AS lat FROM customer),
s AS (SELECT *, radians(lat) AS phi, radians(lon - 75) AS lam FROM p),
u AS (SELECT *, sinh(atanh(sin(phi)) - {_ECCENTRICITY!r}::DOUBLE * atanh({_ECCENTRICITY!r}::DOUBLE * sin(phi))) AS t FROM s),
v AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM u)
SELECT c_custkey, round({_EAST}, 3) AS easting, round({_NORTH}, 3) AS northing, round(lon, 7) AS lon_back, round(lat, 7) AS lat_back FROM v""")
def utm_points(t: Tables) -> DataFrame:
    """Customers placed around the zone's meridian: to metres and back."""
    lon, lat = F.lit(72.1) + F.col("c_nationkey") / F.lit(5.0), F.lit(18.0) + F.col("c_acctbal") / 5000
    east, north = geodesy.to_utm(lon, lat)
    back_lon, back_lat = geodesy.from_utm("east", "north")
    return t.customer.select("c_custkey", east.alias("east"), north.alias("north")).select(
        "c_custkey", F.round("east", 3).alias("easting"), F.round("north", 3).alias("northing"),
        F.round(back_lon, 7).alias("lon_back"), F.round(back_lat, 7).alias("lat_back"),
    )
