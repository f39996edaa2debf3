"""Manifests, catalogue filters and set operations, with orders as scenes and line items as band files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import baseline_offset
from ..operators import manifest
from ..operators.ordering import ranked
from ..settings import BANDS, Scenes
from ..sources.areas import area_info, polygon_features
from ..sources.catalogue import ITEM_SCHEMA, scene_items
from ..sources.scene_cache import SceneCache, ingest
from ..sources.tables import write_bucketed
from ..streaming import scenes as streamed_scenes
from ..streaming.runs import new_run
from .registry import Tables, query


def order_scenes(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("scene_id"), F.to_date("o_orderdate").alias("acquisition_date"), F.col("o_orderstatus").alias("status")
    )


@query("""WITH batches AS (
  SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS acquisition_date, o_orderstatus AS status, NULL::INTEGER AS cells, 0 AS batch
  FROM orders WHERE o_orderdate < DATE '2000-01-01'
  UNION ALL
  SELECT o_orderkey, CAST(o_orderdate AS DATE), 'complete', length(o_orderpriority)::INTEGER, 1 FROM orders WHERE o_orderdate >= DATE '1998-01-01')
SELECT scene_id, acquisition_date, status, cells FROM batches
QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY batch DESC) = 1""")
def manifest_upsert(t: Tables) -> DataFrame:
    old = order_scenes(t).filter(F.col("acquisition_date") < F.lit(date(2000, 1, 1)))
    new = t.orders.filter(F.col("o_orderdate") >= F.lit(date(1998, 1, 1))).select(
        F.col("o_orderkey").alias("scene_id"), F.to_date("o_orderdate").alias("acquisition_date"),
        F.lit("complete").alias("status"), F.length("o_orderpriority").alias("cells"),
    )
    return manifest.upsert(old, new)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) = 1""")
def latest_copy(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return manifest.latest_copies(
        lines, keys=["l_orderkey", "l_linenumber"], baseline="l_extendedprice", sequence=["l_partkey", "l_suppkey"]
    )


@query("""SELECT greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS resume_from""")
def resume_point(t: Tables) -> DataFrame:
    return manifest.resume_point(
        t.orders.select(F.col("o_orderdate").alias("acquisition_date")), t.lineitem.select(F.col("l_shipdate").alias("acquisition_date")),
        default=Scenes().start,
    )


@query("SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS acquisition_date, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_new_scenes(t: Tables) -> DataFrame:
    return manifest.without_known(order_scenes(t), t.lineitem.select(F.col("l_orderkey").alias("scene_id")))


@query("""SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS acquisition_date, o_orderstatus AS status FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def semi_scenes(t: Tables) -> DataFrame:
    listed = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("scene_id"))
    return manifest.only_listed(order_scenes(t), listed)


@query("SELECT o_orderkey AS scene_id FROM orders UNION SELECT l_orderkey FROM lineitem")
def known_ids(t: Tables) -> DataFrame:
    return manifest.known_ids(order_scenes(t), t.lineitem.select(F.col("l_orderkey").alias("scene_id")))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS acquisition_date FROM orders ORDER BY 1")
def sorted_dates(t: Tables) -> DataFrame:
    return manifest.known_ids(order_scenes(t), key="acquisition_date").orderBy("acquisition_date")


@query("""SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS acquisition_date, o_orderstatus AS status FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY 2 DESC, 1 DESC LIMIT 50""")
def pending_newest(t: Tables) -> DataFrame:
    known = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("scene_id"))
    return manifest.pending(order_scenes(t), known, newest_first=True, limit=50)


@query("""SELECT l_orderkey AS scene_dir, count(DISTINCT CASE WHEN l_extendedprice > 5000 THEN l_linenumber END) = 7 AS complete
FROM lineitem GROUP BY 1""")
def scene_completeness(t: Tables) -> DataFrame:
    files = t.lineitem.select(
        F.col("l_orderkey").alias("scene_dir"), F.element_at(F.array(*map(F.lit, BANDS)), F.col("l_linenumber")).alias("band"),
        F.col("l_extendedprice").alias("length"),
    )
    return manifest.scene_completeness(files, min_bytes=5000)


def catalogue_items(t: Tables) -> DataFrame:
    """Orders as catalogue items in JSON: some with a tile property, some with a tile in the id, some with neither."""
    tile = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("qda"))
    key = F.col("o_orderkey")
    kind = key % 4
    item_id = (
        F.when(kind == 1, F.concat(F.lit("S2A_T"), F.upper(tile), F.lit("_"), key.cast("string")))
        .when(kind == 2, F.concat(F.lit("S2A_"), tile, F.lit("_"), key.cast("string")))
        .otherwise(F.concat(F.lit("S2A_"), key.cast("string"), F.lit("_copy")))
    )
    cloud = F.round(F.col("o_totalprice") / 10000, 2)
    properties = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
        F.when(F.col("o_orderstatus") == "F", cloud).alias("eo:cloud_cover"),
        F.when(F.col("o_orderstatus") == "O", cloud).alias("s2:high_proba_clouds_percentage"),
        F.when(kind == 0, F.concat(F.lit("T"), tile)).alias("s2:mgrs_tile"),
        F.format_string("%02d.%02d", (key % 7).cast("int"), (key % 11).cast("int")).alias("s2:processing_baseline"),
    )
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.to_json(F.struct(item_id.alias("id"), properties.alias("properties"))).alias("value"))


def catalogue(t: Tables) -> DataFrame:
    parsed = catalogue_items(t).select(F.from_json("value", ITEM_SCHEMA).alias("item")).select("item.*")
    return scene_items(parsed)


CATALOGUE_SQL = """
raw AS (
  SELECT o_orderkey AS k, o_orderkey % 4 AS kind, lpad(c_nationkey::VARCHAR, 2, '0') || 'QDA' AS tile_text,
         CAST(o_orderdate AS DATE) AS acquired, o_orderstatus AS s, round(o_totalprice / 10000, 2) AS cloud
  FROM orders JOIN customer ON o_custkey = c_custkey),
scenes AS (
  SELECT CASE kind WHEN 1 THEN 'S2A_T' || tile_text || '_' || k WHEN 2 THEN 'S2A_' || lower(tile_text) || '_' || k ELSE 'S2A_' || k || '_copy' END AS scene_id,
         acquired, CASE WHEN s IN ('F', 'O') THEN cloud ELSE 100::DOUBLE END AS cloud_cover,
         CASE WHEN kind < 3 THEN tile_text WHEN length(k::VARCHAR) = 5 THEN k::VARCHAR END AS tile,
         printf('%02d.%02d', k % 7, k % 11) AS baseline
  FROM raw)"""


@query(f"WITH {CATALOGUE_SQL} SELECT * FROM scenes")
def scene_catalogue(t: Tables) -> DataFrame:
    return catalogue(t).withColumn("acquired", F.to_date("acquired"))


@query(f"""WITH {CATALOGUE_SQL} SELECT scene_id, acquired, cloud_cover, tile FROM scenes
WHERE cloud_cover <= 15 AND (tile IS NULL OR tile IN ('03QDA', '11QDA')) AND acquired BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def usable_scenes(t: Tables) -> DataFrame:
    out = manifest.usable_scenes(catalogue(t), tiles=["T03QDA", "11qda"], start=date(1996, 1, 1), end=date(2000, 12, 31))
    return out.select("scene_id", F.to_date("acquired").alias("acquired"), "cloud_cover", "tile")


@query(f"""WITH {CATALOGUE_SQL} SELECT scene_id, CASE WHEN baseline::DOUBLE >= 4 THEN -1000::DOUBLE ELSE 0::DOUBLE END AS offset_value FROM scenes""")
def baseline_offsets(t: Tables) -> DataFrame:
    return catalogue(t).select("scene_id", baseline_offset("baseline").alias("offset_value"))


@query(f"""WITH {CATALOGUE_SQL} SELECT acquired, tile, scene_id, baseline FROM scenes
QUALIFY row_number() OVER (PARTITION BY acquired, tile ORDER BY baseline::DOUBLE DESC, scene_id) = 1""")
def latest_reprocessing(t: Tables) -> DataFrame:
    scenes = catalogue(t).withColumn("acquired", F.to_date("acquired"))
    kept = manifest.latest_copies(scenes, keys=["acquired", "tile"], baseline="baseline", sequence=["scene_id"])
    return kept.select("acquired", "tile", "scene_id", "baseline")


_LINE_COLUMNS = ("l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_suppkey")
_ROW_TEXT = " || chr(31) || ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in _LINE_COLUMNS)


@query(f"""SELECT count(*) AS rows, sum(('0x' || substr(md5({_ROW_TEXT}), 1, 15))::BIGINT)::VARCHAR AS content FROM lineitem""")
def content_fingerprint(t: Tables) -> DataFrame:
    return manifest.fingerprint(t.lineitem.select(*_LINE_COLUMNS)).withColumn("content", F.col("content").cast("string"))


@query()
def whole_content_fingerprint(t: Tables) -> DataFrame:
    """Every column of the table, with dates and doubles in Spark's text form; ``content_fingerprint`` is held to the columns of its SQL."""
    return manifest.fingerprint(t.lineitem).withColumn("content", F.col("content").cast("string"))


@query(f"""WITH {CATALOGUE_SQL},
placed AS (SELECT *, coalesce(tile, 'scene ' || scene_id) AS spot FROM scenes WHERE acquired >= DATE '1997-01-01'),
newest AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY acquired, spot ORDER BY baseline::DOUBLE DESC, scene_id) = 1),
log AS (SELECT * FROM scenes WHERE length(scene_id) % 3 > 0 AND cloud_cover < 30),
done AS (SELECT acquired, coalesce(tile, 'scene ' || scene_id) AS spot, max(baseline) AS baseline FROM log WHERE cloud_cover < 15 GROUP BY 1, 2)
SELECT n.scene_id, n.acquired, n.tile, n.baseline FROM newest n LEFT JOIN done d USING (acquired, spot)
WHERE n.scene_id NOT IN (SELECT scene_id FROM log WHERE cloud_cover < 15) AND (d.baseline IS NULL OR n.baseline > d.baseline)""")
def scenes_to_process(t: Tables) -> DataFrame:
    """Catalogue scenes against an outcome log of clear ones (complete) and cloudy ones (failed)."""
    listed = catalogue(t)
    log = listed.filter((F.length("scene_id") % 3 > 0) & (F.col("cloud_cover") < 30)).select(
        "scene_id", F.to_date("acquired").alias("acquisition_date"), F.col("tile").alias("mgrs_tile"), "baseline",
        F.when(F.col("cloud_cover") < 15, "complete").otherwise("failed").alias("status"),
    )
    found = streamed_scenes.scenes_to_process(listed, log, date(1997, 1, 1))
    return found.select("scene_id", F.to_date("acquired").alias("acquired"), "tile", "baseline")


@query("SELECT row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS place, o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS acquisition_date FROM orders")
def chronological_scenes(t: Tables) -> DataFrame:
    """Scenes in order of date and id, each with its place."""
    ordered = manifest.chronological(order_scenes(t)).select("scene_id", "acquisition_date")
    return ranked(ordered.withColumn("_all", F.lit(0)), ["_all"], ["acquisition_date", "scene_id"], "place", "_rows").select("place", "scene_id", "acquisition_date")


@query("""SELECT s_suppkey AS area_id, s_nationkey::DOUBLE AS min_lon, round(s_acctbal / 1000, 3) AS min_lat, s_nationkey + 2::DOUBLE AS max_lon,
       round(s_acctbal / 1000, 3) + 1 AS max_lat,
       CASE s_suppkey % 4 WHEN 0 THEN 'A' || s_nationkey || '|B' WHEN 1 THEN 'C|D' || s_nationkey WHEN 2 THEN 'E' || s_nationkey ELSE '43QDA|43QDV' END AS tiles
FROM supplier""")
def area_bounds(t: Tables) -> DataFrame:
    """GeoJSON documents made from suppliers; a point feature comes first and is passed over."""
    x, y = F.col("s_nationkey").cast("double"), F.round(F.col("s_acctbal") / 1000, 3)
    ring = F.array(F.array(x, y), F.array(x + 2, y), F.array(x + 2, y + 1), F.array(x, y))
    n = F.col("s_nationkey").cast("string")
    kind = F.col("s_suppkey") % 4
    props = F.concat(
        F.lit('{"name": "area"'),
        F.when(kind == 0, F.concat(F.lit(', "sentinel2_mgrs_tiles": ["A'), n, F.lit('", "B"]')))
        .when(kind == 1, F.concat(F.lit(', "sentinel2_mgrs_tiles": "C, D'), n, F.lit('"')))
        .when(kind == 2, F.concat(F.lit(', "sentinel2_mgrs_tile": "E'), n, F.lit('"')))
        .otherwise(F.lit("")),
        F.lit("}"),
    )
    multi = F.col("s_suppkey") % 3 == 0
    shape = F.when(multi, F.concat(F.lit('{"type": "MultiPolygon", "coordinates": [['), F.to_json(ring), F.lit("]]}"))).otherwise(
        F.concat(F.lit('{"type": "Polygon", "coordinates": ['), F.to_json(ring), F.lit("]}"))
    )
    document = F.concat(
        F.lit('{"features": [{"geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {}}, {"geometry": '),
        shape, F.lit(', "properties": '), props, F.lit("}]}"),
    )
    docs = t.supplier.select(F.col("s_suppkey").alias("area_id"), document.alias("value"))
    info = area_info(polygon_features(docs, keys=["area_id"]))
    return info.withColumn("tiles", F.array_join("tiles", "|"))


@query(f"""WITH {CATALOGUE_SQL},
usable AS (SELECT *, row_number() OVER (PARTITION BY acquired, coalesce(tile, 'scene ' || scene_id) ORDER BY baseline::DOUBLE DESC, scene_id) AS place FROM scenes
  WHERE cloud_cover <= 15 AND acquired BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
raw_key AS (SELECT scene_id, acquired, regexp_extract(scene_id, '([0-9]+)(_copy)?$', 1)::BIGINT AS k FROM usable WHERE place = 1),
file AS (SELECT l_orderkey AS k, count(DISTINCT CASE WHEN l_extendedprice > 1000 THEN l_linenumber % 4 END) = 4 AS whole,
  count(*) FILTER (WHERE l_quantity > 10) AS cells, round(sum(l_quantity) FILTER (WHERE l_quantity > 10), 2) AS quantity FROM lineitem GROUP BY 1)
SELECT scene_id, acquired AS acquisition_date, CASE WHEN NOT coalesce(whole, false) THEN 'incomplete' WHEN cells > 0 THEN 'complete' ELSE 'no_clear_cells' END AS status,
  CASE WHEN whole THEN cells ELSE 0 END AS cells, CASE WHEN whole AND cells > 0 THEN quantity END AS quantity,
  'v2' AS version FROM raw_key LEFT JOIN file USING (k)""")
def ingested_scenes(t: Tables) -> DataFrame:
    """Catalogue, completeness, manifest and cache in three runs: the older scenes, all of them, and all in a newer feature version."""
    cache = SceneCache(t.spark, f"{new_run(t.spark, 'scene_cache')}")
    key = F.regexp_extract("scene_id", "([0-9]+)(_copy)?$", 1).cast("long")
    items = cache.staged(catalogue(t), "items")  # landed once, listed by three runs
    keys = items.select("scene_id", key.alias("l_orderkey"))
    bands = BANDS[:4]
    files = t.lineitem.join(keys, "l_orderkey").select("scene_id", F.element_at(F.array(*map(F.lit, bands)), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("band"), F.col("l_extendedprice").alias("length"))
    rules = Scenes(start=date(1996, 1, 1), end=date(2000, 12, 31))

    def extract(scenes: DataFrame) -> DataFrame:
        return scenes.withColumn("l_orderkey", key).join(t.lineitem.filter("l_quantity > 10"), "l_orderkey").select("scene_id", "l_quantity")

    for some, version in ((items.filter(F.col("acquired") < F.lit("1998-06-01").cast("timestamp")), "v1"), (items, "v1"), (items, "v2")):
        ingest(cache, some, files, extract, version, rules, bands=bands)
    sums = cache.features().groupBy("scene_id").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return cache.snapshot().join(sums, "scene_id", "left").select("scene_id", "acquisition_date", "status", "cells", "quantity", "version")


@query("""SELECT o_orderpriority, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def bucketed_join(t: Tables) -> DataFrame:
    """Line items and orders stored in buckets by order, joined where they lie."""
    return bucketed_pair(t).groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def bucketed_pair(t: Tables, buckets: int = 16) -> DataFrame:
    run = new_run(t.spark, "buckets")
    tag = run.rsplit("-", 1)[-1]
    lines = write_bucketed(t.lineitem.withColumnRenamed("l_orderkey", "order_key"), f"lines_{tag}", f"{run}/lines", ["order_key"], buckets)
    orders = write_bucketed(t.orders.withColumnRenamed("o_orderkey", "order_key"), f"orders_{tag}", f"{run}/orders", ["order_key"], buckets)
    return lines.hint("merge").join(orders, "order_key")
