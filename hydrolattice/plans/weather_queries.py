"""Rolling features, labels and joins, with events as daily readings per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import water
from ..operators.kpi import cells_per_date, latest_covered_date
from ..operators.labels import buffered_labels, climatic_labels
from ..operators.profile import class_shares
from ..operators.learn import fill_inputs
from ..operators.weather import weather_features, with_label_inputs
from ..settings import CLASS_LABELS, WaterBalance
from ..sources import weather_payloads
from ..sources.weather_payloads import flatten_payloads
from .registry import Tables, query, r

# Events carry larger numbers than weather, so the class limits are scaled up.
EVENT_BALANCE = WaterBalance(low_mm=60.0, high_mm=140.0)
LINE_BALANCE = WaterBalance()


def daily_readings(t: Tables) -> DataFrame:
    """One row per (user, day): rain, evaporative demand and temperatures from event values."""
    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))

    return t.events.groupBy(F.col("user_id").alias("weather_point_id"), F.to_date("ts").alias("date")).agg(
        of("purchase").alias("rainfall_mm"), of("click").alias("et0_mm"), (F.avg("value") / 1.037).alias("temp_mean_c"), F.max("value").alias("temp_max_c")
    )


@query("""WITH daily AS (SELECT user_id AS weather_point_id, CAST(ts AS DATE) AS date, coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0::DOUBLE) AS rain_mm,
  coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0::DOUBLE) AS et0_mm FROM events GROUP BY 1, 2)
SELECT weather_point_id, date, round(sum(et0_mm) OVER w, 6) AS et0_8day_sum, round(sum(rain_mm) OVER w, 6) AS rainfall_8day FROM daily
WINDOW w AS (PARTITION BY weather_point_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def fallback_sums(t: Tables) -> DataFrame:
    """Eight-day sums for readings that lack them, with liquid rain where there is no other."""
    daily = daily_readings(t).select("weather_point_id", "date", F.col("rainfall_mm").alias("rain_mm"), "et0_mm")
    return with_label_inputs(daily).select("weather_point_id", "date", *[F.round(c, 6).alias(c) for c in ("et0_8day_sum", "rainfall_8day")])


@query("""SELECT doc_id, coalesce(quality::DOUBLE, 0.5::DOUBLE) AS quality, coalesce(toxic::DOUBLE, 0::DOUBLE) AS toxic, 7::DOUBLE AS humidity_pct, 0::DOUBLE AS rainfall_8day
FROM documents LEFT JOIN labels USING (doc_id)""")
def filled_inputs(t: Tables) -> DataFrame:
    """Labels as model inputs: missing values and absent columns get their default, else zero."""
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return fill_inputs(rows, ["quality", "toxic", "humidity_pct", "rainfall_8day"], {"quality": 0.5, "humidity_pct": 7.0})


def labelled_days(t: Tables) -> DataFrame:
    return climatic_labels(weather_features(daily_readings(t)), EVENT_BALANCE)


DAILY_SQL = """
daily AS (
  SELECT user_id AS weather_point_id, CAST(ts AS DATE) AS date,
         coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0::DOUBLE) AS rainfall_mm,
         coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0::DOUBLE) AS et0_mm,
         avg(value) / 1.037::DOUBLE AS temp_mean_c, max(value) AS temp_max_c
  FROM events GROUP BY 1, 2)"""


def _over(n: int) -> str:
    return f"OVER (PARTITION BY weather_point_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ROLLED_SQL = f"""
rolled AS (
  SELECT weather_point_id, date,
         {r(f"sum(rainfall_mm) {_over(8)}", 2)} AS rainfall_8day,
         {r(f"sum(rainfall_mm) {_over(16)}", 2)} AS rainfall_16day,
         {r(f"sum(rainfall_mm) {_over(30)}", 2)} AS rainfall_30day,
         {r(f"avg(temp_mean_c) {_over(8)}", 2)} AS temp_8day_mean,
         {r(f"avg(temp_mean_c) {_over(30)}", 2)} AS temp_30day_mean,
         {r(f"max(temp_max_c) {_over(8)}", 2)} AS temp_8day_max,
         {r(f"sum(et0_mm) {_over(8)}", 2)} AS et0_8day_sum,
         {r(f"sum(et0_mm) {_over(16)}", 2)} AS et0_16day_sum
  FROM daily)"""

LABELLED_SQL = f"""
demand AS (
  SELECT *, {r("et0_8day_sum * 0.95::DOUBLE", 2)} AS crop_water_demand_8day_mm FROM rolled),
rain AS (
  SELECT *, {r("least(greatest(rainfall_8day * 0.8::DOUBLE, 0), crop_water_demand_8day_mm)", 2)} AS effective_rainfall_8day_mm FROM demand),
deficit AS (
  SELECT *, {r("greatest(crop_water_demand_8day_mm - effective_rainfall_8day_mm, 0)", 2)} AS water_deficit_8day_mm FROM rain),
labelled AS (
  SELECT *, CASE WHEN water_deficit_8day_mm < 60 THEN 0 WHEN water_deficit_8day_mm > 140 THEN 2 ELSE 1 END AS target_stress_class,
         CASE WHEN water_deficit_8day_mm < 60 THEN 'LOW' WHEN water_deficit_8day_mm > 140 THEN 'HIGH' ELSE 'MODERATE' END AS target_stress_label
  FROM deficit)"""


@query(f"""WITH {DAILY_SQL}, {ROLLED_SQL}
SELECT *, {r("greatest(et0_8day_sum - rainfall_8day, 0)", 2)} AS climatic_water_deficit_8day FROM rolled""")
def rolling_balance(t: Tables) -> DataFrame:
    return weather_features(daily_readings(t)).drop("rainfall_mm", "et0_mm", "temp_mean_c", "temp_max_c")


@query(f"""WITH {DAILY_SQL}, {ROLLED_SQL}, {LABELLED_SQL}
SELECT weather_point_id, date, crop_water_demand_8day_mm, effective_rainfall_8day_mm, water_deficit_8day_mm,
       target_stress_class, target_stress_label FROM labelled""")
def stress_labels(t: Tables) -> DataFrame:
    return labelled_days(t).select(
        "weather_point_id", "date", "crop_water_demand_8day_mm", "effective_rainfall_8day_mm", "water_deficit_8day_mm",
        "target_stress_class", "target_stress_label",
    )


@query(f"""WITH {DAILY_SQL}, {ROLLED_SQL}, {LABELLED_SQL}, classes(position, target_stress_label) AS (VALUES (0, 'LOW'), (1, 'MODERATE'), (2, 'HIGH'))
SELECT c.position, c.target_stress_label, count(l.date) AS rows,
       {r("100::DOUBLE * count(l.date) / (SELECT count(*) FROM labelled)", 2)} AS pct
FROM classes c LEFT JOIN labelled l USING (target_stress_label) GROUP BY 1, 2""")
def stress_share(t: Tables) -> DataFrame:
    return class_shares(labelled_days(t), "target_stress_label", CLASS_LABELS)


@query(f"""WITH d AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax * 100 AS rain, l_discount FROM lineitem),
b AS (
  SELECT *, {r("greatest(l_quantity - rain - least(greatest((l_discount - 0.02::DOUBLE) / 0.16::DOUBLE, 0), 1) * l_quantity * 0.75::DOUBLE, 0)", 2)}
         AS water_deficit_8day_mm FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, water_deficit_8day_mm,
       CASE WHEN water_deficit_8day_mm < 12 THEN 0 WHEN water_deficit_8day_mm > 28 THEN 2 ELSE 1 END AS target_stress_class,
       l_discount >= 0.05::DOUBLE AS is_vegetated
FROM b""")
def buffered_deficit(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("rain", F.col("l_tax") * 100)
    out = buffered_labels(lines, LINE_BALANCE, demand="l_quantity", rain="rain", ndwi="l_discount")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "water_deficit_8day_mm", "target_stress_class",
        water.is_vegetated("l_discount", WaterBalance(min_ndvi=0.05)).alias("is_vegetated"),
    )


@query("""WITH weather AS (
  SELECT c_nationkey AS point, o_orderdate AS day, sum(o_totalprice) AS spend, count(*) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT s_nationkey AS point, count(*) AS rows, sum(w.orders)::BIGINT AS matched_orders, round(sum(l_quantity), 2) AS quantity
FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN weather w ON w.point = s.s_nationkey AND w.day = l.l_shipdate GROUP BY 1""")
def cell_weather_join(t: Tables) -> DataFrame:
    """Cells to points by a left join, then points and days by an inner join. Line items are the cells' rows."""
    points = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("point"))
    weather = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("point"), F.col("o_orderdate").alias("l_shipdate")
    ).agg(F.count(F.lit(1)).alias("orders"))
    joined = t.lineitem.join(points, "l_suppkey", "left").join(weather, ["point", "l_shipdate"])
    return joined.groupBy("point").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("orders").alias("matched_orders"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS cells FROM events GROUP BY 1")
def distinct_cells_per_date(t: Tables) -> DataFrame:
    return cells_per_date(t.events.withColumn("date", F.to_date("ts")), "user_id", "date")


@query("""WITH n AS (SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS cells FROM events GROUP BY 1)
SELECT max(date) AS latest_date FROM n WHERE cells >= 0.9::DOUBLE * (SELECT max(cells) FROM n)""")
def latest_date(t: Tables) -> DataFrame:
    return latest_covered_date(t.events.withColumn("date", F.to_date("ts")), "user_id", "date")


@query(f"""WITH {DAILY_SQL}
SELECT weather_point_id, date, round(rainfall_mm, 2) AS rainfall_mm, round(et0_mm, 2) AS et0_mm, temp_max_c FROM daily""")
def flatten_payload(t: Tables) -> DataFrame:
    """Daily rows packed as parallel arrays per point (one entry per calendar day), and unpacked again."""
    days = daily_readings(t).select(
        "weather_point_id",
        F.struct(F.col("date").cast("string").alias("time"), F.round("rainfall_mm", 2).alias("r"), F.round("et0_mm", 2).alias("e"), F.col("temp_max_c").alias("x")).alias("day"),
    )
    packed = days.groupBy("weather_point_id").agg(F.sort_array(F.collect_list("day")).alias("d")).select(
        "weather_point_id",
        F.struct(
            F.col("d.time").alias("time"), F.col("d.r").alias("precipitation_sum"),
            F.col("d.e").alias("et0_fao_evapotranspiration"), F.col("d.x").alias("temperature_2m_max"),
        ).alias("daily"),
    )
    return flatten_payloads(packed, keys=["weather_point_id"])


def drifting_texts(t: Tables) -> DataFrame:
    """The packed payloads of ``flatten_payload`` as JSON in three versions: numbers; numbers as text and a new field; another
    name for one field and a word in place of every fifth day's temperature."""
    days = daily_readings(t).select(
        "weather_point_id",
        F.struct(F.col("date").cast("string").alias("time"), F.round("rainfall_mm", 2).alias("r"), F.round("et0_mm", 2).alias("e"), F.col("temp_max_c").alias("x")).alias("day"),
    )
    packed = days.groupBy("weather_point_id").agg(F.sort_array(F.collect_list("day")).alias("d"))
    text = lambda c: F.transform(c, lambda v: v.cast("string"))
    worded = F.transform("d", lambda x: F.when(F.dayofmonth(x["time"].cast("date")) % 5 == 0, F.lit("n/a")).otherwise(x["x"].cast("string")))
    daily = lambda **f: F.to_json(F.struct(F.struct(F.col("d.time").alias("time"), *[v.alias(n) for n, v in f.items()]).alias("daily")), {"ignoreNullFields": "false"})
    r, e, x = F.col("d.r"), F.col("d.e"), F.col("d.x")
    version = F.pmod(F.col("weather_point_id"), F.lit(3))
    return packed.select(
        "weather_point_id",
        F.when(version == 0, daily(precipitation_sum=r, et0_fao_evapotranspiration=e, temperature_2m_max=x))
        .when(version == 1, daily(precipitation_sum=text(r), et0_fao_evapotranspiration=text(e), temperature_2m_max=text(x), snowfall_sum=r))
        .otherwise(daily(precipitation_sum=r, et0_evapotranspiration=e, temperature_2m_max=worded)).alias("value"),
    )


@query(f"""WITH {DAILY_SQL}
SELECT weather_point_id, date, round(rainfall_mm, 2) AS rainfall_mm, round(et0_mm, 2) AS et0_mm,
  CASE WHEN weather_point_id % 3 = 2 AND day(date) % 5 = 0 THEN NULL ELSE temp_max_c END AS temp_max_c FROM daily""")
def flatten_drifting(t: Tables) -> DataFrame:
    return weather_payloads.flatten_drifting(drifting_texts(t), keys=["weather_point_id"]).select("weather_point_id", "date", "rainfall_mm", "et0_mm", "temp_max_c")


@query(f"""WITH {DAILY_SQL}, p AS (SELECT weather_point_id, weather_point_id % 3 AS v, count(*) FILTER (WHERE day(date) % 5 = 0) AS words FROM daily GROUP BY 1),
gone AS (SELECT unnest(['temperature_2m_min', 'temperature_2m_mean', 'rain_sum', 'relative_humidity_2m_mean', 'wind_speed_10m_max', 'shortwave_radiation_sum']) AS field)
SELECT field, 'missing' AS problem, count(*) AS payloads, count(*)::BIGINT AS "values" FROM p, gone GROUP BY 1
UNION ALL SELECT 'snowfall_sum', 'unknown', count(*), count(*)::BIGINT FROM p WHERE v = 1 HAVING count(*) > 0
UNION ALL SELECT 'temperature_2m_max', 'mistyped', count(*), sum(words)::BIGINT FROM p WHERE v = 2 AND words > 0 HAVING count(*) > 0""")
def payload_problems(t: Tables) -> DataFrame:
    found = weather_payloads.payload_problems(drifting_texts(t), keys=["weather_point_id"])
    return found.groupBy("field", "problem").agg(F.count("*").alias("payloads"), F.sum("values").alias("values"))
