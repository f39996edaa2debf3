"""Advisories, map layers, samples and KPIs on the labelled days of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import advice
from ..operators import kpi, maps
from ..streaming.kpi_view import KpiView
from ..streaming.runs import new_run
from .registry import Tables, query, r
from .weather_queries import DAILY_SQL, LABELLED_SQL, ROLLED_SQL, labelled_days


def scored_days(t: Tables) -> DataFrame:
    """Labelled days as scored cells: class as code, wetness and confidence from the readings."""
    return labelled_days(t).select(
        F.col("weather_point_id").alias("cell_id"), "date", F.col("target_stress_class").alias("stress_code"),
        (F.col("temp_mean_c") / 100).alias("ndvi_mean"), (F.col("temp_8day_mean") / 1000 - 0.03).alias("ndwi_mean"),
        F.col("temp_8day_mean").alias("temp_max_c"), F.col("et0_8day_sum"), F.col("rainfall_8day"),
        (F.lit(1.0) - F.col("weather_point_id") % 50 / 100).alias("confidence"),
    )


SCORED_SQL = f"""{DAILY_SQL}, {ROLLED_SQL}, {LABELLED_SQL},
scored AS (
  SELECT l.weather_point_id AS cell_id, l.date, target_stress_class AS stress_code, d.temp_mean_c / 100 AS ndvi_mean, temp_8day_mean / 1000 - 0.03::DOUBLE AS ndwi_mean,
    temp_8day_mean AS temp_max_c, et0_8day_sum, rainfall_8day, 1 - (l.weather_point_id % 50) / 100::DOUBLE AS confidence
  FROM labelled l JOIN daily d USING (weather_point_id, date)),
ruled AS (
  SELECT *, CASE WHEN stress_code = 2 AND (temp_max_c >= 33 OR et0_8day_sum >= 35 OR ndwi_mean < 0.02::DOUBLE) THEN 1 WHEN stress_code = 2 THEN 2
    WHEN stress_code = 1 AND rainfall_8day > 5 THEN 3 WHEN stress_code = 1 THEN 4 ELSE 5 END AS rule FROM scored),
advised AS (
  SELECT *, CASE rule WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 3 END AS priority,
    CASE rule WHEN 1 THEN '#dc3545' WHEN 2 THEN '#ffc107' WHEN 4 THEN '#fd7e14' ELSE '#28a745' END AS color FROM ruled)"""


@query(f"WITH {SCORED_SQL} SELECT cell_id, date, stress_code, rule, priority, color FROM advised")
def advisory_rules(t: Tables) -> DataFrame:
    return maps.with_priority(scored_days(t)).select("cell_id", "date", "stress_code", "rule", "priority", "color")


def _text_sql(field: str, language: str) -> str:
    at = advice.FIELDS.index(field)

    def one(text: str) -> str:
        quoted = "'" + text.replace("'", "''") + "'"
        for name, fmt, column, digits in (("{temp}", "%.1f", "temp_max_c", 1), ("{ndwi}", "%.2f", "ndwi_mean", 2), ("{rain}", "%.1f", "rainfall_8day", 1)):
            if name in text:
                quoted = f"replace({quoted}, '{name}', printf('{fmt}', {r(column, digits)}))"
        return quoted

    def value(rule: int) -> str:
        text = advice.TEXTS[rule][language][at]
        return " || '|' || ".join(one(s) for s in text) if isinstance(text, list) else one(text)

    return "CASE rule " + " ".join(f"WHEN {n} THEN {value(n)}" for n in advice.TEXTS) + " END"


def _localised_sql(field: str) -> str:
    return f"CASE lang WHEN 'mr' THEN {_text_sql(field, 'mr')} WHEN 'hi' THEN {_text_sql(field, 'hi')} ELSE {_text_sql(field, 'en')} END"


@query(f"""WITH {SCORED_SQL}, spoken AS (SELECT *, CASE cell_id % 4 WHEN 0 THEN 'mr' WHEN 1 THEN 'hi' ELSE 'en' END AS lang FROM advised)
SELECT cell_id, date, ['LOW', 'MODERATE', 'HIGH'][stress_code + 1] AS stress_class_label, {r("confidence * 100", 1)} AS confidence_pct,
  'PRIORITY ' || priority AS priority_label, {_localised_sql("urgency")} AS urgency, {_localised_sql("title")} AS title,
  {_localised_sql("recommendation")} AS recommendation, {_localised_sql("actionable_steps")} AS actionable_steps, lang AS language FROM spoken""")
def advisory_localised(t: Tables) -> DataFrame:
    """Each cell asks in its own language; an unknown one gets English."""
    language = F.element_at(F.array(F.lit("MR"), F.lit("hi"), F.lit("en"), F.lit("ta")), (F.col("cell_id") % 4 + 1).cast("int"))
    inputs = ("stress_code", "confidence", "ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day")
    told = scored_days(t).select("cell_id", "date", advice.advisory_in(language, *inputs).alias("a"))
    return told.select(
        "cell_id", "date", *[F.col(f"a.{f}").alias(f) for f in ("stress_class_label", "confidence_pct", "priority_label", "urgency", "title", "recommendation")],
        F.array_join("a.actionable_steps", "|").alias("actionable_steps"), F.col("a.language").alias("language"),
    )


def _layer(t: Tables, layer: str) -> DataFrame:
    places = t.customer.select(
        F.col("c_custkey").alias("cell_id"), maps.box_geometry(F.col("c_nationkey").cast("double"), F.col("c_acctbal"), F.col("c_nationkey") + 1.5, F.col("c_acctbal") + 2).alias("geometry")
    )
    return maps.map_layer(scored_days(t), places, layer=layer)


@query(f"""WITH {SCORED_SQL}
SELECT cell_id, date, 'Polygon' AS shape, c_nationkey::DOUBLE AS minx, ['LOW', 'MODERATE', 'HIGH'][stress_code + 1] AS stress_class,
  ['#28a745', '#ffc107', '#dc3545'][stress_code + 1] AS fill_color, {r("ndvi_mean", 3)} AS ndvi, {r("ndwi_mean", 3)} AS ndwi
FROM advised JOIN customer ON c_custkey = cell_id""")
def stress_layer(t: Tables) -> DataFrame:
    """The stress layer's GeoJSON text, read back."""
    at = {"shape": "$.geometry.type", "minx": "$.geometry.coordinates[0][0][0]", "stress_class": "$.properties.stress_class",
          "fill_color": "$.properties.fill_color", "ndvi": "$.properties.ndvi", "ndwi": "$.properties.ndwi"}
    out = _layer(t, "stress").select("cell_id", "date", *[F.get_json_object("value", p).alias(n) for n, p in at.items()])
    return out.withColumns({c: F.col(c).cast("double") for c in ("minx", "ndvi", "ndwi")})


@query(f"""WITH {SCORED_SQL}
SELECT cell_id, date, priority, 'Priority ' || priority AS priority_label, color AS fill_color, {_text_sql("title", "hi")} AS title_hi, {_text_sql("urgency", "mr")} AS urgency_mr
FROM advised JOIN customer ON c_custkey = cell_id""")
def irrigation_layer(t: Tables) -> DataFrame:
    names = ("priority", "priority_label", "fill_color", "title_hi", "urgency_mr")
    out = _layer(t, "irrigation").select("cell_id", "date", *[F.get_json_object("value", f"$.properties.{n}").alias(n) for n in names])
    return out.withColumn("priority", F.col("priority").cast("int"))


@query(f"""WITH {SCORED_SQL}, wanted AS (SELECT DISTINCT c_custkey AS cell_id, DATE '2024-01-01' + c_nationkey AS date FROM customer)
SELECT cell_id, date, stress_code, priority, {_text_sql("title", "mr")} AS title FROM advised JOIN wanted USING (cell_id, date)""")
def cell_lookup(t: Tables) -> DataFrame:
    """Details of one (date, cell) pair per customer."""
    requests = t.customer.select(F.col("c_custkey").alias("cell_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey")).alias("date"))
    found = maps.cell_details(scored_days(t), requests, language="mr")
    return found.select("cell_id", "date", "stress_code", F.col("advisory.priority").alias("priority"), F.col("advisory.title").alias("title"))


STRIDE_SQL = """numbered AS (
  SELECT CAST(ts AS DATE) AS date, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS total_cells FROM events),
sampled AS (
  SELECT date, event_id, total_cells FROM numbered
  WHERE total_cells <= 40 OR (i % greatest(1, total_cells // 40) = 0 AND i // greatest(1, total_cells // 40) < 40))"""


def _strided(t: Tables) -> DataFrame:
    return maps.stride_sample(t.events.select(F.to_date("ts").alias("date"), "event_id"), order="event_id", limit=40)


@query(f"WITH {STRIDE_SQL} SELECT * FROM sampled")
def stride_sample(t: Tables) -> DataFrame:
    return _strided(t)


@query(f"WITH {STRIDE_SQL} SELECT date, max(total_cells) AS total_cells, count(*) AS sampled_cells, count(*) < max(total_cells) AS is_sampled FROM sampled GROUP BY 1")
def stride_sample_counts(t: Tables) -> DataFrame:
    return maps.sample_metadata(_strided(t))


def _kpis(t: Tables) -> DataFrame:
    return kpi.cycle_kpis(maps.with_priority(scored_days(t)), vegetated=F.col("ndvi_mean") >= 0.15)


def _ha(column: str) -> str:
    return f"round_even({column} * 6.25::DOUBLE, 1)"


def _pct(column: str) -> str:
    return f"coalesce({r(f'{column} / crop::DOUBLE * 100', 1)}, 0)"


KPI_SQL = f"""{SCORED_SQL},
veg AS (SELECT *, ndvi_mean >= 0.15::DOUBLE AS v FROM advised),
n AS (
  SELECT date AS cycle_date, count(DISTINCT cell_id) AS cells, count(*) FILTER (WHERE v) AS crop,
    count(*) FILTER (WHERE v AND stress_code = 2) AS s2, count(*) FILTER (WHERE v AND stress_code = 1) AS s1, count(*) FILTER (WHERE v AND stress_code = 0) AS s0,
    count(*) FILTER (WHERE v AND priority = 1) AS p1, count(*) FILTER (WHERE v AND priority = 2) AS p2, count(*) FILTER (WHERE v AND priority = 3) AS p3,
    avg(ndvi_mean) FILTER (WHERE v) AS ndvi, avg(ndwi_mean) FILTER (WHERE v) AS ndwi
  FROM veg GROUP BY 1),
kpi AS (
  SELECT cycle_date, cells AS total_culturable_cells, crop AS active_cultivated_cells, cells - crop AS fallow_or_bare_cells, {_ha("crop")} AS total_cultivated_hectares,
    {_ha("s2")} AS high_stress_hectares, {_pct("s2")} AS high_stress_pct, {_ha("s1")} AS moderate_stress_hectares, {_pct("s1")} AS moderate_stress_pct,
    {_ha("s0")} AS low_stress_hectares, {_pct("s0")} AS low_stress_pct, {_ha("p1")} AS priority_1_urgent_ha, {_pct("p1")} AS priority_1_pct,
    {_ha("p2")} AS priority_2_scheduled_ha, {_pct("p2")} AS priority_2_pct, {_ha("p3")} AS priority_3_normal_ha, {_pct("p3")} AS priority_3_pct,
    {r("ndvi", 3)} AS mean_ndvi, {r("ndwi", 3)} AS mean_ndwi
  FROM n WHERE crop > 0)"""


@query(f"WITH {KPI_SQL} SELECT * FROM kpi")
def cycle_kpis(t: Tables) -> DataFrame:
    return _kpis(t)


@query(f"WITH {KPI_SQL} SELECT * FROM kpi")
def kpi_view(t: Tables) -> DataFrame:
    """The same KPIs from three batches: first drafts of all cells, then two batches that replace a part of them each."""
    rows = maps.with_priority(scored_days(t)).withColumn("is_vegetated", F.col("ndvi_mean") >= 0.15)
    run = new_run(t.spark, "kpi_view")
    view = KpiView(t.spark, f"{run}/results", f"{run}/changes")
    turn = F.pmod(F.xxhash64("cell_id"), F.lit(3))
    draft = rows.withColumns({
        "stress_code": F.when(turn == 0, F.col("stress_code")).otherwise((F.col("stress_code") + 1) % 3), "priority": F.when(turn == 0, F.col("priority")).otherwise(F.lit(1)),
        "ndvi_mean": F.when(turn == 0, F.col("ndvi_mean")).otherwise(F.lit(0.9)), "is_vegetated": F.when(turn == 0, F.col("is_vegetated")).otherwise(F.lit(True)),
    })
    for number, batch in enumerate((draft, rows.filter(turn == 1), rows.filter(turn == 2))):
        view.add(batch, number)
    return view.kpis()


@query(f"""WITH {KPI_SQL} SELECT cycle_date, 'HIGH' AS stress_class, high_stress_hectares AS hectares FROM kpi
UNION ALL SELECT cycle_date, 'MODERATE', moderate_stress_hectares FROM kpi UNION ALL SELECT cycle_date, 'LOW', low_stress_hectares FROM kpi""")
def cycle_kpis_long(t: Tables) -> DataFrame:
    return kpi.class_areas(_kpis(t))


@query(f"""WITH {KPI_SQL} SELECT cycle_date::VARCHAR AS cycle_date, active_cultivated_cells, high_stress_pct, priority_2_scheduled_ha, mean_ndwi FROM kpi""")
def kpi_document(t: Tables) -> DataFrame:
    """The nested KPI document as JSON, read back."""
    document = kpi.nested_kpis(_kpis(t)).select(F.to_json(F.struct("*")).alias("value"))
    at = {"cycle_date": "$.cycle_date", "active_cultivated_cells": "$.active_cultivated_cells", "high_stress_pct": "$.stress_breakdown.high_stress_pct",
          "priority_2_scheduled_ha": "$.irrigation_priority_breakdown.priority_2_scheduled_ha", "mean_ndwi": "$.mean_canopy_metrics.mean_ndwi"}
    out = document.select(*[F.get_json_object("value", p).alias(n) for n, p in at.items()])
    return out.withColumns({"active_cultivated_cells": F.col("active_cultivated_cells").cast("long"), **{c: F.col(c).cast("double") for c in ("high_stress_pct", "priority_2_scheduled_ha", "mean_ndwi")}})
