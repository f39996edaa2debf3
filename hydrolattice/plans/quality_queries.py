"""Checks and profiles over the generic tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..operators import profile, quality
from ..settings import Quality, Settings, Training
from ..sources.tables import write_json_documents
from ..streaming.runs import new_run
from .registry import Tables, query, r
from .weather_queries import DAILY_SQL, daily_readings

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
RANGES = {"l_quantity": (2.0, 48.0), "l_extendedprice": (1000.0, 90000.0), "l_discount": (0.0, 0.1), "l_tax": (0.01, 0.07)}


@query("""SELECT l_returnflag, count(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 48) AS l_quantity,
  count(*) FILTER (WHERE l_extendedprice < 1000 OR l_extendedprice > 90000) AS l_extendedprice,
  count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.1::DOUBLE) AS l_discount,
  count(*) FILTER (WHERE l_tax < 0.01::DOUBLE OR l_tax > 0.07::DOUBLE) AS l_tax
FROM lineitem GROUP BY 1""")
def range_checks(t: Tables) -> DataFrame:
    return quality.range_violations(t.lineitem, RANGES, ["l_returnflag"])


@query(f"""SELECT lang, {r("avg(CASE WHEN quality IS NULL THEN 1::DOUBLE ELSE 0 END)", 4)} AS quality, {r("avg(CASE WHEN toxic IS NULL THEN 1::DOUBLE ELSE 0 END)", 4)} AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def missing_checks(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    shares = quality.missing_shares(joined, ["quality", "toxic"], ["lang"])
    return shares.select("lang", *[(F.rint(F.col(c) * 10000.0) / 10000.0).alias(c) for c in ("quality", "toxic")])


@query("""SELECT event_type, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date,
  min(CAST(ts AS DATE)) <= DATE '2024-01-01' AND max(CAST(ts AS DATE)) >= DATE '2024-01-30' AS covered FROM events GROUP BY 1""")
def date_coverage(t: Tables) -> DataFrame:
    return quality.date_coverage(t.events, "ts", date(2024, 1, 1), date(2024, 1, 30), ["event_type"])


@query("""WITH n AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS d FROM events GROUP BY 1)
SELECT min(d) AS fewest_days, max(d) AS most_days, min(d) = max(d) AS no_gaps FROM n""")
def group_gap_check(t: Tables) -> DataFrame:
    return quality.days_per_group(t.events, "user_id", "ts")


@query("SELECT l_linenumber, count(*) AS rows FROM lineitem WHERE l_linenumber NOT IN (0, 1, 2) GROUP BY 1")
def label_domain(t: Tables) -> DataFrame:
    return quality.label_domain(t.lineitem, "l_linenumber")


@query("""WITH n AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT sum(n - 1)::BIGINT AS duplicates, count(*) FILTER (WHERE n > 1) AS repeated_keys FROM n""")
def duplicate_keys(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT count(DISTINCT CAST(l_shipdate AS DATE)) AS dates,
  count(DISTINCT CAST(l_shipdate AS DATE)) FILTER (WHERE l_shipdate < DATE '1999-01-01') AS dates_before,
  count(DISTINCT CAST(l_shipdate AS DATE)) FILTER (WHERE l_shipdate >= DATE '1999-01-01') AS dates_after,
  count(DISTINCT l_returnflag) FILTER (WHERE l_shipdate >= DATE '1999-01-01' AND l_quantity > 25) AS later_classes FROM lineitem""")
def split_coverage(t: Tables) -> DataFrame:
    return quality.split_coverage(t.lineitem, "l_shipdate", date(1999, 1, 1), "l_returnflag", F.col("l_quantity") > 25)


def weather_table(t: Tables) -> DataFrame:
    """Daily readings with the columns the weather suite needs. Sums and means are held to six digits, so that one which lies
    on a limit is on it in whatever order its events were added."""
    held = daily_readings(t).withColumns({c: round_even(c, 6) for c in ("rainfall_mm", "et0_mm", "temp_mean_c")})
    return held.withColumns({
        "humidity_pct": F.when(F.col("temp_mean_c") > 10, F.col("temp_mean_c") * 3), "wind_speed_mps": F.col("temp_mean_c") / 4, "solar_radiation_mj": F.lit(20.0),
    })


EVENT_SETTINGS = Settings(quality=Quality(weather_start=date(2024, 1, 1), weather_end=date(2024, 1, 30)))


def _flat(checks: DataFrame) -> DataFrame:
    """Checks with their offending entries as one text."""
    return checks.withColumn("offending", F.array_join("offending", ", "))


def _ranges_sql(table: str, ranges: dict[str, tuple[float, float]]) -> str:
    """One row of the range check: columns within range, and each broken one with its rows outside."""
    counts = " UNION ALL ".join(
        f"SELECT {i} AS place, '{c}' AS name, count(*) FILTER (WHERE {c} < {low}::DOUBLE OR {c} > {high}::DOUBLE) AS n FROM {table}" for i, (c, (low, high)) in enumerate(ranges.items())
    )
    return f"""SELECT 'value_ranges', bool_and(n = 0), (count(*) FILTER (WHERE n = 0))::VARCHAR, '{len(ranges)}', coalesce(string_agg(name || '=' || n, ', ' ORDER BY place) FILTER (WHERE n > 0), '') FROM ({counts})"""


def _missing_sql(table: str, columns: list[str], limit: float) -> str:
    """One row of the missing-value check, with every share worked out from the table."""
    shares = " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name, avg(CASE WHEN {c} IS NULL THEN 1::DOUBLE ELSE 0 END) AS s FROM {table}" for i, c in enumerate(columns))
    return f"""SELECT 'missing_values', bool_and(s <= {limit}::DOUBLE), max(round(s, 4))::VARCHAR, '{limit}', coalesce(string_agg(name || '=' || round(s, 4), ', ' ORDER BY place) FILTER (WHERE s > {limit}::DOUBLE), '') FROM ({shares})"""


# Limits of the suite, written out for the SQL side.
WEATHER_LIMITS = {
    "temp_max_c": (-5, 55), "temp_mean_c": (-5, 50), "rainfall_mm": (0, 500), "humidity_pct": (0, 100), "wind_speed_mps": (0, 40), "solar_radiation_mj": (0, 45), "et0_mm": (0, 20),
}


@query(f"""WITH {DAILY_SQL}, held AS (SELECT * REPLACE ({r("rainfall_mm", 6)} AS rainfall_mm, {r("et0_mm", 6)} AS et0_mm, {r("temp_mean_c", 6)} AS temp_mean_c) FROM daily),
w AS (SELECT *, CASE WHEN temp_mean_c > 10 THEN temp_mean_c * 3 END AS humidity_pct, temp_mean_c / 4 AS wind_speed_mps, 20::DOUBLE AS solar_radiation_mj FROM held),
p AS (SELECT weather_point_id, count(DISTINCT date) AS d FROM w GROUP BY 1)
SELECT 'required_columns' AS "check", true AS passed, '9' AS observed, '9' AS required, '' AS offending
UNION ALL {_ranges_sql("w", WEATHER_LIMITS)}
UNION ALL {_missing_sql("w", ["date", "weather_point_id", *WEATHER_LIMITS], 0.01)}
UNION ALL SELECT 'date_coverage', min(date) <= DATE '2024-01-01' AND max(date) >= DATE '2024-01-30', CAST(min(date) AS DATE) || '/' || CAST(max(date) AS DATE), '2024-01-01/2024-01-30', '' FROM w
UNION ALL SELECT 'no_gaps_between_points', min(d) = max(d), min(d) || '/' || max(d), 'equal', '' FROM p""")
def weather_suite(t: Tables) -> DataFrame:
    return _flat(quality.weather_suite(weather_table(t), EVENT_SETTINGS))


@query(f"""WITH m AS (SELECT o_orderkey::VARCHAR AS scene_id, CAST(o_orderdate AS DATE) AS acquisition_date, o_totalprice AS cloud_cover_pct,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS mgrs_tile FROM orders),
w AS (SELECT min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem)
SELECT 'required_columns' AS "check", true AS passed, '4' AS observed, '4' AS required, '' AS offending
UNION ALL SELECT 'scene_count', count(DISTINCT acquisition_date) >= 20, count(DISTINCT acquisition_date)::VARCHAR, '20', '' FROM m
UNION ALL {_missing_sql("m", ["scene_id", "acquisition_date", "cloud_cover_pct", "mgrs_tile"], 0.0)}
UNION ALL SELECT 'weather_covers_scenes', (SELECT a FROM w) <= min(acquisition_date) AND (SELECT b FROM w) >= max(acquisition_date),
  (SELECT a || '/' || b FROM w), min(acquisition_date) || '/' || max(acquisition_date), '' FROM m""")
def scene_suite(t: Tables) -> DataFrame:
    scenes = t.orders.select(
        F.col("o_orderkey").cast("string").alias("scene_id"), F.to_date("o_orderdate").alias("acquisition_date"),
        F.col("o_totalprice").alias("cloud_cover_pct"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("mgrs_tile"),
    )
    return _flat(quality.scene_suite(scenes, t.lineitem, weather_date="l_shipdate"))


FEATURE_INPUTS = ("ndvi_mean", "ndwi_mean", "evi_mean", "temp_max_c", "rainfall_8day")
FEATURE_LIMITS = {"ndvi_mean": (-1, 1), "ndwi_mean": (-1, 1), "evi_mean": (-5, 5), "temp_max_c": (-5, 55), "rainfall_8day": (0, 1500)}
LINE_TRAINING = Settings(training=Training(split=date(1999, 1, 1), target="l_linenumber", features=FEATURE_INPUTS))


FEATURE_SQL = f"""WITH f AS (SELECT l_orderkey AS cell_id, CAST(l_shipdate AS DATE) AS date, l_linenumber, l_quantity > 5 AS is_vegetated, l_quantity / 40 AS ndvi_mean,
  l_discount - 1.02::DOUBLE AS ndwi_mean, CASE WHEN l_tax > 0.005::DOUBLE THEN l_tax END AS evi_mean, l_quantity + 6 AS temp_max_c, l_extendedprice / 100 AS rainfall_8day FROM lineitem),
dup AS (SELECT sum(n - 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM f GROUP BY cell_id, date)),
c AS (SELECT count(DISTINCT date) AS a, count(DISTINCT date) FILTER (WHERE date < DATE '1999-01-01') AS b, count(DISTINCT date) FILTER (WHERE date >= DATE '1999-01-01') AS e,
      count(DISTINCT l_linenumber) FILTER (WHERE date >= DATE '1999-01-01' AND is_vegetated) AS k FROM f),
bad AS (SELECT DISTINCT l_linenumber AS l FROM f WHERE l_linenumber NOT IN (0, 1, 2))
SELECT 'required_columns' AS "check", true AS passed, '9' AS observed, '9' AS required, '' AS offending
UNION ALL {_ranges_sql("f", FEATURE_LIMITS)}
UNION ALL {_missing_sql("f", ["cell_id", "date", "is_vegetated", "l_linenumber", *FEATURE_INPUTS], 0.01)}
UNION ALL SELECT 'label_values', count(*) = 0, count(*)::VARCHAR, '0', coalesce(string_agg(l::VARCHAR, ', ' ORDER BY l), '') FROM bad
UNION ALL SELECT 'one_row_per_cell_and_date', n = 0, n::VARCHAR, '0', '' FROM dup
UNION ALL SELECT 'date_coverage', a >= 20 AND b > 0 AND e > 0, a || '/' || b || '/' || e, '20/1/1', '' FROM c
UNION ALL SELECT 'all_classes_in_later_dates', k = 3, k::VARCHAR, '3', '' FROM c"""


def line_features(t: Tables) -> DataFrame:
    """Line items as a feature table that breaks the range, missing-value, label and duplicate rules."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("cell_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_quantity") > 5).alias("is_vegetated"), "l_linenumber",
        (F.col("l_quantity") / 40).alias("ndvi_mean"), (F.col("l_discount") - 1.02).alias("ndwi_mean"), F.when(F.col("l_tax") > 0.005, F.col("l_tax")).alias("evi_mean"),
        (F.col("l_quantity") + 6).alias("temp_max_c"), (F.col("l_extendedprice") / 100).alias("rainfall_8day"),
    )


@query(FEATURE_SQL)
def feature_suite(t: Tables) -> DataFrame:
    return _flat(quality.feature_suite(line_features(t), LINE_TRAINING))


@query(f"""WITH c AS ({FEATURE_SQL})
SELECT 'features' AS stage, bool_and(passed) AS passed, (SELECT count(*) FROM lineitem) AS rows, string_agg("check", ',' ORDER BY "check") FILTER (WHERE NOT passed) AS failed FROM c""")
def validation_report(t: Tables) -> DataFrame:
    """The report of the feature stage: one document, stored and read back."""
    table = line_features(t)
    place = f"{new_run(t.spark, 'report')}/features"
    write_json_documents(quality.report(quality.feature_suite(table, LINE_TRAINING), "features", {"features": table}), place)
    stored = t.spark.read.json(place)
    failed = F.array_sort(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["check"]))
    return stored.select("stage", "passed", F.col("rows.features").alias("rows"), F.array_join(failed, ",").alias("failed"))


@query(f"""WITH f AS (SELECT l_quantity / 40 AS ndvi_mean, l_discount - 1.02::DOUBLE AS ndwi_mean, CASE WHEN l_tax > 0.005::DOUBLE THEN l_tax END AS evi_mean,
  l_quantity + 6 AS temp_max_c, l_extendedprice / 100 AS rainfall_8day FROM lineitem)
SELECT * FROM (SELECT NULL::VARCHAR AS "check", NULL::BOOLEAN AS passed, NULL::VARCHAR AS observed, NULL::VARCHAR AS required, NULL::VARCHAR AS offending WHERE false)
UNION ALL {_ranges_sql("f", FEATURE_LIMITS)} UNION ALL {_missing_sql("f", list(FEATURE_INPUTS), 0.01)}""")
def checked_write(t: Tables) -> DataFrame:
    """Range and missing-value checks of a table, collected while it is written."""
    return _flat(quality.checked_write(line_features(t), f"{new_run(t.spark, 'checked')}/features", FEATURE_LIMITS, FEATURE_INPUTS, 0.01))




_NUMERIC_SQL = " UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS count, {r(f"avg({c})", 4)} AS mean, {r(f"stddev_samp({c})", 4)} AS std, {r(f"min({c})", 4)} AS min,
  {r(f"quantile_cont({c}, 0.25)", 4)} AS q25, {r(f"quantile_cont({c}, 0.5)", 4)} AS q50, {r(f"quantile_cont({c}, 0.75)", 4)} AS q75, {r(f"max({c})", 4)} AS max
  FROM lineitem GROUP BY 1"""
    for c in NUMBERS
)


@query(_NUMERIC_SQL)
def profile_numeric(t: Tables) -> DataFrame:
    return profile.describe(t.lineitem, NUMBERS, ["l_returnflag"])


CORRELATED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey")
_CORR_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {r(f"corr({c}, l_linenumber)", 4)} AS corr FROM lineitem""" for c in CORRELATED)


@query(_CORR_SQL)
def corr_ranked(t: Tables) -> DataFrame:
    return profile.correlations(t.lineitem, CORRELATED, "l_linenumber")


@query(f"""WITH c AS ({_CORR_SQL})
SELECT * FROM (SELECT *, 'top' AS side FROM c ORDER BY corr DESC, "column" LIMIT 3) UNION ALL
SELECT * FROM (SELECT *, 'bottom' AS side FROM c ORDER BY corr, "column" LIMIT 2)""")
def corr_extremes(t: Tables) -> DataFrame:
    return profile.extreme_correlations(profile.correlations(t.lineitem, CORRELATED, "l_linenumber"), 3, 2)


@query(f"""SELECT l_returnflag, {r("avg(l_quantity)", 4)} AS l_quantity, {r("avg(l_discount)", 4)} AS l_discount, {r("avg(l_tax)", 4)} AS l_tax FROM lineitem GROUP BY 1""")
def group_means(t: Tables) -> DataFrame:
    return profile.group_means(t.lineitem, "l_returnflag", ["l_quantity", "l_discount", "l_tax"])


@query("""SELECT count(*) AS rows, 11 AS columns, count(DISTINCT l_suppkey) AS cells, count(DISTINCT CAST(l_shipdate AS DATE)) AS dates,
  min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date,
  count(*) FILTER (WHERE l_quantity > 10) AS vegetated_rows, count(*) FILTER (WHERE l_quantity <= 10) AS other_rows FROM lineitem""")
def dataset_profile(t: Tables) -> DataFrame:
    return profile.dataset_profile(t.lineitem, "l_suppkey", "l_shipdate", F.col("l_quantity") > 10)


_AUDITED = ("doc_id", "lang", "quality", "toxic")


@query("WITH j AS (SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing, {r(f"100::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*)", 2)} AS missing_pct FROM j"""
    for c in _AUDITED
))
def missing_audit(t: Tables) -> DataFrame:
    return profile.missing_audit(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select(*_AUDITED))
