"""Daily weather payloads: parallel arrays per point, turned into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload field -> table column.
PAYLOAD_COLUMNS = {
    "temperature_2m_max": "temp_max_c",
    "temperature_2m_min": "temp_min_c",
    "temperature_2m_mean": "temp_mean_c",
    "precipitation_sum": "rainfall_mm",
    "rain_sum": "rain_mm",
    "relative_humidity_2m_mean": "humidity_pct",
    "wind_speed_10m_max": "wind_speed_mps",
    "shortwave_radiation_sum": "solar_radiation_mj",
    "et0_fao_evapotranspiration": "et0_mm",
}
PAYLOAD_SCHEMA = "daily struct<time array<string>, " + ", ".join(f"{f} array<double>" for f in PAYLOAD_COLUMNS) + ">"


def flatten_payloads(payloads: DataFrame, daily: str = "daily", keys: Sequence[str] = (), columns: dict[str, str] = PAYLOAD_COLUMNS) -> DataFrame:
    """One row per payload and day, with table column names. A payload without ``time`` fails the query."""
    days = F.coalesce(F.col(f"{daily}.time"), F.raise_error(F.lit("the payload has no daily time list")))
    fields = payloads.schema[daily].dataType
    present = [f for f in columns if f in fields.names]

    def series(name: str) -> Column:
        # A measure that is left out is an empty list, which the zip fills up; a missing list would void the payload.
        return F.coalesce(F.col(f"{daily}.{name}"), F.array().cast(fields[name].dataType)).alias(name)

    zipped = payloads.select(*keys, F.inline(F.arrays_zip(days.alias("time"), *map(series, present))))
    return zipped.select(*keys, F.to_date("time").alias("date"), *[F.col(f).alias(columns[f]) for f in present])


def parse_payloads(texts: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Payload JSON text to daily rows."""
    return flatten_payloads(texts.select(*keys, F.from_json(text, PAYLOAD_SCHEMA)["daily"].alias("daily")), keys=keys)


def issue_forecast(rows: DataFrame, issued_on: Column | None = None) -> DataFrame:
    """Stamp forecast rows with their issue date."""
    return rows.withColumn("forecast_issued_on", F.current_date() if issued_on is None else issued_on)


def append_forecast(rows: DataFrame, path: str) -> None:
    """Store forecasts by issue date; reissuing a date replaces it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("forecast_issued_on").parquet(path)


# Other names that payload fields have had.
FIELD_ALIASES = {
    "windspeed_10m_max": "wind_speed_10m_max", "relativehumidity_2m_mean": "relative_humidity_2m_mean", "et0_evapotranspiration": "et0_fao_evapotranspiration",
}


def _variants(texts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, fields, days): the measures of each payload by their present names, each a list of values of any type. A text
    that is no JSON object with a ``daily`` part has no fields."""
    daily = F.try_variant_get(F.try_parse_json(text), "$.daily", "map<string,variant>")
    names = F.create_map(*[F.lit(v) for pair in FIELD_ALIASES.items() for v in pair])
    present = F.transform(F.map_entries(daily), lambda e: F.struct(F.coalesce(F.try_element_at(names, e["key"]), e["key"]).alias("key"), F.try_variant_get(e["value"], "$", "array<variant>").alias("value")))
    read = texts.select(*keys, daily.isNotNull().alias("_readable"), present.alias("fields"))
    time = F.filter("fields", lambda e: e["key"] == "time")
    days = F.transform(F.get(time, F.lit(0))["value"], lambda v: F.try_variant_get(v, "$", "date"))
    return read.withColumn("days", days)


def _field(name: str) -> Column:
    return F.get(F.filter("fields", lambda e: e["key"] == name), F.lit(0))["value"]


def flatten_drifting(texts: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """One row per payload and day from payload texts of several schema versions.

    Fields may have another name, hold numbers as text, be missing, be new, or hold values of a wrong type; a value that cannot be
    read as a number is missing. Payloads that cannot be read give no row. ``payload_problems`` lists what was found.
    """
    measures = {c: F.transform(_field(f), lambda v: F.try_variant_get(v, "$", "double")) for f, c in PAYLOAD_COLUMNS.items()}
    empty = F.array().cast("array<double>")
    zipped = _variants(texts, text, keys).select(*keys, "days", *[F.coalesce(v, empty).alias(c) for c, v in measures.items()])
    rows = zipped.select(*keys, F.inline(F.arrays_zip("days", *measures)))
    return rows.filter(F.col("days").isNotNull()).withColumnRenamed("days", "date")


def payload_problems(texts: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, field, problem, values): unreadable payloads, payloads without days, fields that no column takes, fields that are
    missing, and fields with values of a wrong type, with their number."""
    known = F.array(*[F.lit(f) for f in ("time", *PAYLOAD_COLUMNS)])
    wrong = lambda of, kind: F.size(F.filter(of, lambda v: v.isNotNull() & (F.schema_of_variant(v) != "VOID") & F.try_variant_get(v, "$", kind).isNull()))
    one = lambda field, problem, n: F.struct(field.alias("field"), F.lit(problem).alias("problem"), n.cast("long").alias("values"))
    rows = _variants(texts, text, keys)
    fields = F.coalesce("fields", F.array().cast("array<struct<key:string,value:array<variant>>>"))
    names = F.transform(fields, lambda e: e["key"])
    unknown = F.transform(F.array_except(names, known), lambda n: one(n, "unknown", F.lit(1)))
    missing = F.transform(F.array_except(known, names), lambda n: one(n, "missing", F.lit(1)))
    mistyped = F.transform(
        F.filter(fields, lambda e: F.array_contains(known, e["key"])),
        lambda e: one(e["key"], "mistyped", F.when(e["value"].isNull(), F.lit(1)).when(e["key"] == "time", wrong(e["value"], "date")).otherwise(wrong(e["value"], "double"))),
    )
    unreadable = F.array(one(F.lit(None).cast("string"), "unreadable", F.lit(1)))
    found = F.when(F.col("_readable"), F.concat(unknown, missing, F.filter(mistyped, lambda m: m["values"] > 0))).otherwise(unreadable)
    return rows.select(*keys, F.inline(found))
