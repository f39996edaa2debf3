"""Request-log windows on events: as batch jobs, and as streams read from the same files."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import requests, sketches
from ..streaming.runs import new_run
from ..streaming.windows import WindowRun, run_windows
from .registry import Tables, query, r


def _failed():
    return F.col("event_type") == "error"



def _bucket_sql(bounds=requests.LATENCY_BOUNDS_MS) -> tuple[str, str]:
    counts = ", ".join(f"count(*) FILTER (WHERE value <= {b}::DOUBLE) AS le_{i}" for i, b in enumerate(bounds))
    cases = ""
    for i, b in enumerate(bounds):
        low, below = (0.0, "0") if i == 0 else (bounds[i - 1], f"le_{i - 1}")
        cases += f" WHEN le_{i} >= requests * 0.95::DOUBLE THEN {low}::DOUBLE + {b - low}::DOUBLE * coalesce((requests * 0.95::DOUBLE - {below}) / nullif(le_{i} - {below}, 0), 0)"
    return counts, f"CASE{cases} ELSE {bounds[-1]}::DOUBLE END"


_COUNTS, _QUANTILE = _bucket_sql()
_START = "strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S')"
RATE_SQL = f"""WITH w AS (
  SELECT event_type, (epoch_us(ts) // 10000000) * 10000000 - 10000000 * k AS s FROM (SELECT ts, event_type, unnest([0, 1, 2, 3, 4, 5]) AS k FROM events))
SELECT strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS requests, {r("count(*) / 60::DOUBLE", 4)} AS rate FROM w GROUP BY 1, 2"""
ERROR_SQL = f"""SELECT {_START} AS window_start, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS requests,
  {r("(count(*) FILTER (WHERE event_type = 'error'))::DOUBLE / count(*)", 4)} AS error_ratio FROM events GROUP BY 1"""
P95_SQL = f"""WITH n AS (SELECT {_START} AS window_start, event_type, count(value) AS requests, {_COUNTS} FROM events GROUP BY 1, 2)
SELECT window_start, event_type, requests, {r(_QUANTILE, 3)} AS latency_ms, le_{len(requests.LATENCY_BOUNDS_MS) - 1} < requests * 0.95::DOUBLE AS over_bound FROM n"""
CLASS_SQL = f"SELECT {_START} AS window_start, event_type, count(*) AS predictions FROM events GROUP BY 1, 2"


def _text_start(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def _same(counts: DataFrame) -> DataFrame:
    return counts


def _rate(log: DataFrame) -> DataFrame:
    return requests.request_counts(log, ["event_type"])


def _errors(log: DataFrame) -> DataFrame:
    return requests.error_counts(log, _failed())


def _p95(log: DataFrame) -> DataFrame:
    return requests.latency_counts(log, ["event_type"], "value")


def _classes(log: DataFrame) -> DataFrame:
    return requests.class_counts(log, "event_type")


def _batch(t: Tables, count, finish=_same) -> DataFrame:
    return _text_start(finish(count(requests.request_log(t.events))))


def window_run(t: Tables, name: str, count, keys=("window_start", "event_type"), minutes: int = 5) -> WindowRun:
    """The log read as a file stream to its end, with the state of open windows and a ledger of late rows."""
    log = t.stream("events", maxFilesPerTrigger=1000)
    return run_windows(log, new_run(t.spark, name), lambda rows: count(requests.request_log(rows)), keys, width=timedelta(minutes=minutes))


def _stream(t: Tables, name: str, count, finish=_same, **options) -> DataFrame:
    """Each window over the whole log, whatever the order of its files."""
    return _text_start(finish(window_run(t, name, count, **options).windows()))


@query(RATE_SQL)
def request_rate(t: Tables) -> DataFrame:
    return _batch(t, _rate, requests.with_rate)


@query(ERROR_SQL)
def error_ratio(t: Tables) -> DataFrame:
    return _batch(t, _errors, requests.with_error_ratio)


@query(P95_SQL)
def p95_by_route(t: Tables) -> DataFrame:
    return _batch(t, _p95, requests.with_latency)


@query(CLASS_SQL)
def class_counts(t: Tables) -> DataFrame:
    return _batch(t, _classes)


@query(RATE_SQL)
def request_rate_stream(t: Tables) -> DataFrame:
    return _stream(t, "request_rate", _rate, requests.with_rate, minutes=1)


@query(ERROR_SQL)
def error_ratio_stream(t: Tables) -> DataFrame:
    return _stream(t, "error_ratio", _errors, requests.with_error_ratio, keys=("window_start",))


@query(P95_SQL)
def p95_by_route_stream(t: Tables) -> DataFrame:
    return _stream(t, "p95_by_route", _p95, requests.with_latency)


@query(CLASS_SQL)
def class_counts_stream(t: Tables) -> DataFrame:
    return _stream(t, "class_counts", _classes)


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(value) AS requests, quantile_disc(value, 0.95) AS exact_ms, true AS within
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def p95_of_hours(t: Tables) -> DataFrame:
    """The p95 of an hour from stored sketches of five minutes, held to its error bound: ``within`` says that the share of the hour's rows
    up to the sketched value reaches 0.95, and the share below it stays under 0.95, but for twice the rank error."""
    log = requests.request_log(t.events)
    place = f"{new_run(t.spark, 'sketches')}/five_minutes"
    sketches.latency_sketches(log, ["event_type"], "value").write.parquet(place)
    hours = sketches.merged(t.spark.read.parquet(place), ["event_type"], "1 hour").select(
        "window_start", "event_type", sketches.sketch_rows().alias("_n"), sketches.sketch_quantile(0.95).alias("_at"),
    )
    rows = log.filter("value is not null").select(F.date_trunc("hour", "ts").alias("window_start"), "event_type", "value")
    error = 2 * sketches.rank_error()
    found = rows.join(hours, ["window_start", "event_type"]).groupBy("window_start", "event_type").agg(
        F.max("_n").alias("requests"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("exact_ms"),
        ((F.avg((F.col("value") <= F.col("_at")).cast("double")) >= 0.95 - error) & (F.avg((F.col("value") < F.col("_at")).cast("double")) <= 0.95 + error)).alias("within"),
    )
    return _text_start(found)
