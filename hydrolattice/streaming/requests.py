"""Request-log aggregates over event-time windows.

Every function takes a batch or a streaming request log. On a stream it keeps state per open window
only, because the log carries a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even, share

WATERMARK = "10 minutes"

# Upper bounds of the request latency buckets, in milliseconds.
LATENCY_BOUNDS_MS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0)


def request_log(df: DataFrame, ts: str = "ts", watermark: str = WATERMARK, *, route: str = "route", hidden: Sequence[str] = ()) -> DataFrame:
    """Event time as TIMESTAMP, with a watermark when the log is a stream. ``hidden`` routes, such as the metrics scrape, are left out."""
    log = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if hidden:
        log = log.filter(~F.coalesce(F.col(route).isin(*hidden), F.lit(False)))
    return log.withWatermark(ts, watermark) if df.isStreaming else log


def _windowed(log: DataFrame, ts: str, width: str, slide: str | None, by: Sequence[str], *aggregates: Column) -> DataFrame:
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = log.groupBy(span.alias("_w"), *by).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), "*").drop("_w")


def request_counts(log: DataFrame, by: Sequence[str] = (), *, ts: str = "ts", width: str = "1 minute", slide: str = "10 seconds") -> DataFrame:
    """Requests of a sliding window, overall or by route or status."""
    return _windowed(log, ts, width, slide, by, F.count(F.lit(1)).alias("requests"))


def with_rate(counts: DataFrame, seconds: int = 60) -> DataFrame:
    return counts.withColumn("rate", round_even(F.col("requests") / F.lit(float(seconds)), 4))


def request_rate(log: DataFrame, by: Sequence[str] = (), *, ts: str = "ts", width: str = "1 minute", slide: str = "10 seconds", seconds: int = 60) -> DataFrame:
    """Requests per second over a sliding window, overall or by route or status."""
    return with_rate(request_counts(log, by, ts=ts, width=width, slide=slide), seconds)


def error_counts(log: DataFrame, failed: Column, *, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    """Failed and all requests per window."""
    return _windowed(log, ts, width, None, (), F.count_if(failed).alias("errors"), F.count(F.lit(1)).alias("requests"))


def with_error_ratio(counts: DataFrame) -> DataFrame:
    return counts.withColumn("error_ratio", F.coalesce(round_even(share("errors", "requests"), 4), F.lit(0.0)))


def error_ratio(log: DataFrame, failed: Column, *, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    """Share of failed requests per window; 0 when none failed."""
    return with_error_ratio(error_counts(log, failed, ts=ts, width=width))


def latency_counts(log: DataFrame, by: Sequence[str], millis: str, *, ts: str = "ts", width: str = "5 minutes", bounds: Sequence[float] = LATENCY_BOUNDS_MS) -> DataFrame:
    """Requests per window, and how many of them lie within each bound."""
    value = F.col(millis)
    counts = [F.count_if(value <= b).alias(f"_le_{i}") for i, b in enumerate(bounds)]
    return _windowed(log, ts, width, None, by, F.count(value).alias("requests"), *counts)


def with_latency(out: DataFrame, quantile: float = 0.95, bounds: Sequence[float] = LATENCY_BOUNDS_MS) -> DataFrame:
    rank = F.col("requests") * quantile
    found = F.lit(None).cast("double")
    for i in reversed(range(len(bounds))):
        low = F.lit(0.0) if i == 0 else F.lit(float(bounds[i - 1]))
        below = F.lit(0) if i == 0 else F.col(f"_le_{i - 1}")
        inside = F.col(f"_le_{i}") - below
        at = low + (F.lit(float(bounds[i])) - low) * F.coalesce(share(rank - below, inside), F.lit(0.0))
        found = F.when(F.col(f"_le_{i}") >= rank, at).otherwise(F.lit(float(bounds[-1])) if i == len(bounds) - 1 else found)
    over = F.coalesce(F.col(f"_le_{len(bounds) - 1}") < rank, F.lit(False))
    return out.withColumns({"latency_ms": round_even(found, 3), "over_bound": over}).drop(*[f"_le_{i}" for i in range(len(bounds))])


def latency_quantile(log: DataFrame, by: Sequence[str], millis: str, *, ts: str = "ts", width: str = "5 minutes", quantile: float = 0.95, bounds: Sequence[float] = LATENCY_BOUNDS_MS) -> DataFrame:
    """Latency quantile per window from bucket counts, interpolated inside its bucket.

    State is one count per bucket, whatever the traffic. Where the quantile lies above the last bound, that bound is reported
    and ``over_bound`` is true.
    """
    return with_latency(latency_counts(log, by, millis, ts=ts, width=width, bounds=bounds), quantile, bounds)


def class_counts(log: DataFrame, label: str, *, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    """Predictions per class and window."""
    return _windowed(log, ts, width, None, (label,), F.count(F.lit(1)).alias("predictions"))
