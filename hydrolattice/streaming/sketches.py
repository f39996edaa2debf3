"""Mergeable latency sketches: one KLL sketch per window and route, stored once and merged over any span.

A sketch takes a few kilobytes whatever the traffic. With 99 % confidence the rank of a quantile it gives is off by no more
than ``rank_error(k)`` of the rows, before and after merging; up to about ``k`` rows it is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 800


def rank_error(k: int = K) -> float:
    """Normalised one-sided rank error of a KLL sketch at 99 % confidence."""
    return 2.296 / k**0.9723


def latency_sketches(log: DataFrame, by: Sequence[str], millis: str, *, ts: str = "ts", width: str = "5 minutes", k: int = K) -> DataFrame:
    """(window_start, by, sketch). Missing latencies are left out."""
    out = log.filter(F.col(millis).isNotNull()).groupBy(F.window(ts, width).alias("_w"), *by).agg(F.kll_sketch_agg_double(F.col(millis).cast("double"), k).alias("sketch"))
    return out.select(F.col("_w.start").alias("window_start"), *by, "sketch")


def merged(sketches: DataFrame, by: Sequence[str], span: str, *, k: int = K) -> DataFrame:
    """Sketches of wider windows, or of fewer keys, from stored ones."""
    out = sketches.groupBy(F.window("window_start", span).alias("_w"), *by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return out.select(F.col("_w.start").alias("window_start"), *by, "sketch")


def sketch_rows(sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_n_double(sketch)


def sketch_quantile(q: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))
