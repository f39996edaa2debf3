"""Rolling weather features per point."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clip, round_even
from .ordering import ranked


@dataclass(frozen=True)
class Rolling:
    output: str
    how: str
    source: str
    rows: int


# The nine rolling features and their window lengths in rows.
ROLLING_FEATURES = (
    Rolling("rainfall_8day", "sum", "rainfall_mm", 8),
    Rolling("rainfall_16day", "sum", "rainfall_mm", 16),
    Rolling("rainfall_30day", "sum", "rainfall_mm", 30),
    Rolling("temp_8day_mean", "avg", "temp_mean_c", 8),
    Rolling("temp_30day_mean", "avg", "temp_mean_c", 30),
    Rolling("temp_8day_max", "max", "temp_max_c", 8),
    Rolling("et0_8day_sum", "sum", "et0_mm", 8),
    Rolling("et0_16day_sum", "sum", "et0_mm", 16),
)


def rolling(
    df: DataFrame,
    point: str,
    date: str,
    features: Sequence[Rolling],
    *,
    digits: int | None = 2,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Trailing row windows per point, from one shuffle and one sort.

    With one row per (point, day) a point's window partition is bounded by the calendar. For series
    without that bound, ``rows_per_task`` cuts a long series into chunks that overlap by the longest
    window, so no task holds a whole series; results are the same.
    """
    keys, order, halo = [point], [date], max(f.rows for f in features) - 1
    if rows_per_task:
        chunk = F.floor((F.col("_row") - 1) / F.lit(rows_per_task))
        last = F.floor((F.col("_row") - 1 + halo) / F.lit(rows_per_task))  # the last chunk whose windows reach this row
        df = ranked(df, [point], [date], "_row", "_rows").withColumn("_chunk", F.explode(F.sequence(chunk, last)))
        keys, order = [point, "_chunk"], ["_row"]
    run = {"sum": F.sum, "avg": F.avg, "max": F.max}
    base = Window.partitionBy(*keys).orderBy(*order)

    def feature(f: Rolling):
        value = run[f.how](f.source).over(base.rowsBetween(1 - f.rows, Window.currentRow))
        return (value if digits is None else round_even(value, digits)).alias(f.output)

    out = df.select("*", *[feature(f) for f in features])
    if rows_per_task:
        out = out.filter(F.col("_chunk") == F.floor((F.col("_row") - 1) / F.lit(rows_per_task))).drop("_row", "_rows", "_chunk")
    return out


def weather_features(df: DataFrame, point: str = "weather_point_id", date: str = "date", **options) -> DataFrame:
    """The eight rolling features plus the atmospheric deficit of their rounded 8-day sums."""
    out = rolling(df, point, date, ROLLING_FEATURES, **options)
    gap = clip(F.col("et0_8day_sum") - F.col("rainfall_8day"), low=0.0)
    return out.withColumn("climatic_water_deficit_8day", round_even(gap, 2))


def with_label_inputs(df: DataFrame, point: str = "weather_point_id", date: str = "date") -> DataFrame:
    """Unrounded 8-day sums for tables that lack them; rain falls back to liquid rain."""
    rain = "rainfall_mm" if "rainfall_mm" in df.columns else "rain_mm"
    missing = [
        Rolling(name, "sum", source, 8)
        for name, source in (("et0_8day_sum", "et0_mm"), ("rainfall_8day", rain))
        if name not in df.columns
    ]
    return rolling(df, point, date, missing, digits=None) if missing else df
