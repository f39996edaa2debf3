"""Pixel tables from stored pixel rows or blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import BANDS


def explode_blocks(blocks: DataFrame, keys: Sequence[str] = ("scene_id", "date")) -> DataFrame:
    """(keys, band, row, col, value) from 2-D blocks ``px ARRAY<ARRAY<FLOAT>>`` placed at (row0, col0)."""
    lines = blocks.select(*keys, "band", "row0", "col0", F.posexplode("px").alias("_r", "_line"))
    return lines.select(*keys, "band", (F.col("row0") + F.col("_r")).alias("row"), "col0", F.posexplode("_line").alias("_c", "value")).select(
        *keys, "band", "row", (F.col("col0") + F.col("_c")).alias("col"), "value"
    )


def bands_to_columns(long: DataFrame, keys: Sequence[str] = ("scene_id", "date"), bands: Sequence[str] = BANDS) -> DataFrame:
    """One row per pixel with a column per band, from one partial aggregate."""
    wide = long.groupBy(*keys, "row", "col").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).cast("double").alias(b.lower()) for b in bands])
    return wide.withColumn("scl", F.col("scl").cast("int")) if "SCL" in bands else wide
