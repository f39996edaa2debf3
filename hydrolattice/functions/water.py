"""Water demand, effective rain, deficits and stress classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CLASS_LABELS, WaterBalance
from .numeric import as_col, clip, round_even


def demand(et0_sum, balance: WaterBalance) -> Column:
    return round_even(as_col(et0_sum) * balance.kc, 2)


def effective_rain(rain_sum, demand_mm, balance: WaterBalance) -> Column:
    demand_mm = as_col(demand_mm)
    bounded = clip(as_col(rain_sum) * balance.effective_rain, 0.0, demand_mm)
    return F.when(demand_mm.isNotNull(), round_even(bounded, 2))


def climatic_deficit(demand_mm, rain_mm) -> Column:
    return round_even(clip(as_col(demand_mm) - as_col(rain_mm), low=0.0), 2)


def canopy_buffer(ndwi, demand_mm, balance: WaterBalance) -> Column:
    """Water the canopy itself still holds, as a part of demand."""
    wetness = clip((as_col(ndwi) - balance.ndwi_dry) / balance.ndwi_range, 0.0, 1.0)
    return wetness * as_col(demand_mm) * balance.max_buffer


def buffered_deficit(demand_mm, rain_mm, ndwi, balance: WaterBalance) -> Column:
    left = as_col(demand_mm) - as_col(rain_mm) - canopy_buffer(ndwi, demand_mm, balance)
    return round_even(clip(left, low=0.0), 2)


def stress_class(deficit_mm, balance: WaterBalance) -> Column:
    """0 below the low limit, 2 above the high one, 1 between and when the deficit is missing."""
    deficit_mm = as_col(deficit_mm)
    return F.when(deficit_mm < balance.low_mm, 0).when(deficit_mm > balance.high_mm, 2).otherwise(1)


def stress_label(code) -> Column:
    """Label of a class code; an unknown code has none."""
    return F.try_element_at(F.array(*map(F.lit, CLASS_LABELS)), as_col(code).cast("int") + 1)


def is_vegetated(ndvi, balance: WaterBalance) -> Column:
    return F.coalesce(as_col(ndvi) >= balance.min_ndvi, F.lit(False))
