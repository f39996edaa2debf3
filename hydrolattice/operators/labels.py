"""Deficits, stress classes and the joined training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import water
from ..settings import WaterBalance
from .nearest import nearest_points
from .weather import with_label_inputs

# Weather columns the training table carries.
WEATHER_COLUMNS = (
    "temp_mean_c", "temp_max_c", "humidity_pct", "wind_speed_mps", "solar_radiation_mj",
    "rainfall_8day", "rainfall_16day", "rainfall_30day", "temp_8day_mean", "temp_30day_mean", "temp_8day_max",
    "et0_8day_sum", "et0_16day_sum", "crop_water_demand_8day_mm", "effective_rainfall_8day_mm",
)


def climatic_labels(
    weather: DataFrame,
    balance: WaterBalance = WaterBalance(),
    *,
    et0: str = "et0_8day_sum",
    rain: str = "rainfall_8day",
) -> DataFrame:
    """Demand, effective rain, deficit, class and label from 8-day sums."""
    return (
        weather.withColumn("crop_water_demand_8day_mm", water.demand(et0, balance))
        .withColumn("effective_rainfall_8day_mm", water.effective_rain(rain, "crop_water_demand_8day_mm", balance))
        .withColumn("water_deficit_8day_mm", water.climatic_deficit("crop_water_demand_8day_mm", "effective_rainfall_8day_mm"))
        .withColumn("target_stress_class", water.stress_class("water_deficit_8day_mm", balance))
        .withColumn("target_stress_label", water.stress_label("target_stress_class"))
    )


def buffered_labels(
    joined: DataFrame,
    balance: WaterBalance = WaterBalance(),
    *,
    demand: str = "crop_water_demand_8day_mm",
    rain: str = "effective_rainfall_8day_mm",
    ndwi: str = "ndwi_mean",
) -> DataFrame:
    """Deficit after the canopy's own buffer; replaces the climatic deficit and class."""
    return (
        joined.withColumn("water_deficit_8day_mm", water.buffered_deficit(demand, rain, ndwi, balance))
        .withColumn("target_stress_class", water.stress_class("water_deficit_8day_mm", balance))
        .withColumn("target_stress_label", water.stress_label("target_stress_class"))
    )


def training_table(satellite: DataFrame, weather: DataFrame, balance: WaterBalance = WaterBalance()) -> DataFrame:
    """Satellite features joined to the labelled weather of each cell's nearest point."""
    labelled = climatic_labels(with_label_inputs(weather), balance)
    picked = [c for c in WEATHER_COLUMNS if c in labelled.columns]
    # A cell's centroid is the same on every row.
    cells = satellite.groupBy("cell_id").agg(*[F.min(c).alias(c) for c in ("centroid_lon", "centroid_lat")])
    points = weather.select("weather_point_id", "latitude", "longitude").distinct()
    mapped = satellite.join(nearest_points(cells, points), "cell_id", "left")
    joined = mapped.join(labelled.select("weather_point_id", "date", *picked), ["weather_point_id", "date"])
    joined = joined.withColumn("is_vegetated", water.is_vegetated("ndvi_mean", balance))
    return buffered_labels(joined, balance)
