"""Declared schemas of stored tables, checked when a stage reads one."""

WEATHER_DAILY = (
    "weather_point_id string, latitude double, longitude double, date date, temp_max_c double, temp_min_c double, "
    "temp_mean_c double, rainfall_mm double, rain_mm double, humidity_pct double, wind_speed_mps double, "
    "solar_radiation_mj double, et0_mm double, aoi_id string"
)
WEATHER_FEATURES = WEATHER_DAILY + (
    ", rainfall_8day double, rainfall_16day double, rainfall_30day double, temp_8day_mean double, temp_30day_mean double, "
    "temp_8day_max double, et0_8day_sum double, et0_16day_sum double, climatic_water_deficit_8day double"
)
SATELLITE = (
    "cell_id string, date date, centroid_lon double, centroid_lat double, valid_pixel_pct double, "
    "ndvi_mean double, ndvi_std double, ndwi_mean double, ndwi_std double, evi_mean double, evi_std double, "
    "b02_mean double, b03_mean double, b04_mean double, b08_mean double, b11_mean double, b12_mean double, scene_id string"
)
TRAINING = SATELLITE + (
    ", weather_point_id string, temp_mean_c double, temp_max_c double, humidity_pct double, wind_speed_mps double, "
    "solar_radiation_mj double, rainfall_8day double, rainfall_16day double, rainfall_30day double, temp_8day_mean double, "
    "temp_30day_mean double, temp_8day_max double, et0_8day_sum double, et0_16day_sum double, crop_water_demand_8day_mm double, "
    "effective_rainfall_8day_mm double, is_vegetated boolean, water_deficit_8day_mm double, target_stress_class int, "
    "target_stress_label string"
)
RESULTS = (
    "date date, cell_id string, stress_code int, confidence double, priority int, ndvi_mean double, ndwi_mean double, "
    "temp_max_c double, et0_8day_sum double, rainfall_8day double"
)
GRID = (
    "cell_id string, minx double, miny double, maxx double, maxy double, centroid_lon double, centroid_lat double, ix bigint, iy bigint"
)
PIXEL_BLOCKS = "scene_id string, date date, band string, row0 int, col0 int, px array<array<float>>"

BY_TABLE = {"weather": WEATHER_FEATURES, "satellite": SATELLITE, "features": TRAINING, "results": RESULTS, "grid": GRID}
