"""Parameters of every stage, as frozen dataclasses with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Column lists, codes, colours and limits that results depend on.
CLASS_LABELS = ("LOW", "MODERATE", "HIGH")
CLASS_COLOURS = {"LOW": "#28a745", "MODERATE": "#ffc107", "HIGH": "#dc3545"}
LANGUAGES = ("en", "mr", "hi")
BANDS = ("B02", "B03", "B04", "B08", "B11", "B12", "SCL")
REFLECTANCE_BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")
CLEAR_SCENE_CLASSES = (4, 5, 6, 7)

MODEL_FEATURES = (
    "ndvi_mean", "ndvi_std", "ndwi_mean", "ndwi_std", "evi_mean", "evi_std",
    "b02_mean", "b03_mean", "b04_mean", "b08_mean", "b11_mean", "b12_mean",
    "temp_mean_c", "temp_max_c", "humidity_pct", "wind_speed_mps", "solar_radiation_mj",
    "rainfall_8day", "rainfall_16day", "rainfall_30day",
    "temp_8day_mean", "temp_30day_mean", "temp_8day_max",
    "et0_8day_sum", "et0_16day_sum",
)
LABEL_INPUTS = ("ndwi_mean", "rainfall_8day", "et0_8day_sum")

WEATHER_RANGES = {
    "temp_max_c": (-5.0, 55.0), "temp_mean_c": (-5.0, 50.0), "rainfall_mm": (0.0, 500.0),
    "humidity_pct": (0.0, 100.0), "wind_speed_mps": (0.0, 40.0),
    "solar_radiation_mj": (0.0, 45.0), "et0_mm": (0.0, 20.0),
}
FEATURE_RANGES = {
    "ndvi_mean": (-1.0, 1.0), "ndwi_mean": (-1.0, 1.0), "evi_mean": (-5.0, 5.0),
    "b02_mean": (0.0, 12000.0), "b03_mean": (0.0, 12000.0), "b04_mean": (0.0, 12000.0),
    "b08_mean": (0.0, 12000.0), "b11_mean": (0.0, 12000.0), "b12_mean": (0.0, 12000.0),
    "temp_max_c": (-5.0, 55.0), "humidity_pct": (0.0, 100.0), "wind_speed_mps": (0.0, 40.0),
    "rainfall_8day": (0.0, 1500.0), "et0_8day_sum": (0.0, 160.0),
}
MANIFEST_COLUMNS = ("scene_id", "acquisition_date", "cloud_cover_pct", "mgrs_tile")

# What-if shift: a hotter period with less canopy water.
SCENARIO_SHIFT = {
    "temp_mean_c": 4.0, "temp_max_c": 4.0, "temp_8day_mean": 4.0, "temp_30day_mean": 4.0, "temp_8day_max": 4.0,
    "rainfall_8day": 20.0, "rainfall_16day": 20.0, "rainfall_30day": 20.0, "ndwi_mean": -0.1,
}

# Values a what-if request gets for inputs it leaves out.
REQUEST_DEFAULTS = {"ndwi_mean": 0.05, "temp_max_c": 32.0, "et0_8day_sum": 35.0, "rainfall_8day": 0.0}

# Values of a request form for fields left out, and the accepted ranges.
FORM_DEFAULTS = {
    "ndvi_mean": 0.28, "ndwi_mean": 0.04, "evi_mean": 0.22, "temp_max_c": 34.0, "temp_mean_c": 28.0,
    "rainfall_8day": 0.0, "rainfall_16day": 0.0, "humidity_pct": 42.0, "solar_radiation_mj": 22.0, "et0_8day_sum": 38.0,
}
FORM_RANGES = {
    "ndvi_mean": (-1.0, 1.0), "ndwi_mean": (-1.0, 1.0), "temp_max_c": (0.0, 55.0), "humidity_pct": (0.0, 100.0),
    "rainfall_8day": (0.0, float("inf")),
}


@dataclass(frozen=True)
class WaterBalance:
    kc: float = 0.95
    effective_rain: float = 0.8
    low_mm: float = 12.0
    high_mm: float = 28.0
    min_ndvi: float = 0.15
    ndwi_dry: float = 0.02
    ndwi_range: float = 0.16
    max_buffer: float = 0.75


@dataclass(frozen=True)
class Grid:
    cell_size_m: float = 250.0
    cell_area_ha: float = 6.25
    id_prefix: str = "NLBC_CELL"
    central_meridian_deg: float = 75.0
    default_tiles: tuple[str, ...] = ("43QDA", "43QDV")
    lattice_spacing_deg: float = 0.1


@dataclass(frozen=True)
class Scenes:
    start: date = date(2023, 10, 1)
    end: date = date(2024, 3, 31)
    max_cloud_pct: float = 15.0
    offset: float = -1000.0
    offset_from_baseline: float = 4.0
    min_band_bytes: int = 1000
    min_clear_pixels: int = 5


@dataclass(frozen=True)
class Gate:
    min_score: float = 0.85
    min_improvement: float = 0.0


@dataclass(frozen=True)
class Drift:
    share_alert: float = 0.3
    distance_threshold: float = 0.1
    p_threshold: float = 0.05
    method: str = "distance"  # or p_value


@dataclass(frozen=True)
class Training:
    split: date = date(2024, 2, 1)
    test_share: float = 0.25
    seed: int = 42
    features: tuple[str, ...] = MODEL_FEATURES
    label_inputs: tuple[str, ...] = LABEL_INPUTS
    target: str = "target_stress_class"
    forest_trees: int = 100
    forest_depth: int = 12
    max_bins: int = 32  # split candidates per input
    boost_rounds: int = 150
    boost_depth: int = 6
    boost_step: float = 0.08
    boost_subsample: float = 0.8


@dataclass(frozen=True)
class Quality:
    max_missing: float = 0.01
    min_dates: int = 20
    weather_start: date = date(2023, 1, 1)
    weather_end: date = date(2024, 5, 31)


@dataclass(frozen=True)
class Settings:
    water: WaterBalance = field(default_factory=WaterBalance)
    grid: Grid = field(default_factory=Grid)
    scenes: Scenes = field(default_factory=Scenes)
    gate: Gate = field(default_factory=Gate)
    drift: Drift = field(default_factory=Drift)
    training: Training = field(default_factory=Training)
    quality: Quality = field(default_factory=Quality)
    min_latest_coverage: float = 0.9


DEFAULTS = Settings()
