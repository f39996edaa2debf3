"""The batch stages in their order. Each reads and writes tables under one root folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.advice import advisory_in
from ..operators import drift, kpi, labels, learn, maps, quality, raster, sampling, scores, strips
from ..operators.weather import weather_features
from ..settings import DEFAULTS, Settings
from ..sources import schemas, tables
from ..sources.catalogue import read_items
from ..sources.scene_cache import SceneCache, ingest
from ..sources.weather_payloads import parse_payloads


@dataclass(frozen=True)
class Stages:
    spark: SparkSession
    root: str
    settings: Settings = DEFAULTS

    def table(self, name: str) -> DataFrame:
        """A stored table; one with a declared schema is held to its types, and NaN is missing."""
        df = tables.read_parquet(self.spark, f"{self.root}/{name}")
        return tables.require_types(df, schemas.BY_TABLE[name]) if name in schemas.BY_TABLE else df

    def _save(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        tables.write_parquet(df, f"{self.root}/{name}", partition_by)
        return self.table(name)

    def weather(self, payloads: DataFrame, points: DataFrame) -> DataFrame:
        """Payload text per point to daily rows with rolling features."""
        daily = parse_payloads(payloads, keys=["weather_point_id"]).join(points, "weather_point_id")
        return self._save(tables.without_nan(weather_features(daily)), "weather")

    def check_raw(self, manifest: DataFrame) -> DataFrame:
        weather = self.table("weather")
        checks = quality.weather_suite(weather, self.settings).unionAll(quality.scene_suite(manifest, weather, self.settings))
        return self._report(checks, "raw", {"weather": weather, "scenes": manifest})

    def ingest(self, landed: str, files: DataFrame, extract, version: str, tiles: Sequence[str] = ()) -> SceneCache:
        """Landed catalogue pages and band files to the scene cache: usable, newest, whole scenes that it lacks in this feature version."""
        cache = SceneCache(self.spark, f"{self.root}/scene_cache")
        ingest(cache, read_items(self.spark, landed), files, extract, version, self.settings.scenes, tiles=tiles)
        return cache

    def satellite_from_blocks(self, blocks: DataFrame, scenes: DataFrame, cells: DataFrame, **placement) -> DataFrame:
        """Raw band blocks (10 m and 20 m) to zonal features: resampled, then corrected by each scene's baseline."""
        tables.require_types(blocks.drop("px"), schemas.PIXEL_BLOCKS)
        keys = [c for c in ("scene_id", "date", "area_id") if c in blocks.columns]
        return self.satellite(strips.block_pixels(blocks, scenes, keys=keys), cells, offset="offset", **placement)

    def satellite(self, pixels: DataFrame, cells: DataFrame, **placement) -> DataFrame:
        """Zonal features per (cell, date) of corrected pixels, or of raw ones with an ``offset`` column; scenes of one day are averaged."""
        return self._save(raster.merge_overlaps(raster.scene_features(pixels, cells, **placement)), "satellite", ["date"])

    def features(self) -> DataFrame:
        return self._save(labels.training_table(self.table("satellite"), self.table("weather"), self.settings.water), "features", ["date"])

    def check_features(self) -> DataFrame:
        features = self.table("features")
        return self._report(quality.feature_suite(features, self.settings), "features", {"features": features})

    def _report(self, checks: DataFrame, stage: str, rows: Mapping[str, DataFrame]) -> DataFrame:
        """Store the report, then stop the run when a check failed."""
        path = f"{self.root}/validation_{stage}"
        tables.write_json_documents(quality.report(checks, stage, rows), path)
        stored = self.spark.read.json(path)
        quality.enforce(stored.select(F.inline("checks")))
        return stored

    def train(self, models: Sequence[str] = learn.MODELS) -> tuple[object, DataFrame, str]:
        """Three tests of every model, then the best on later dates, fitted on the group-holdout training rows."""
        training = self.settings.training
        rows = self.table("features").filter(F.col("is_vegetated"))
        results = self._save(learn.three_way_test(rows, training, models), "model_scores")
        later = results.filter(F.col("test") == "later_dates")
        best = scores.best_model(later, "model", "macro_f1", "priority").first()["best_model"]
        fit_on = sampling.group_holdout(rows, "cell_id", training.test_share, seed=training.seed).filter(~F.col("is_test"))
        return learn.train(fit_on, best, training.features, training.target, training), results, best

    def gate(self, champion: float | None) -> DataFrame:
        """Verdict on the best model's score on later dates."""
        later = self.table("model_scores").filter(F.col("test") == "later_dates")
        best = scores.best_model(later, "model", "macro_f1", "priority")
        return scores.gate_verdict(best.withColumn("champion", F.lit(champion).cast("double")), "best_score", "champion", self.settings.gate)

    def predict(self, model, grid: DataFrame, cycle: date | None = None) -> date:
        """Score every date, write results, KPIs and the two layers of the published date, and return that date."""
        features = self.table("features")
        if cycle is None:
            cycle = kpi.latest_covered_date(features, coverage=self.settings.min_latest_coverage).first()["latest_date"]
        kpi.require_date(features, cycle)
        scored = learn.score(model, features.filter(F.col("is_vegetated")), self.settings.training.features)
        columns = ["date", "cell_id", "stress_code", "confidence", "priority", "ndvi_mean", "ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day"]
        results = self._save(scored.select(*columns), "results", ["date"])
        # The other cells only count towards a date's total.
        everyone = features.select("date", "cell_id").join(results.withColumn("_veg", F.lit(True)), ["date", "cell_id"], "left")
        flat = self._save(kpi.cycle_kpis(everyone, vegetated=F.col("_veg"), grid=self.settings.grid), "kpis")
        documents = kpi.nested_kpis(flat)
        tables.write_json_documents(documents, f"{self.root}/kpi_by_date")
        tables.write_json_documents(documents.filter(F.col("cycle_date") == F.lit(cycle)), f"{self.root}/kpi_published")
        published = results.filter(F.col("date") == F.lit(cycle))
        shapes = grid.select("cell_id", maps.box_geometry("minx", "miny", "maxx", "maxy").alias("geometry"))
        for layer in ("stress", "irrigation"):
            tables.write_lines(maps.map_layer(published, shapes, layer=layer), f"{self.root}/{layer}_map")
        return cycle

    def map_of(self, when: date, grid: DataFrame, *, layer: str = "stress", limit: int = 1500, sample: bool = True) -> DataFrame:
        """A layer of any stored date, strided down to ``limit`` cells."""
        rows = kpi.require_date(self.table("results"), when)
        shapes = grid.select("cell_id", maps.box_geometry("minx", "miny", "maxx", "maxy").alias("geometry"))
        return maps.map_layer(maps.stride_sample(rows, limit=limit, sample=sample), shapes, layer=layer)

    def cell(self, when: date, cell_id: str, language: str = "en") -> DataFrame:
        """Details of one cell on one date."""
        row = kpi.require_date(self.table("results"), when).filter(F.col("cell_id") == cell_id)
        inputs = ("stress_code", "confidence", "ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day")
        return row.withColumn("advisory", advisory_in(language, *inputs))

    def drift(self, cycle: date) -> tuple[DataFrame, DataFrame]:
        """Scores per input and the summary: published date against the training period, on all rows."""
        rows = self.table("features").filter(F.col("is_vegetated"))
        reference, _ = sampling.temporal_split(rows, "date", self.settings.training.split)
        current = rows.filter(F.col("date") == F.lit(cycle))
        drift.require_both(reference, current)
        result = self._save(drift.drift_scores(reference, current, self.settings.training.features, self.settings.drift), "drift_scores")
        return result, self._save(drift.drift_summary(result, self.settings.drift), "drift_summary")
