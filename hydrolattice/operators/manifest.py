"""Scene catalogue and manifest operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scene_names import normal_tile
from ..settings import BANDS, Scenes


def keep_last(df: DataFrame, key: str | Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per key, by a total order. Spark prunes to one row per key and task before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def upsert(existing: DataFrame, new: DataFrame, *, key: str = "scene_id", sequence: str | None = None) -> DataFrame:
    """Append ``new`` and keep the latest record per key. ``sequence`` orders records within a batch."""
    batches = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    newest = [F.col("_batch").desc(), *([F.col(sequence).desc_nulls_last()] if sequence else [])]
    return keep_last(batches, key, newest).drop("_batch")


def chronological(manifest: DataFrame, when: str = "acquisition_date", key: str = "scene_id") -> DataFrame:
    return manifest.orderBy(when, key)


def latest_copies(scenes: DataFrame, *, keys: Sequence[str], baseline: str, sequence: Sequence[str]) -> DataFrame:
    """Highest baseline per key (a missing one counts as 0); the first seen wins ties."""
    level = F.coalesce(F.col(baseline).cast("double"), F.lit(0.0))
    return keep_last(scenes, keys, [level.desc(), *[F.col(s).asc() for s in sequence]])


def usable_scenes(scenes: DataFrame, settings: Scenes = Scenes(), *, tiles: Sequence[str] = (), start: date | None = None, end: date | None = None, cloud: str = "cloud_cover", tile: str = "tile", when: str = "acquired") -> DataFrame:
    """Scenes within the cloud limit, the dates and the allowed tiles. A scene without a tile passes."""
    out = scenes.filter(F.col(cloud) <= settings.max_cloud_pct)
    if tiles:
        allowed = sorted({t.lstrip("T").upper() for t in tiles if t})
        named = normal_tile(tile)
        out = out.filter(named.isNull() | (named == "") | named.isin(*allowed))
    if start is not None:
        out = out.filter(F.to_date(when) >= F.lit(start))
    if end is not None:
        out = out.filter(F.to_date(when) <= F.lit(end))
    return out


def scene_completeness(files: DataFrame, *, scene: str = "scene_dir", band: str = "band", length: str = "length", bands: Sequence[str] = BANDS, min_bytes: int = Scenes().min_band_bytes) -> DataFrame:
    """Whether every band of a scene is present and large enough."""
    good = F.when((F.col(length) > min_bytes) & F.col(band).isin(*bands), F.col(band))
    return files.groupBy(scene).agg((F.count_distinct(good) == len(set(bands))).alias("complete"))


def without_known(scenes: DataFrame, known: DataFrame, key: str | Sequence[str] = "scene_id") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return scenes.join(known.select(*keys), keys, "left_anti")


def only_listed(scenes: DataFrame, listed: DataFrame, key: str | Sequence[str] = "scene_id") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return scenes.join(listed.select(*keys), keys, "left_semi")


def known_ids(*tables: DataFrame, key: str = "scene_id") -> DataFrame:
    """Distinct union of identifiers or dates over several tables."""
    merged = tables[0].select(key)
    for t in tables[1:]:
        merged = merged.union(t.select(key))
    return merged.distinct()


def pending(scenes: DataFrame, known: DataFrame, *, key: str = "scene_id", when: str = "acquisition_date", newest_first: bool = False, limit: int | None = None) -> DataFrame:
    """Scenes not yet known, in order, and the first ``limit`` of those."""
    order = [F.col(when).desc(), F.col(key).desc()] if newest_first else [F.col(when).asc(), F.col(key).asc()]
    out = without_known(scenes, known, key).orderBy(*order)
    return out.limit(limit) if limit else out


def resume_point(*manifests: DataFrame, default: date, when: str = "acquisition_date") -> DataFrame:
    """One row: the newest date over all manifests, whatever its status, else the default."""
    dates = manifests[0].select(F.col(when).cast("date").alias("d"))
    for m in manifests[1:]:
        dates = dates.unionByName(m.select(F.col(when).cast("date").alias("d")))
    return dates.agg(F.coalesce(F.max("d"), F.lit(default)).alias("resume_from"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content version: row count and a wide sum of 60 bits of each row's md5.

    A row is its values as text, columns by name, a missing value apart from any text.
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(df.columns)])
    digest = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).alias("content"))

