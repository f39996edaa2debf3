"""Values read out of scene identifiers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def normal_tile(tile) -> Column:
    return F.upper(F.ltrim(as_col(tile), F.lit("T")))


def scene_tile(tile_property, scene_id, loose: bool = True) -> Column:
    """Tile from its property, else from the identifier: ``Txxxxx``, or (loose) five characters with two leading digits."""
    prop = as_col(tile_property)

    def is_tile(part: Column) -> Column:
        tagged = part.startswith("T") & (F.length(part) == 6)
        bare = part.rlike("^[0-9]{2}.{3}$")
        return tagged | bare if loose else tagged

    part = F.try_element_at(F.filter(F.split(as_col(scene_id), "_"), is_tile), F.lit(1))
    from_id = F.when(part.startswith("T") & (F.length(part) == 6), F.substring(part, 2, 5)).otherwise(part)
    return normal_tile(F.coalesce(F.when(prop != "", prop), from_id))


def path_date(folder) -> Column:
    return F.substring(as_col(folder), 1, 10)


def path_scene(folder) -> Column:
    folder = as_col(folder)
    return F.when(F.length(folder) > 11, F.substring(folder, 12, 1 << 30)).otherwise(folder)
