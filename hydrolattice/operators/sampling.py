"""Holdouts and fixed-size samples that repeat exactly."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import hash_share, smallest_draws


def group_holdout(df: DataFrame, group: str, test_share: float = 0.25, *, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """Flag ``is_test`` whole groups: the ceil(share x groups) groups with the lowest draws."""
    groups = df.select(group).distinct()
    draw = hash_share([group], seed) if draw is None else draw
    chosen = smallest_draws(groups, [group], F.ceil(F.col("_total") * test_share), draw)
    return df.join(chosen.withColumnRenamed("chosen", "is_test"), group)


def held_out(df: DataFrame, group: str, test_share: float = 0.25, *, seed: int = 42) -> Column:
    """``is_test`` of ``group_holdout`` as an expression on a row's group: no row moves to meet its flag. Missing for a missing group."""
    draw = hash_share([group], seed).cast("long")
    groups = df.select(group).distinct().persist()
    place = F.shiftright(draw, 16)
    last = None
    try:
        sizes = sorted(groups.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect())  # 65,536 at most
        wanted = math.ceil(sum(n for _, n in sizes) * test_share)
        for at, n in sizes:
            if 0 < wanted <= n:  # the last draw taken is one of these
                drawn = groups.filter(place == at).select(draw.alias("draw"), F.col(group).alias("group"))
                last = drawn.orderBy("draw", "group").offset(wanted - 1).first()
            wanted -= n
    finally:
        groups.unpersist()
    if last is None:
        return F.when(F.col(group).isNotNull(), F.lit(False))
    same = (draw == last["draw"]) & F.coalesce(F.col(group) <= F.lit(last["group"]), F.lit(False))
    return F.when(F.col(group).isNotNull(), (draw < last["draw"]) | same)


def temporal_split(df: DataFrame, when: str, split: date) -> tuple[DataFrame, DataFrame]:
    """Rows before the split date, and rows from it onwards."""
    day = F.col(when).cast("date")
    return df.filter(day < F.lit(split)), df.filter(day >= F.lit(split))


def fixed_sample(df: DataFrame, key: Sequence[str], rows: int, *, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """Exactly ``rows`` rows (all when there are fewer), lowest draws first; ``key`` must be unique."""
    draw = hash_share(key, seed) if draw is None else draw
    return smallest_draws(df, key, rows, draw).filter("chosen").drop("chosen")


def first_per_class(df: DataFrame, label: str, order: str) -> DataFrame:
    """The first row of each class."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
