"""Exploratory tables: shares, summaries, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even, share
from .ordering import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def class_shares(df: DataFrame, label: str, classes: Sequence, group: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Count and percentage of each class in a fixed order, zero where a class is absent.

    Percentages are over the non-missing labels, listed or not.
    """
    counts = df.groupBy(*group).agg(
        F.count(label).alias("_all"), *[F.count_if(F.col(label) == c).alias(f"_c{i}") for i, c in enumerate(classes)]
    )
    listed = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias(label), F.col(f"_c{i}").alias("rows")) for i, c in enumerate(classes)
    ])
    pct = F.coalesce(round_even(share("rows", "_all") * 100, digits), F.lit(0.0))
    return counts.select(*group, "_all", F.inline(listed)).withColumn("pct", pct).drop("_all")


def describe(df: DataFrame, columns: Sequence[str], group: Sequence[str] = (), digits: int = 4, **options) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, one row per column."""
    moments = df.groupBy(*group).agg(*[
        F.struct(
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c)
        for c in columns
    ])
    long = moments.select(*group, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(c)[k].alias(k) for k in ("count", "mean", "std", "min", "max")]) for c in columns
    ])))
    quartiles = exact_quantiles(df, list(group), columns, QUARTILES, **options)
    joined = long.join(quartiles, [*group, "column"], "left")
    return joined.select(
        *group, "column", "count", *[round_even(c, digits).alias(c) for c in ("mean", "std", "min", *QUARTILES, "max")]
    )


def group_means(df: DataFrame, label: str, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return df.groupBy(label).agg(*[round_even(F.avg(c), digits).alias(c) for c in columns])


def correlations(df: DataFrame, columns: Sequence[str], target: str, digits: int = 4) -> DataFrame:
    """Pearson correlation of every column with the target, from one pass."""
    one = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), round_even(c, digits).alias("corr")) for c in columns])
    return one.select(F.inline(rows)).orderBy(F.col("corr").desc_nulls_last(), "column")


def extreme_correlations(ordered: DataFrame, top: int = 10, bottom: int = 5) -> DataFrame:
    """The highest ``top`` and lowest ``bottom`` correlations."""
    high = ordered.orderBy(F.col("corr").desc_nulls_last(), "column").limit(top).withColumn("side", F.lit("top"))
    low = ordered.orderBy(F.col("corr").asc_nulls_last(), "column").limit(bottom).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


def missing_audit(df: DataFrame, digits: int = 2) -> DataFrame:
    """Missing rows and percentage of every column, from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"), round_even(share(c, "_rows") * 100, digits).alias("missing_pct"))
        for c in df.columns
    ])
    return one.select(F.inline(rows))


def dataset_profile(df: DataFrame, cell: str, when: str, vegetated: Column) -> DataFrame:
    """Rows, columns, distinct cells and dates, first and last date, vegetated and other rows.

    Reduced to one row per (cell, date) first, so the distinct counts shuffle keys and not the table.
    """
    keys = df.select(F.col(cell).alias("_cell"), F.col(when).cast("date").alias("_day"), F.coalesce(vegetated, F.lit(False)).alias("_veg"))
    slim = keys.groupBy("_cell", "_day").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_veg").alias("_v"))
    return slim.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.count_distinct("_cell").alias("cells"),
        F.count_distinct("_day").alias("dates"),
        F.min("_day").alias("first_date"),
        F.max("_day").alias("last_date"),
        F.coalesce(F.sum("_v"), F.lit(0)).alias("vegetated_rows"),
        F.coalesce(F.sum(F.col("_n") - F.col("_v")), F.lit(0)).alias("other_rows"),
    )
