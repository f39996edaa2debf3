"""Area and priority KPIs per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even, share
from ..settings import CLASS_LABELS, Grid


def cells_per_date(df: DataFrame, cell: str = "cell_id", when: str = "date") -> DataFrame:
    """Distinct cells of each date; duplicates collapse before the count."""
    return df.select(when, cell).distinct().groupBy(when).agg(F.count(cell).alias("cells"))


def latest_covered_date(df: DataFrame, cell: str = "cell_id", when: str = "date", coverage: float = 0.9) -> DataFrame:
    """One row: the newest date that covers at least ``coverage`` of the best date's cells."""
    per = cells_per_date(df, cell, when)
    best = per.agg(F.max("cells").alias("_best")).withColumn("_j", F.lit(1))  # one row
    return per.withColumn("_j", F.lit(1)).join(F.broadcast(best), "_j").agg(
        F.max(F.when(F.col("cells") >= F.col("_best") * coverage, F.col(when))).alias("latest_date")
    )


def require_date(df: DataFrame, wanted, when: str = "date") -> DataFrame:
    """The rows of one date; raises when the table does not hold it."""
    out = df.filter(F.col(when).cast("date") == F.lit(wanted).cast("date"))
    if out.isEmpty():
        raise ValueError(f"date {wanted} is not in the table")
    return out


def cell_parts(df: DataFrame, *, cell: str = "cell_id", when: str = "date", vegetated: Column, stress: str = "stress_code", priority: str = "priority", ndvi: str = "ndvi_mean", ndwi: str = "ndwi_mean", exact: bool = False) -> DataFrame:
    """One row per (date, cell) with the counts and sums that a date's KPIs are made of.

    All parts add up over cells, and can be taken off again. ``exact`` keeps the sums as decimals, which leave nothing behind.
    """
    keep = F.coalesce(vegetated, F.lit(False))

    def counted(condition: Column) -> Column:
        return F.count_if(keep & condition)

    parts = {f"_s{i}": counted(F.col(stress) == i) for i in range(len(CLASS_LABELS))}
    parts |= {f"_p{i}": counted(F.col(priority) == i) for i in (1, 2, 3)}
    parts |= {"_crop": F.count_if(keep)}
    for tag, name in (("ndvi", ndvi), ("ndwi", ndwi)):
        value = F.col(name).cast("decimal(28,12)") if exact else F.col(name)
        parts |= {f"_sum_{tag}": F.sum(F.when(keep, value)), f"_n_{tag}": F.count(F.when(keep, F.col(name)))}
    return df.groupBy(when, cell).agg(*[c.alias(n) for n, c in parts.items()])


def kpis_of_parts(per_date: DataFrame, *, when: str = "date", grid: Grid = Grid()) -> DataFrame:
    """One flat row per date that has vegetated rows, from the sums of its cells' parts and ``_cells``, their number."""
    def hectares(n: str) -> Column:
        return F.bround(F.col(n) * grid.cell_area_ha, 1)

    def percent(n: str) -> Column:
        return F.coalesce(round_even(share(n, "_crop") * 100, 1), F.lit(0.0))

    def mean(name: str) -> Column:
        return round_even(share(F.col(f"_sum_{name}").cast("double"), f"_n_{name}"), 3)

    levels = {"high": "_s2", "moderate": "_s1", "low": "_s0"}
    ranks = {"priority_1": ("_p1", "urgent"), "priority_2": ("_p2", "scheduled"), "priority_3": ("_p3", "normal")}
    return per_date.filter(F.col("_crop") > 0).select(
        F.col(when).alias("cycle_date"),
        F.col("_cells").alias("total_culturable_cells"),
        F.col("_crop").alias("active_cultivated_cells"),
        (F.col("_cells") - F.col("_crop")).alias("fallow_or_bare_cells"),
        hectares("_crop").alias("total_cultivated_hectares"),
        *[c for k, n in levels.items() for c in (hectares(n).alias(f"{k}_stress_hectares"), percent(n).alias(f"{k}_stress_pct"))],
        *[c for k, (n, word) in ranks.items() for c in (hectares(n).alias(f"{k}_{word}_ha"), percent(n).alias(f"{k}_pct"))],
        mean("ndvi").alias("mean_ndvi"),
        mean("ndwi").alias("mean_ndwi"),
    )


def cycle_kpis(df: DataFrame, *, cell: str = "cell_id", when: str = "date", vegetated: Column, grid: Grid = Grid(), **columns) -> DataFrame:
    """One flat row per date that has vegetated rows.

    A first aggregate leaves one row per (date, cell) with its counts and sums, so distinct cells come
    without a second pass, and one busy date is spread over its cells.
    """
    per_cell = cell_parts(df, cell=cell, when=when, vegetated=vegetated, **columns)
    parts = [c for c in per_cell.columns if c.startswith("_")]
    per_date = per_cell.groupBy(when).agg(F.count(cell).alias("_cells"), *[F.sum(n).alias(n) for n in parts])
    return kpis_of_parts(per_date, when=when, grid=grid)


def nested_kpis(flat: DataFrame) -> DataFrame:
    """The KPI document shape: three nested groups."""
    stress = [f"{k}_stress_{u}" for k in ("high", "moderate", "low") for u in ("hectares", "pct")]
    ranks = [c for k, w in (("1", "urgent"), ("2", "scheduled"), ("3", "normal")) for c in (f"priority_{k}_{w}_ha", f"priority_{k}_pct")]
    heads = ["cycle_date", "total_culturable_cells", "active_cultivated_cells", "fallow_or_bare_cells", "total_cultivated_hectares"]
    return flat.select(
        *heads,
        F.struct(*stress).alias("stress_breakdown"),
        F.struct(*ranks).alias("irrigation_priority_breakdown"),
        F.struct("mean_ndvi", "mean_ndwi").alias("mean_canopy_metrics"),
    )


def class_areas(flat: DataFrame) -> DataFrame:
    """Long form: hectares per date and stress class."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("stress_class"), F.col(f"{label.lower()}_stress_hectares").alias("hectares")) for label in CLASS_LABELS
    ])
    return flat.select("cycle_date", F.inline(rows))


def drift_by_scenario(scenarios: dict[str, DataFrame], value: str = "drifted_share") -> DataFrame:
    """Long form: drift share per scenario. A scenario that was not run gives no row."""
    out = None
    for name, table in scenarios.items():
        rows = table.select(F.lit(name).alias("scenario"), value)
        out = rows if out is None else out.unionByName(rows)
    return out
