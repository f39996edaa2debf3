"""Scoring of arriving feature rows, and the KPIs of the dates they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.learn import score
from .kpi_view import KpiView

RESULT_COLUMNS = (
    "date", "cell_id", "stress_code", "confidence", "priority", "ndvi_mean", "ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day",
)


def scored_rows(batch: DataFrame, model, features: Sequence[str]) -> DataFrame:
    """Results of the vegetated rows; the other rows stay without a class, as cells of their date."""
    scored = score(model, batch.filter(F.col("is_vegetated")), features).select(*RESULT_COLUMNS, F.lit(True).alias("is_vegetated"))
    bare = batch.filter(~F.coalesce(F.col("is_vegetated"), F.lit(False)))
    types = dict(scored.dtypes)
    blank = bare.select(*[(F.col(c) if c in bare.columns else F.lit(None)).cast(types[c]).alias(c) for c in RESULT_COLUMNS], F.lit(False).alias("is_vegetated"))
    return scored.unionByName(blank)


def score_batch(batch: DataFrame, number: int, model, features: Sequence[str], view: KpiView) -> None:
    """Score one batch and add it to the view. Of rows that share date and cell the most confident counts; a later batch
    replaces what earlier ones said of a (date, cell)."""
    view.add(scored_rows(batch, model, features), number, [F.col("confidence").desc_nulls_last()])


def start(rows: DataFrame, model, features: Sequence[str], view: KpiView, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: score_batch(batch, number, model, features, view))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
