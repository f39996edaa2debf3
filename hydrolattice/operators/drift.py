"""Input drift between a reference and a current sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..settings import SCENARIO_SHIFT, Drift
from .ordering import hash_share, running_totals

WASSERSTEIN = "Wasserstein distance (normed)"
KS = "K-S p_value"
_FLAT_STD = 0.001  # smallest deviation a distance is divided by


def is_drifted(method, value, threshold) -> Column:
    """Distances and indices drift when high, p-values when low."""
    return F.when(F.lower(method).rlike("distance|divergence|psi"), value > threshold).otherwise(value < threshold)


def shifted(df: DataFrame, shift: Mapping[str, float] = SCENARIO_SHIFT) -> DataFrame:
    return df.withColumns({c: F.col(c) + d for c, d in shift.items() if c in df.columns})


def two_sample_statistics(reference: DataFrame, current: DataFrame, features: Sequence[str], **options) -> DataFrame:
    """Row counts, reference deviation, K-S statistic and Wasserstein distance per feature.

    Both samples collapse to distinct values per feature, and the two empirical distributions are bucketed
    running counts over those, so a feature's values never meet in one task.
    """
    def side(df: DataFrame, flag: int) -> DataFrame:
        long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "value")
        return long.withColumn("_ref", F.lit(flag))

    both = side(reference, 1).unionAll(side(current, 0)).filter(F.col("value").isNotNull())
    counts = both.groupBy("feature", "value").agg(F.sum("_ref").alias("_r"), F.sum(1 - F.col("_ref")).alias("_c"))
    run = running_totals(counts, ["feature"], ["value"], {"r": "_r", "c": "_c"}, following="after", **options)
    gap = F.abs(F.try_divide(F.col("r").cast("double"), F.col("r_total")) - F.try_divide(F.col("c").cast("double"), F.col("c_total")))
    distances = run.groupBy("feature").agg(
        F.max("r_total").alias("reference_rows"),
        F.max("c_total").alias("current_rows"),
        F.max(gap).alias("ks"),
        F.coalesce(F.sum(gap * (F.col("after") - F.col("value"))), F.lit(0.0)).alias("wasserstein"),
    )
    spread = reference.agg(*[F.stddev_pop(f).alias(f) for f in features]).select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("reference_std")) for f in features]))
    )
    return distances.join(F.broadcast(spread), "feature")  # one row per feature


def ks_p_value(ks: Column, reference_rows: Column, current_rows: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of a two-sample K-S statistic."""
    n, m = reference_rows.cast("double"), current_rows.cast("double")
    lam = F.sqrt(n * m / (n + m)) * ks
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    # The series only converges for positive arguments; below 0.2 the value is 1 to double precision.
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series * 2, F.lit(0.0)), F.lit(1.0)))


def _has_both_sides() -> Column:
    """True, or an error where one sample holds no value of a feature."""
    empty = (F.col("reference_rows") == 0) | (F.col("current_rows") == 0)
    return F.when(empty, F.raise_error(F.concat(F.lit("no value on one side of the drift check: "), F.col("feature"))).cast("boolean")).otherwise(True)


def drift_scores(reference: DataFrame, current: DataFrame, features: Sequence[str], settings: Drift = Drift(), **options) -> DataFrame:
    """(feature, test, score, threshold, drift, distance, p_value): ``settings.method`` names the statistic that decides, at
    any number of rows; both statistics are given. A feature without a value on one side stops the job: it has no distance."""
    if settings.method not in ("distance", "p_value"):
        raise ValueError(f"unknown drift method: {settings.method}")
    by_distance = settings.method == "distance"
    stats = two_sample_statistics(reference, current, features, **options).filter(_has_both_sides()).withColumns({
        "_distance": F.col("wasserstein") / F.greatest(F.col("reference_std"), F.lit(_FLAT_STD)),
        "_p": ks_p_value(F.col("ks"), F.col("reference_rows"), F.col("current_rows")),
    })
    value, test = ("_distance", WASSERSTEIN) if by_distance else ("_p", KS)
    threshold = F.lit(settings.distance_threshold if by_distance else settings.p_threshold)
    return stats.select(
        "feature", F.lit(test).alias("test"), round_even(value, 4).alias("score"), threshold.alias("threshold"),
        is_drifted(F.lit(test), F.col(value), threshold).alias("drift"),
        round_even("_distance", 4).alias("distance"), round_even("_p", 4).alias("p_value"),
    )


def drift_summary(scores: DataFrame, settings: Drift = Drift()) -> DataFrame:
    """One row: drifted share, and the alert and retrain flags."""
    return scores.agg(round_even(F.avg(F.col("drift").cast("double")), 4).alias("drifted_share")).withColumns({
        "drift_share_alert": F.lit(settings.share_alert),
        "drift_detected": F.col("drifted_share") >= settings.share_alert,
        "retrain_recommended": F.col("drifted_share") >= settings.share_alert,
    })


def by_feature(scores: DataFrame) -> DataFrame:
    return scores.orderBy("feature")


def drifted_by_score(scores: DataFrame) -> DataFrame:
    """Drifted inputs, the highest score first."""
    return scores.filter("drift").orderBy(F.col("score").desc(), "feature")


def require_both(reference: DataFrame, current: DataFrame) -> None:
    if reference.isEmpty() or current.isEmpty():
        raise ValueError("a drift check needs reference rows and current rows")


def flagged_sets(scores: DataFrame, shifted_features: DataFrame) -> DataFrame:
    """(feature, outcome): shifted inputs flagged, shifted inputs missed, and others flagged in error."""
    flagged = scores.filter("drift").select("feature")
    moved = shifted_features.select("feature")
    return (
        moved.intersect(flagged).withColumn("outcome", F.lit("flagged"))
        .unionByName(moved.exceptAll(flagged).withColumn("outcome", F.lit("missed")))
        .unionByName(flagged.exceptAll(moved).withColumn("outcome", F.lit("false_alarm")))
    )


def sensitivity(df: DataFrame, key: Sequence[str], features: Sequence[str], settings: Drift = Drift(), *, shift: Mapping[str, float] = SCENARIO_SHIFT, seed: int = 42, half: Column | None = None, **options) -> dict[str, DataFrame]:
    """All rows in two disjoint halves by the draw of their key: scores unchanged (control) and with the second half shifted
    (simulated). A row without a key has a draw too."""
    draw = hash_share(key, seed) < (1 << 31) if half is None else half
    reference = df.filter(draw).select(*features)
    unchanged = df.filter(~draw).select(*features)
    return {
        "control": drift_scores(reference, unchanged, features, settings, **options),
        "simulated": drift_scores(reference, shifted(unchanged, shift), features, settings, **options),
    }
