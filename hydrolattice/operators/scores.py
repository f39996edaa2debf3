"""Model scores from confusion counts, ranking quality, gate verdicts and latency summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even, share
from ..settings import Gate
from .ordering import quantiles_of_counts, running_totals

CLASSES = (0, 1, 2)


def _count_where(condition: Column, rows: str | None) -> Column:
    """How many rows meet a condition, where a row may stand for ``rows`` equal ones."""
    return F.count_if(condition) if rows is None else F.coalesce(F.sum(F.when(condition, F.col(rows))), F.lit(0))


def _count_columns(actual: Column, predicted: Column, classes: Sequence, rows: str | None = None) -> list[Column]:
    return [
        _count_where((actual == a) & (predicted == p), rows).alias(f"_n_{i}_{j}")
        for i, a in enumerate(classes) for j, p in enumerate(classes)
    ]


def confusion(df: DataFrame, actual: str, predicted: str, classes: Sequence = CLASSES, group: Sequence[str] = ()) -> DataFrame:
    """One row per (actual, predicted), zeros included, with the share of the actual class."""
    k = range(len(classes))
    counts = df.groupBy(*group).agg(*_count_columns(F.col(actual), F.col(predicted), classes))
    cells = F.array(*[
        F.struct(
            F.lit(classes[i]).alias("actual"), F.lit(classes[j]).alias("predicted"), F.col(f"_n_{i}_{j}").alias("rows"),
            sum((F.col(f"_n_{i}_{m}") for m in k), F.lit(0)).alias("_actual_rows"),
        )
        for i in k for j in k
    ])
    out = counts.select(*group, F.inline(cells))
    return out.withColumn("row_share", F.coalesce(round_even(share("rows", "_actual_rows"), 4), F.lit(0.0))).drop("_actual_rows")


def _per_class(classes: Sequence) -> dict[int, dict[str, Column]]:
    k = range(len(classes))
    out = {}
    for i in k:
        hit = F.col(f"_n_{i}_{i}")
        actual = sum((F.col(f"_n_{i}_{m}") for m in k), F.lit(0))
        predicted = sum((F.col(f"_n_{m}_{i}") for m in k), F.lit(0))
        zero = F.lit(0.0)
        out[i] = {
            "precision": F.coalesce(share(hit, predicted), zero),
            "recall": F.coalesce(share(hit, actual), zero),
            "f1": F.coalesce(share(hit * 2, actual + predicted), zero),
            "support": actual,
        }
    return out


def class_scores(df: DataFrame, actual: str, predicted: str, classes: Sequence = CLASSES, group: Sequence[str] = (), digits: int = 4, *, rows: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, next to accuracy, macro and weighted F1 of the whole. ``rows`` names a column
    of how many equal rows a row stands for."""
    counts = df.groupBy(*group).agg(*_count_columns(F.col(actual), F.col(predicted), classes, rows))
    per = _per_class(classes)
    total = sum((per[i]["support"] for i in per), F.lit(0))
    hits = sum((F.col(f"_n_{i}_{i}") for i in per), F.lit(0))
    macro = sum((per[i]["f1"] for i in per), F.lit(0.0)) / len(classes)
    weighted = F.coalesce(share(sum((per[i]["f1"] * per[i]["support"] for i in per), F.lit(0.0)), total), F.lit(0.0))
    listed = F.array(*[
        F.struct(
            F.lit(classes[i]).alias("class"),
            *[round_even(per[i][m], digits).alias(m) for m in ("precision", "recall", "f1")],
            per[i]["support"].alias("support"),
        )
        for i in per
    ])
    return counts.select(
        *group,
        round_even(F.coalesce(share(hits, total), F.lit(0.0)), digits).alias("accuracy"),
        round_even(macro, digits).alias("macro_f1"),
        round_even(weighted, digits).alias("weighted_f1"),
        F.inline(listed),
    )


def group_scores(df: DataFrame, group: Sequence[str], actual: str, predicted: str, classes: Sequence = CLASSES, high=2, digits: int = 4) -> DataFrame:
    """Rows, macro F1 over the classes present, accuracy, recall of the high class (missing if absent) and class count."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *_count_columns(F.col(actual), F.col(predicted), classes))
    per = _per_class(classes)
    present = sum((F.when(per[i]["support"] > 0, 1).otherwise(0) for i in per), F.lit(0))
    f1_sum = sum((F.when(per[i]["support"] > 0, per[i]["f1"]).otherwise(0.0) for i in per), F.lit(0.0))
    hits = sum((F.col(f"_n_{i}_{i}") for i in per), F.lit(0))
    at = list(classes).index(high)
    return counts.select(
        *group,
        "rows",
        round_even(share(f1_sum, present), digits).alias("macro_f1"),
        round_even(share(hits, "rows"), digits).alias("accuracy"),
        F.when(per[at]["support"] > 0, round_even(per[at]["recall"], digits)).alias("high_stress_recall"),
        present.alias("classes_present"),
    )


def largest_gap(scores: DataFrame, metric: str = "macro_f1", digits: int = 4) -> DataFrame:
    return scores.agg(round_even(F.max(metric) - F.min(metric), digits).alias("largest_gap"))


def value_bounds(df: DataFrame, group: str, value: str, digits: int = 3) -> DataFrame:
    return df.groupBy(group).agg(round_even(F.min(value), digits).alias("low"), round_even(F.max(value), digits).alias("high"))


def roc_auc(df: DataFrame, actual: str, scores: Mapping[int, str], group: Sequence[str] = (), digits: int = 4, *, rows: str | None = None, **options) -> DataFrame:
    """One-vs-rest area under the ROC curve per class; tied scores count half. Missing when a side is empty.

    ``rows`` names a column of how many equal rows a row stands for. Rows collapse to distinct scores first, and running counts are kept per bucket of scores.
    """
    listed = F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("score"), (F.col(actual) == c).alias("hit")) for c, s in scores.items()
    ])
    times = [] if rows is None else [rows]
    distinct = df.select(*group, *times, F.inline(listed)).groupBy(*group, "class", "score").agg(
        _count_where(F.col("hit"), rows).alias("pos"), _count_where(~F.col("hit"), rows).alias("neg")
    )
    run = running_totals(distinct, [*group, "class"], ["score"], {"negs": "neg", "poss": "pos"}, **options)
    won = F.sum(F.col("pos") * (F.col("negs") - F.col("neg") * 0.5))
    area = F.try_divide(won, F.max("poss_total").cast("double") * F.max("negs_total"))
    return run.groupBy(*group, "class").agg(round_even(area, digits).alias("auc"))


def macro_auc(per_class: DataFrame, group: Sequence[str] = (), digits: int = 4) -> DataFrame:
    return per_class.groupBy(*group).agg(round_even(F.avg("auc"), digits).alias("macro_auc"))


def class_weights(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Balanced weight of each class: rows / (classes x class rows)."""
    counts = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy(*group).agg(F.sum("rows").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    if group:
        both = counts.join(totals, list(group))
    else:
        both = counts.withColumn("_j", F.lit(1)).join(F.broadcast(totals.withColumn("_j", F.lit(1))), "_j").drop("_j")
    return both.withColumn("weight", share("_all", F.col("_classes") * F.col("rows"))).drop("_all", "_classes")


def gate_verdict(scores: DataFrame, candidate: str, champion: str, gate: Gate = Gate()) -> DataFrame:
    """Promotion verdict and its reason for each row of candidate and champion scores."""
    needed = F.col(champion) + gate.min_improvement
    low = F.col(candidate) < gate.min_score

    def four(value) -> Column:
        return F.format_string("%.4f", round_even(value, 4))

    passed = ~low & (F.col(champion).isNull() | (F.col(candidate) >= needed))
    reason = (
        F.when(low, F.concat(F.lit("score "), four(candidate), F.lit(f" is under the minimum of {gate.min_score:.4f}")))
        .when(F.col(champion).isNull(), F.lit("there is no champion yet"))
        .when(F.col(candidate) >= needed, F.concat(F.lit("score "), four(candidate), F.lit(" reaches the required "), four(needed)))
        .otherwise(F.concat(F.lit("score "), four(candidate), F.lit(" is under the required "), four(needed)))
    )
    return scores.withColumns({"promoted": passed, "reason": reason})


def best_model(scores: DataFrame, model: str, score: str, priority: str, group: Sequence[str] = ()) -> DataFrame:
    """Highest score; the lowest priority number (the baseline first) wins ties."""
    place = F.struct(F.col(score), -F.col(priority))
    return scores.groupBy(*group).agg(F.max_by(model, place).alias("best_model"), F.max(score).alias("best_score"))


def latency_summary(df: DataFrame, label: str, millis: str, failed: Column, elapsed_s: float | Column, **options) -> DataFrame:
    """Requests, errors, error rate, throughput and p50/p95/p99/max per request type, plus an overall row.

    The log collapses to distinct latencies per type, and the overall row adds those up instead of reading the log again.
    """
    log = df.select(F.col(label).alias("request"), F.col(millis).cast("double").alias("value"), failed.cast("int").alias("_bad"))
    by_value = log.groupBy("request", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("_bad"))
    overall = by_value.groupBy("value").agg(F.sum("n").alias("n"), F.sum("_bad").alias("_bad")).withColumn("request", F.lit("overall"))
    every = by_value.unionByName(overall)
    counts = every.groupBy("request").agg(
        F.sum("n").alias("requests"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("errors"), F.max("value").alias("_max")
    )
    points = quantiles_of_counts(
        every.select("request", "value", "n").filter(F.col("value").isNotNull()), ["request"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}, **options
    )
    return counts.join(points, "request").select(
        "request", "requests", "errors",
        round_even(share("errors", "requests"), 4).alias("error_rate"),
        round_even(share("requests", elapsed_s), 2).alias("throughput_rps"),
        *[round_even(c, 1).alias(n) for n, c in (("p50", "p50"), ("p95", "p95"), ("p99", "p99"), ("max", "_max"))],
    )


