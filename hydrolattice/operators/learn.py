"""Training, scoring and attribution with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import (
    GBTClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import advice
from ..functions.numeric import round_even, share
from ..settings import CLASS_LABELS, FORM_DEFAULTS, FORM_RANGES, REQUEST_DEFAULTS, Training
from . import counted_trees
from .partitioning import spread
from .sampling import fixed_sample, held_out
from .scores import class_scores, class_weights, macro_auc, roc_auc

# Readable names of model inputs.
FEATURE_NAMES = {
    "ndvi_mean": "Greenness", "ndvi_std": "Greenness spread", "ndwi_mean": "Leaf water", "ndwi_std": "Leaf water spread",
    "evi_mean": "Enhanced greenness", "evi_std": "Enhanced greenness spread",
    "b02_mean": "Blue band", "b03_mean": "Green band", "b04_mean": "Red band", "b08_mean": "Near-infrared band",
    "b11_mean": "Shortwave band 1", "b12_mean": "Shortwave band 2",
    "temp_mean_c": "Mean temperature", "temp_max_c": "Maximum temperature", "humidity_pct": "Humidity",
    "wind_speed_mps": "Wind speed", "solar_radiation_mj": "Solar energy",
    "rainfall_8day": "Rain, 8 days", "rainfall_16day": "Rain, 16 days", "rainfall_30day": "Rain, 30 days",
    "temp_8day_mean": "Mean temperature, 8 days", "temp_30day_mean": "Mean temperature, 30 days",
    "temp_8day_max": "Maximum temperature, 8 days",
    "et0_8day_sum": "Evaporative demand, 8 days", "et0_16day_sum": "Evaporative demand, 16 days",
}
MODELS = ("forest", "boosted_deep", "boosted_light")  # priority order: the baseline first


def fill_inputs(df: DataFrame, features: Sequence[str], defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Add absent inputs and fill missing values: the given default, else 0.0."""
    defaults = defaults or {}
    have = set(df.columns)
    return df.withColumns({
        f: F.coalesce(F.col(f).cast("double") if f in have else F.lit(None).cast("double"), F.lit(float(defaults.get(f, 0.0)))) for f in features
    })


def with_vector(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)


def with_weights(df: DataFrame, label: str, output: str = "class_weight") -> DataFrame:
    """Balanced class weight per labelled row; rows without a label have no class and are left out."""
    labelled = df.filter(F.col(label).isNotNull())
    return _weighted(labelled, class_weights(labelled, label), label, output)


def _weighted(df: DataFrame, weights: DataFrame, label: str, output: str = "class_weight") -> DataFrame:
    """Rows with the weight of their class. There is one weight per class, and no row may move: by label, rows would meet in a task per class."""
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias(output))), label)


def boosted_depth(name: str, settings: Training) -> int:
    """The light model stops at depth 5: 31 leaves or fewer."""
    return settings.boost_depth if name == "boosted_deep" else min(settings.boost_depth, 5)


def estimator(name: str, settings: Training = Training(), *, label: str = "label", weight: str = "class_weight"):
    """An untrained model; all three correct for class imbalance through weights."""
    common = {"featuresCol": "features", "labelCol": label, "weightCol": weight, "seed": settings.seed}
    bins = {"maxBins": settings.max_bins}
    if name == "forest":
        return RandomForestClassifier(numTrees=settings.forest_trees, maxDepth=settings.forest_depth, **bins, **common)
    if name in MODELS:
        boost = GBTClassifier(
            maxIter=settings.boost_rounds, maxDepth=boosted_depth(name, settings),
            stepSize=settings.boost_step, subsamplingRate=settings.boost_subsample, **bins, **common,
        )
        return OneVsRest(classifier=boost, featuresCol="features", labelCol=label, weightCol=weight)
    raise ValueError(f"unknown model: {name}")


@contextmanager
def training_rows(df: DataFrame, features: Sequence[str], target: str) -> Iterator[DataFrame]:
    """Vectors, labels and weights of the rows that have a target, to fit any number of models on.

    The rows are dealt out evenly once and kept as plain columns meanwhile, as fitting passes over them many times.
    """
    rows = df.filter(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias("label"))
    kept = _weighted(fill_inputs(spread(rows), features), class_weights(rows, "label"), "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield with_vector(kept, features)
    finally:
        kept.unpersist()


def train(df: DataFrame, name: str, features: Sequence[str], target: str, settings: Training = Training()):
    """Fit one model on rows that have a target."""
    with training_rows(df, features, target) as rows:
        return estimator(name, settings).fit(rows)


def with_probabilities(model, df: DataFrame, vector: str = "features", output: str = "probabilities") -> DataFrame:
    """Class probabilities as an array. One-vs-rest models give each class's own probability over their sum."""
    if isinstance(model, RandomForestClassificationModel):
        scorer = model.copy().setFeaturesCol(vector).setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_prob")
        return scorer.transform(df).withColumn(output, vector_to_array("_prob")).drop("_prob")
    if not isinstance(model, OneVsRestModel):
        raise TypeError(f"cannot score with {type(model).__name__}")
    out = df
    for k, part in enumerate(model.models):
        scorer = part.copy().setFeaturesCol(vector).setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_prob")
        out = scorer.transform(out).withColumn(f"_p{k}", vector_to_array("_prob")[1]).drop("_prob")
    parts = [F.col(f"_p{k}") for k in range(len(model.models))]
    total = sum(parts[1:], parts[0])
    return out.withColumn(output, F.array(*[F.coalesce(share(p, total), F.lit(1.0 / len(parts))) for p in parts])).drop(
        *[f"_p{k}" for k in range(len(parts))]
    )


def best_class(probabilities="probabilities") -> Column:
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def _probability(code: Column) -> Column:
    """Probability of one class; 0 for a class the model never saw."""
    return F.coalesce(F.get("probabilities", code), F.lit(0.0))


def score(model, df: DataFrame, features: Sequence[str], *, keep_probabilities: bool = False, digits: int = 3) -> DataFrame:
    """Stress code, confidence and irrigation priority per row."""
    vectors = with_vector(fill_inputs(df, features), features)
    out = with_probabilities(model, vectors).withColumns({
        "stress_code": best_class(), "confidence": round_even(F.array_max("probabilities"), digits),
    })
    if {"ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day"} <= set(out.columns):
        out = out.withColumn("priority", advice.priority(advice.rule("stress_code", "ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day")))
    return out.drop("features") if keep_probabilities else out.drop("features", "probabilities")


def request_form(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests with the form's defaults filled in, and the rejected ones as they came."""
    outside = F.lit(False)
    for c, (low, high) in FORM_RANGES.items():
        if c in requests.columns:
            outside = outside | F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))
    return fill_inputs(requests.filter(~outside), list(FORM_DEFAULTS), FORM_DEFAULTS), requests.filter(outside)


def what_if(model, requests: DataFrame, features: Sequence[str], language: str | Column = "en") -> DataFrame:
    """Score a table of scenarios and attach localised advice; absent inputs take their defaults.

    Adds class code, confidence and labelled probabilities to four digits, and the advisory.
    """
    # Advice reads its own copies of four inputs, because the model fills absent inputs with zero.
    given = {c: F.col(c) if c in requests.columns else F.lit(None).cast("double") for c in REQUEST_DEFAULTS}
    copies = requests.withColumns({f"_{c}": F.coalesce(v.cast("double"), F.lit(REQUEST_DEFAULTS[c])) for c, v in given.items()})
    scored = score(model, copies, features, keep_probabilities=True, digits=4)
    by_label = F.create_map(*[v for i, name in enumerate(CLASS_LABELS) for v in (F.lit(name), round_even(_probability(F.lit(i)), 4))])
    told = advice.advisory_in(language, "stress_code", "confidence", *[f"_{c}" for c in ("ndwi_mean", "temp_max_c", "et0_8day_sum", "rainfall_8day")])
    return scored.withColumns({"advisory": told, "class_probabilities": by_label}).drop(*[f"_{c}" for c in REQUEST_DEFAULTS])


def importances(model: RandomForestClassificationModel, features: Sequence[str], spark) -> DataFrame:
    """Share of importance per feature, highest first; shares add up to 1."""
    values = [float(v) for v in model.featureImportances.toArray()]
    total = sum(values) or 1.0
    rows = [(f, v / total) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, share double").orderBy(F.col("share").desc(), "feature")


def feature_means(df: DataFrame, features: Sequence[str]) -> list[float]:
    """Training means, one number per feature."""
    row = fill_inputs(df, features).agg(*[F.avg(f).alias(f) for f in features]).first()
    return [float(row[f] or 0.0) for f in features]


def means_row(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Training means as a table of one row, which a plan over the same rows computes along with the rest."""
    return fill_inputs(df, features).agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in features])


def impacts(
    model, df: DataFrame, key: Sequence[str], features: Sequence[str], means: Sequence[float] | DataFrame, target_class: int | None = None, *, by_key: bool = False
) -> DataFrame:
    """(key, feature, value, impact): how much the class probability falls when one input is set to its mean.

    Every row becomes one variant per feature, and all variants are scored in one pass. Rows are hashed by key
    before they multiply, so gathering a row's variants again needs no shuffle; ``by_key`` says that they are already,
    as after ``keep_last``. ``means`` of ``means_row`` over the same rows share their shuffle. ``target_class``
    defaults to the row's predicted class.
    """
    inputs = fill_inputs(df, features).select(*dict.fromkeys([*key, *features]))
    base = with_probabilities(model, with_vector(inputs if by_key else spread(inputs, *key), features))
    aim = best_class() if target_class is None else F.lit(target_class)
    row = base.select(*key, F.array(*features).alias("_x"), aim.alias("class"), _probability(aim).alias("_p"))
    if isinstance(means, DataFrame):
        one = means.select(F.array(*features).alias("_means"), F.lit(1).alias("_j"))
        row, typical = row.withColumn("_j", F.lit(1)).join(F.broadcast(one), "_j"), F.col("_means")
    else:
        typical = F.array(*[F.lit(float(m)) for m in means])
    variants = row.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))).withColumn(
        "features", array_to_vector(F.transform("_x", lambda v, j: F.when(j == F.col("_i"), typical[F.col("_i")]).otherwise(v)))
    )
    scored = with_probabilities(model, variants)
    names = F.array(*map(F.lit, features))
    return scored.select(
        *key, "class", names[F.col("_i")].alias("feature"), F.col("_x")[F.col("_i")].alias("value"),
        (F.col("_p") - _probability(F.col("class"))).alias("impact"),
    )


def top_drivers(impact: DataFrame, key: Sequence[str], top_k: int = 4) -> DataFrame:
    """The ``top_k`` inputs by absolute impact per row, with their share of all impact and direction.

    ``key`` identifies a row, so a group holds one entry per model input. Grouping by the key alone reuses a
    partitioning by key where there is one.
    """
    labels = F.create_map(*[F.lit(v) for pair in FEATURE_NAMES.items() for v in pair])
    entry = F.struct(-F.abs("impact"), F.col("feature"), F.col("value"), F.col("impact"))
    grouped = impact.groupBy(*key).agg(F.max("class").alias("class"), F.sum(F.abs("impact")).alias("_all"), F.array_sort(F.collect_list(entry)).alias("_e"))
    rows = grouped.select(*key, "class", "_all", F.posexplode(F.slice("_e", 1, top_k)).alias("_at", "e"))
    rises = F.col("e.impact") > 0
    return rows.select(
        *key,
        "class",
        (F.col("_at") + 1).alias("rank"),
        F.col("e.feature").alias("feature"),
        F.coalesce(F.try_element_at(labels, F.col("e.feature")), F.col("e.feature")).alias("label"),
        round_even("e.value", 3).alias("value"),
        F.coalesce(round_even(share(F.abs("e.impact"), "_all") * 100, 1), F.lit(0.0)).alias("impact_pct"),
        # Direction codes and arrows of a driver.
        F.when(rises, "increases_stress").otherwise("mitigates_stress").alias("direction"),
        F.when(rises, "↑").otherwise("↓").alias("arrow"),
    ).withColumn(
        "summary",
        F.concat(
            F.col("arrow"), F.lit(" "), F.col("label"), F.lit(" ("), F.format_string("%.2f", "value"), F.lit("): "),
            F.col("impact_pct").cast("string"), F.lit("% of the impact on "),
            F.try_element_at(F.array(*map(F.lit, CLASS_LABELS)), F.col("class") + 1),
        ),
    )


def importance_drivers(ranked_importances: DataFrame, rows: DataFrame, key: Sequence[str], features: Sequence[str], top_k: int = 4) -> DataFrame:
    """Drivers without a direction: the model's ``top_k`` importances, as shares of those ``top_k`` only."""
    top = ranked_importances.limit(top_k)
    total = top.agg(F.sum("share").alias("_total")).withColumn("_j", F.lit(1))
    shares = top.withColumn("_j", F.lit(1)).join(F.broadcast(total), "_j").select(
        "feature", F.coalesce(round_even(share("share", "_total") * 100, 1), F.lit(0.0)).alias("impact_pct")
    )
    long = fill_inputs(rows, features).unpivot(list(key), list(features), "feature", "value")
    return long.join(F.broadcast(shares), "feature").withColumns({  # top_k rows
        "value": round_even("value", 3), "direction": F.lit("influences_prediction"),
    })


def global_attribution(
    model, df: DataFrame, key: Sequence[str], features: Sequence[str], means: Sequence[float] | DataFrame, *,
    rows: int | None = None, target_class: int = 2, top: int = 12, seed: int = 42, by_key: bool = False,
) -> DataFrame:
    """Mean absolute impact per feature on one class, the ``top`` features: over all rows, or a fixed sample of ``rows``."""
    sample = df if rows is None else fixed_sample(df, key, rows, seed=seed)
    found = impacts(model, sample, key, features, means, target_class, by_key=by_key)
    return found.groupBy("feature").agg(round_even(F.avg(F.abs("impact")), 6).alias("mean_abs_impact")).orderBy(
        F.col("mean_abs_impact").desc(), "feature"
    ).limit(top)


def evaluate(model, test: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row: accuracy, macro and weighted F1, and macro one-vs-rest AUC."""
    scored = score(model, test, features, keep_probabilities=True)
    wide = scored.select(F.col(target).cast("int").alias("actual"), "stress_code", *[_probability(F.lit(i)).alias(f"p{i}") for i in range(3)])
    # Trees give few distinct outcomes: rows are scored once and counted, and all scores come from the counts.
    counted = wide.groupBy(*wide.columns).agg(F.count(F.lit(1)).alias("n"))
    f1 = class_scores(counted, "actual", "stress_code", rows="n").select("accuracy", "macro_f1", "weighted_f1").distinct().withColumn("_j", F.lit(1))
    auc = macro_auc(roc_auc(counted, "actual", {i: f"p{i}" for i in range(3)}, rows="n")).withColumn("_j", F.lit(1))
    return f1.join(F.broadcast(auc), "_j").drop("_j")  # one row on each side


def three_way_test(df: DataFrame, settings: Training = Training(), models: Sequence[str] = MODELS, *, group: str = "cell_id", when: str = "date") -> DataFrame:
    """Scores of each model on unseen groups, on later dates, and on later dates without the label inputs.

    Rows that no model can tell apart are counted once per test, and all models of all tests are fitted on these counts together.
    """
    spark, features = df.sparkSession, settings.features
    for name in models:
        estimator(name, settings)  # unknown names stop here
    flags = {"unseen": held_out(df, group, settings.test_share, seed=settings.seed), "later": F.col(when).cast("date") >= F.lit(settings.split)}
    rows = fill_inputs(df.filter(F.col(settings.target).isNotNull()).withColumns({f"_{n}": flag for n, flag in flags.items()}), features)
    rows = rows.select(*features, F.col(settings.target).alias("label"), *[f"_{n}" for n in flags])
    tests = {
        "unseen_cells": ("unseen", ()), "later_dates": ("later", ()),
        "later_dates_without_label_inputs": ("later", tuple(i for i, f in enumerate(features) if f in settings.label_inputs)),
    }
    limits = counted_trees.bin_limits(rows, features, {n: ~F.col(f"_{n}") for n in flags}, settings.max_bins)
    splits = {n: counted_trees.counted_rows(rows, "label", f"_{n}", limits[n]).persist(StorageLevel.MEMORY_AND_DISK) for n in flags}
    counted = None
    for i, (split, left_out) in enumerate(tests.values()):
        own = (counted_trees.without_inputs(splits[split], left_out, len(features)) if left_out else splits[split]).withColumn("test", F.lit(i))
        counted = own if counted is None else counted.unionByName(own)
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    held = [*splits.values(), counted]
    try:
        found = _counted_scores(spark, counted, list(tests), [t[1] for t in tests.values()], settings, models, held)
    finally:
        for kept in held:
            kept.unpersist()
    return spark.createDataFrame(found, "model string, priority int, test string, accuracy double, macro_f1 double, weighted_f1 double, macro_auc double")


def _counted_scores(
    spark, counted: DataFrame, tests: Sequence[str], left_out: Sequence[Sequence[int]], settings: Training, models: Sequence[str], held: list
) -> list[tuple]:
    """One tuple of scores per model and test. What is kept meanwhile goes to ``held``."""
    inputs = len(settings.features)
    sizes = counted.groupBy("test", "label").agg(F.sum("train").alias("train"), F.count(F.lit(1)).alias("different")).collect()  # a row per class and test
    if any(s["label"] < 0 for s in sizes):
        raise ValueError("classes are numbered from 0")
    classes = max([2, *[s["label"] for s in sizes]]) + 1
    made = []
    for i, name in enumerate(tests):
        n = np.zeros(classes)
        for s in sizes:
            if s["test"] == i:
                n[s["label"]] = s["train"]
        if not n.sum():
            raise ValueError(f"{name} has no rows to train on")
        weights = np.divide(n.sum(), np.count_nonzero(n) * n, out=np.zeros(classes), where=n > 0)
        made.append({"weights": weights, "allowed": tuple(f for f in range(inputs) if f not in left_out[i])})
    counted_trees.checkpoint_folder(spark)
    state = counted_trees.blocks(counted, inputs, sum(s["different"] for s in sizes)).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(state)
    common = {"classes": classes, "width": settings.max_bins, "inputs": inputs, "seed": settings.seed}
    forest = None
    if "forest" in models:
        at = list(models).index("forest")
        forest = at, counted_trees.forests(state, made, at, settings.forest_trees, settings.forest_depth, **common)
    depths = {i: boosted_depth(name, settings) for i, name in enumerate(models) if name != "forest"}
    if depths:
        state = counted_trees.boosted(state, made, depths, settings.boost_rounds, settings.boost_step, settings.boost_subsample, **common)
    scored = counted_trees.class_probabilities(state, spark, forest, list(depths), classes).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(scored)
    which = ["model", "test"]
    f1 = class_scores(scored, "actual", "stress_code", group=which, rows="n").select(*which, "accuracy", "macro_f1", "weighted_f1").distinct()
    auc = macro_auc(roc_auc(scored, "actual", {i: f"p{i}" for i in range(3)}, which, rows="n"), which)
    by = {(r["model"], r["test"]): r for r in f1.join(auc, which).collect()}  # a row per model and test
    nothing = {"accuracy": 0.0, "macro_f1": 0.0, "weighted_f1": 0.0, "macro_auc": None}  # a test without rows
    return [
        (name, i, test, *[by.get((i, k), nothing)[c] for c in nothing]) for i, name in enumerate(models) for k, test in enumerate(tests)
    ]
