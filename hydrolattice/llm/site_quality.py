"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log likelihood ratio of its binned facts. Hosts and paths get posteriors of their share
of good documents: a path is shrunk towards its host and a host towards all, each with a beta prior fitted to all groups
of its level. Evidence and site posterior together give the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import beta_prior, rule_facts
from .shared import stored

#: Upper bounds of the bins of each fact.
BINS = {
    "words": (10, 30, 60, 120, 300, 1000, 5000),
    "repeats": (0.0, 0.02, 0.05, 0.1, 0.2, 0.5),
    "symbols": (0.0, 0.005, 0.02, 0.05, 0.1, 0.5, 1.0),
    "same_lines": (0.0, 0.02, 0.05, 0.1, 0.3),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
}


@dataclass(frozen=True)
class Priors:
    smoothing: float = 1.0
    strongest: float = 4.0  # bound on one fact's log likelihood ratio
    least_strength: float = 2.0  # pseudo rows of the priors, at least


def bins() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = {
        "words": F.col("n_words").cast("double"), "repeats": F.col("n_repeat_words") / words, "symbols": F.col("n_symbols") / words,
        "same_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "word_length": F.col("word_chars") / words,
    }
    return {name: sum(((values[name] > b).cast("int") for b in bounds), F.lit(0)) for name, bounds in BINS.items()}


def fact_ratios(labelled: DataFrame, priors: Priors) -> tuple[dict[str, list[float]], float]:
    """Log likelihood ratio of each bin of each fact, and the smoothed share of good rows. One small row per bin reaches the driver."""
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).alias("bin")) for n in BINS]))
    rows = labelled.select("_good", stack.alias("_s")).groupBy("_s.fact", "_s.bin").agg(F.sum("_good").alias("good"), F.count("*").alias("n")).collect()
    seen = {(r["fact"], r["bin"]): (float(r["good"]), float(r["n"] - r["good"])) for r in rows}
    some = next(iter(BINS))
    good, bad = (sum(v[i] for (f, _), v in seen.items() if f == some) for i in (0, 1))
    out = {}
    for name, bounds in BINS.items():
        size, s, ratios = len(bounds) + 1, priors.smoothing, []
        for b in range(size):
            g, m = seen.get((name, b), (0.0, 0.0))
            ratio = math.log((g + s) / (good + s * size)) - math.log((m + s) / (bad + s * size))
            ratios.append(max(-priors.strongest, min(priors.strongest, ratio)))
        out[name] = ratios
    return out, (good + 1) / (good + bad + 2)


def logit(p: Column) -> Column:
    kept = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(kept / (1 - kept))


def _level(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum("_p").alias("k"))


def classify(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality",
    usable: Column | None = None, priors: Priors = Priors(),
) -> DataFrame:
    """One row per row of ``docs``: key, host, path, evidence, host_rate, path_rate, score, kept (score at least 0.5).

    Facts learn from labelled rows where ``usable`` holds; of repeated labels the largest counts. A site's rows count by
    their label where one is usable, else by the share of good that their evidence gives. A missing host or path is an
    empty one; a missing text is empty; a missing key has no label. Without labels all evidence is 0 and every score 0.5.
    Groups are summed inside each task first, and their tables are written before they are joined back, so Spark
    broadcasts small ones and splits the rows of a large site otherwise.
    """
    sited = docs.withColumns({"_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "_path": F.coalesce(F.col(path).cast("string"), F.lit(""))})
    facts = stored(rule_facts(sited, [key, "_host", "_path"], text).withColumns(bins()).select(key, "_host", "_path", *BINS), "facts")
    wanted = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if usable is None else usable))
    wanted = wanted.groupBy(F.col(key).alias("_label_key")).agg(F.max(label).cast("long").alias("_good"))
    rows = facts.join(wanted, F.col(key) == F.col("_label_key"), "left").drop("_label_key")
    ratios, share = fact_ratios(rows.where("_good is not null"), priors)
    parts = [F.get(F.array(*[F.lit(v) for v in ratios[n]]), F.col(n)) for n in BINS]
    evidence = sum(parts[1:], parts[0])
    own = 1 / (1 + F.exp(-(evidence + math.log(share / (1 - share)))))
    rows = stored(rows.withColumn("evidence", evidence).withColumn("_p", F.coalesce(F.col("_good").cast("double"), own)).select(key, "_host", "_path", "evidence", "_p"), "evidence")

    hosts = stored(_level(rows, ["_host"]), "host_sums")
    a, b = beta_prior(hosts)
    extra = max(1.0, priors.least_strength / (a + b))
    hosts = stored(hosts.select("_host", ((F.col("k") + a * extra) / (F.col("n") + (a + b) * extra)).alias("host_rate")), "host_rates")
    paths = stored(_level(rows, ["_host", "_path"]), "path_sums")
    c, d = beta_prior(paths)
    strength = max(priors.least_strength, c + d)
    shrunk = (F.col("k") + F.col("host_rate") * strength) / (F.col("n") + strength)
    paths = stored(paths.join(hosts, "_host").select("_host", "_path", "host_rate", shrunk.alias("path_rate")), "path_rates")
    score = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("path_rate")))))
    if math.isclose(share, 0.5) and not any(any(v) for v in ratios.values()):
        score = F.lit(0.5)
    joined = rows.join(paths, ["_host", "_path"])
    return joined.select(key, F.col("_host").alias("host"), F.col("_path").alias("path"), "evidence", "host_rate", "path_rate", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)
