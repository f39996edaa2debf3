"""Quality rules with host verdicts.

Rule failures are counted by host, the failure rate is shrunk with a beta prior fitted to all hosts, and documents of
hosts with a high shrunk rate are held to the stricter rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
FACTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 10  # symbols per 100 words
    dup_line_percent: int = 30
    strict_repeat_percent: int = 20
    strict_dup_line_percent: int = 10
    host_rate: float = 0.3  # shrunk failure rate from which a host is held to the strict rules


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
    _, at, counts = np.unique(pairs * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[shift : n - 2 + shift] |= twice
    return int(marked.sum())


def facts_of(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode().split()  # bytes.split cuts at the six ASCII space characters only
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated_words(words),
    )


def rule_facts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the counts that the rules look at; a missing text counts as empty."""
    return map_texts(docs, text, keep, FACTS, lambda: lambda texts: list(zip(*map(facts_of, texts), strict=True)))


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))


def rule_failed(limits: Limits) -> Column:
    """The rules that hold on every host."""
    return (
        base_failed(limits)
        | (100 * F.col("n_symbols") > limits.symbol_percent * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > limits.dup_line_percent * F.col("n_lines"))
    )


def strict_failed(limits: Limits) -> Column:
    """The rules for hosts with many failures."""
    return (
        rule_failed(limits)
        | (100 * F.col("n_repeat_words") > limits.strict_repeat_percent * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > limits.strict_dup_line_percent * F.col("n_lines"))
    )


def beta_prior(groups: DataFrame) -> tuple[float, float]:
    """Moment estimate of a beta prior from (n, k) of every group; one row reaches the driver.

    Without variation between groups the prior is as strong as 10,000 rows; without rows it is (0.5, 0.5).
    """
    s = groups.agg(
        F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"), F.count("*").cast("double").alias("g"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
    ).first()
    if not s["n"]:
        return 0.5, 0.5
    mean = min(max(s["k"] / s["n"], 1e-6), 1 - 1e-6)
    spread = (s["kk"] - s["n"] * mean * mean) / (mean * (1 - mean)) - (s["g"] - 1)
    room = s["n"] - s["nn"] / s["n"] - (s["g"] - 1)
    share = min(max(spread / room if room > 0 else 0.0, 1e-4), 0.99)
    strength = 1 / share - 1
    return mean * strength, (1 - mean) * strength


def host_rates(facts: DataFrame, host: str, limits: Limits) -> DataFrame:
    """One row per host: rows, failures and the shrunk failure rate. A missing host is the empty host."""
    hosts = stored(
        facts.groupBy(F.coalesce(F.col(host), F.lit("")).alias("_host")).agg(F.count("*").alias("n"), F.sum(strict_failed(limits).cast("long")).alias("k")), "hosts",
    )
    a, b = beta_prior(hosts)
    return hosts.select("_host", "n", "k", ((F.col("k") + a) / (F.col("n") + (a + b))).alias("rate"))


def judge(docs: DataFrame, keep: list[str], *, host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``keep`` columns of every row with its counts, ``base_failed``, ``strict_host`` and ``kept``.

    Rows stay as they are, repeated ones too. Empty and missing texts have no words and fail. Only hosts over the limit
    are joined back, so Spark broadcasts that table while it is small and splits a large host otherwise.
    """
    hosts = host_rates(rule_facts(docs, [host], text), host, limits)
    strict = stored(hosts.where(F.col("rate") > limits.host_rate).select("_host", F.lit(True).alias("_strict")), "strict_hosts")
    facts = rule_facts(docs.withColumn("_of_host", F.coalesce(F.col(host), F.lit(""))), [*keep, "_of_host"], text)
    joined = facts.join(strict, F.col("_of_host") == F.col("_host"), "left").withColumn("strict_host", F.coalesce("_strict", F.lit(False)))
    failed = F.when(F.col("strict_host"), strict_failed(limits)).otherwise(rule_failed(limits))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return joined.select(*keep, *counts, base_failed(limits).alias("base_failed"), "strict_host", (~failed).alias("kept"))
