"""Ordered computations that no single task has to hold: running totals, ranks, exact quantiles.

A plain ``Window.partitionBy(group).orderBy(value)`` puts a whole group into one task. Here a large group
is cut into buckets at splitter values first, windows run per (group, bucket), and one small per-bucket
table carries the totals across buckets. Splitters come from a hash sample of the order key, so
recomputing a lost partition cuts at the same places. However many rows there are, at most
``2 * MAX_SPLITTERS`` splitters exist, which is what makes broadcasting them safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 1_000_000
MAX_SPLITTERS = 65_536
GROUP_BUCKETS = 1024
_SAMPLES_PER_BUCKET = 32
_STEP = 32
_HASH_RANGE = 1 << 30


def _bucket_number(key: Column) -> Column:
    """How many splitters are at or below the key: first among every ``_STEP``-th one, then between two of those."""
    coarse = F.size(F.filter("_coarse", lambda s: s <= key))
    return coarse * _STEP + F.size(F.filter(F.slice("_splitters", coarse * _STEP + 1, _STEP), lambda s: s <= key))


def _every(array: str, step: int) -> Column:
    picks = F.sequence(F.lit(step), F.size(array), F.lit(step))
    return F.when(F.size(array) >= step, F.transform(picks, lambda i: F.element_at(array, i))).otherwise(F.slice(array, 1, 0))


def _with_buckets(df: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Add ``_bucket`` from ``_g`` (the group) and ``_key`` (the order key)."""
    sizes = df.groupBy("_g").agg(F.count(F.lit(1)).alias("_rows"))
    everything = sizes.agg(F.sum("_rows").alias("_all")).withColumn("_j", F.lit(1))
    target = F.greatest(F.lit(float(rows_per_bucket)), F.col("_all") / float(MAX_SPLITTERS))
    large = (
        sizes.withColumn("_j", F.lit(1))
        .join(F.broadcast(everything), "_j")  # one row
        .select("_g", "_rows", F.least(F.ceil(F.col("_rows") / target), F.lit(GROUP_BUCKETS).cast("long")).alias("_buckets"))
        .filter(F.col("_buckets") > 1)
    )
    draw = F.pmod(F.xxhash64("_key"), F.lit(_HASH_RANGE)).cast("double") / float(_HASH_RANGE)
    splitters = (
        df.select("_g", "_key")
        .join(F.broadcast(large), "_g")  # groups above the bucket size: MAX_SPLITTERS at most
        .filter(draw < F.lit(float(_SAMPLES_PER_BUCKET)) * F.col("_buckets") / F.col("_rows"))
        .groupBy("_g")
        .agg(F.sort_array(F.collect_set("_key")).alias("_sample"))
        .select("_g", _every("_sample", _SAMPLES_PER_BUCKET).alias("_splitters"))
        .select("_g", "_splitters", _every("_splitters", _STEP).alias("_coarse"))
    )
    cut = df.join(F.broadcast(splitters), "_g", "left")  # 2 * MAX_SPLITTERS values at most
    number = F.when(F.col("_splitters").isNull(), 0).otherwise(_bucket_number(F.col("_key")))
    return cut.withColumn("_bucket", number).drop("_splitters", "_coarse")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    *,
    following: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add, for each ``name: column`` of ``sums``, ``name`` (inclusive running sum) and ``name_total``.

    ``order`` must be unique within a group. ``following`` names an extra column holding the next
    row's first order value (missing on the last row).
    """
    # A struct key compares missing group values as equal, so a plain equi-join loses no group.
    keyed = df.withColumns({
        "_g": F.struct(*group) if group else F.struct(F.lit(0)),
        "_key": F.col(order[0]) if len(order) == 1 else F.struct(*order),
    })
    cut = _with_buckets(keyed, rows_per_bucket)

    parts = cut.groupBy("_g", "_bucket").agg(F.min("_key").alias("_first"), *[F.sum(c).alias(f"_in_{n}") for n, c in sums.items()])
    whole = Window.partitionBy("_g")
    across = whole.orderBy("_bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        "_g",
        "_bucket",
        F.lead("_first").over(across).alias("_next_first"),
        *[F.coalesce(F.sum(f"_in_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_in_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    inside = Window.partitionBy("_g", "_bucket").orderBy("_key")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        "*",
        *[F.sum(c).over(upto).alias(f"_run_{n}") for n, c in sums.items()],
        *([F.lead("_key").over(inside).alias("_next_key")] if following else []),
    )
    extra = []
    for n in sums:
        extra += [(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(n), F.col(f"{n}_total")]
    if following:
        after = F.coalesce("_next_key", "_next_first")
        extra.append((after if len(order) == 1 else after[order[0]]).alias(following))
    return local.join(carry, ["_g", "_bucket"]).select(*df.columns, *extra)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str = "rank", total: str = "rows", **options) -> DataFrame:
    """Row number from 1 within each group, and the group's row count."""
    out = running_totals(df.withColumn("_one", F.lit(1).cast("long")), group, order, {"_rank": "_one"}, **options)
    return out.withColumnsRenamed({"_rank": rank, "_rank_total": total}).drop("_one")


def value_counts(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form (group, column, value, n): one row per distinct non-missing value."""
    long = df.select(*group, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(group), list(columns), "column", "value"
    )
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*group, "column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def quantiles_of_counts(counts: DataFrame, group: Sequence[str], probabilities: Mapping[str, float], **options) -> DataFrame:
    """Linear-interpolated quantiles of (group, value, n) rows: one output column per named probability."""
    run = running_totals(counts, group, ["value"], {"upto": "n"}, following="after", **options)
    outputs = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("upto_total") - 1)
        low = F.floor(position)
        holds = (F.col("upto") > low) & (F.col("upto") - F.col("n") <= low)
        upper = F.when(low + 1 < F.col("upto"), F.col("value")).otherwise(F.coalesce("after", "value"))
        at = F.col("value") + (upper - F.col("value")) * (position - low)
        outputs.append(F.max(F.when(holds, at)).alias(name))
    return run.groupBy(*group).agg(*outputs)


def exact_quantiles(df: DataFrame, group: Sequence[str], columns: Sequence[str], probabilities: Mapping[str, float], **options) -> DataFrame:
    """Exact quantiles of each column per group, over distinct values and their counts."""
    return quantiles_of_counts(value_counts(df, group, columns), [*group, "column"], probabilities, **options)


def hash_share(key: Sequence[str], seed: int) -> Column:
    """Deterministic 32-bit draw per key."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 32))


def smallest_draws(df: DataFrame, key: Sequence[str], wanted: Column | int, draw: Column, *, bins: int = 1 << 16) -> DataFrame:
    """Flag ``chosen`` the ``wanted`` rows with the lowest (draw, key); ``key`` must be unique.

    ``wanted`` is a number or an expression over ``_total`` (the row count). A histogram of draws finds the
    one bin the cut falls in, so only that bin's rows are ever ranked.
    """
    width = (1 << 32) // bins
    drawn = df.withColumn("_draw", draw.cast("long")).withColumn("_bin", F.floor(F.col("_draw") / F.lit(width)).cast("int"))
    histogram = drawn.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``bins`` rows reach this single-partition window.
    along = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = histogram.select(
        "_bin",
        F.col("_n"),
        F.sum("_n").over(along).alias("_upto"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    target = wanted if isinstance(wanted, Column) else F.lit(wanted)
    room = placed.select("_bin", (target - (F.col("_upto") - F.col("_n"))).alias("_room"), "_n")
    marked = drawn.join(F.broadcast(room), "_bin")  # ``bins`` rows at most
    partly = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
    clear = marked.filter(~partly).withColumn("chosen", F.col("_room") > 0)
    inside = Window.partitionBy("_bin").orderBy("_draw", *key)
    cut = marked.filter(partly).withColumn("chosen", F.row_number().over(inside) <= F.col("_room"))
    return clear.unionByName(cut).drop("_draw", "_bin", "_room", "_n")
