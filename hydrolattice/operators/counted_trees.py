"""Forests and one-vs-rest boosted trees over counted rows, many fits in the same Spark jobs.

A tree learner that cuts inputs into bins sees a row only as its bins, its class and its weight. Rows that agree in these
become one counted row, so the work of a tree level depends on the number of different rows and stops growing once all
combinations of bins have come up. The rows a tree draws are drawn by count: a Poisson or binomial number of the equal
rows, as if each had been drawn by itself.

All trees of all fits grow level by level together. In a job, each task sums its blocks of rows into histograms, a shuffle
brings the histograms of a tree together, and only the best split of each node reaches the driver (where all histograms of
a job are a few megabytes, they are added up there). The methods are those of
``pyspark.ml``: Gini forests with pruned leaves, and logistic boosting of regression trees, one series per class.
"""

from __future__ import annotations

import io
import math
import pickle
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.runs import shared_folder
from .ordering import running_totals

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

ROWS_PER_BLOCK = 1_000_000
BYTES_PER_JOB = 64 << 20  # of one task's histograms
BYTES_ON_DRIVER = 32 << 20  # of all tasks' histograms, up to which the driver adds them up instead of a shuffle
CHECKPOINT_ROUNDS = 25
_LEAF = 255  # no bin lies above it


# Bins and counted rows ------------------------------------------------------------------------------------------------


def bin_limits(df: DataFrame, features: Sequence[str], used: Mapping[str, Column], max_bins: int) -> dict[str, dict[str, list[float]]]:
    """For each named subset of the rows, the limits between the bins of each input, from the exact quantiles of the subset.

    An input with at most ``max_bins`` values gets one bin per value, with limits half-way between them. Rows collapse to distinct
    values first; what reaches the driver is at most ``max_bins`` values per subset and input.
    """
    if not 2 <= max_bins <= _LEAF:
        raise ValueError(f"max_bins must be from 2 to {_LEAF}")
    inside = [f"_in{k}" for k in range(len(used))]
    counts = None
    for f in features:  # one input at a time: as a long table every row would carry the name of its column through the hash table
        one = df.filter(~F.isnan(f)).groupBy(F.lit(f).alias("column"), F.col(f).alias("value")).agg(*[F.count_if(c).alias(n) for n, c in zip(inside, used.values())])
        counts = one if counts is None else counts.unionByName(one)
    counts = counts.withColumns({f"{n}_some": (F.col(n) > 0).cast("long") for n in inside}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = {f"{n}_upto": n for n in inside} | {f"{n}_values": f"{n}_some" for n in inside}
        run = running_totals(counts, ["column"], ["value"], sums)
        few, taken = [], []
        for n in inside:
            upto, total = F.col(f"{n}_upto"), F.col(f"{n}_upto_total")
            few.append(F.col(f"{n}_values_total") <= max_bins)
            ends = (upto < total) & (F.floor(F.try_divide(upto * max_bins, total)) > F.floor(F.try_divide((upto - F.col(n)) * max_bins, total)))
            taken.append((F.col(n) > 0) & (few[-1] | ends))
        found = run.select("column", "value", F.array(*few).alias("few"), F.array(*taken).alias("taken")).filter(F.array_contains("taken", True)).collect()
    finally:
        counts.unpersist()
    out: dict[str, dict[str, list[float]]] = {name: {f: [] for f in features} for name in used}
    for k, name in enumerate(used):
        for f in features:
            own = sorted((r["value"], r["few"][k]) for r in found if r["column"] == f and r["taken"][k])
            values = [v for v, _ in own]
            out[name][f] = [_between(*pair) for pair in zip(values, values[1:])] if own and own[0][1] else [math.nextafter(v, math.inf) for v in values]
    return out


def _between(low: float, high: float) -> float:
    middle = low + (high - low) / 2
    return min(middle if low < middle <= high else high, sys.float_info.max)


def counted_rows(df: DataFrame, label: str, flag: str, limits: Mapping[str, Sequence[float]]) -> DataFrame:
    """(bin per input, label, train, held): how many rows with a false and with a true flag agree in bins and label."""
    names = {f: f"_b{i}" for i, f in enumerate(limits)}
    cut = Bucketizer(inputCols=list(names), outputCols=list(names.values()), splitsArray=[[-math.inf, *v, math.inf] if v else [-math.inf, 0.0, math.inf] for v in limits.values()])
    binned = cut.transform(df)
    bins = [(F.col(b) if limits[f] else F.lit(0)).cast("int").alias(b) for f, b in names.items()]
    return binned.select(*bins, F.col(label).cast("int").alias("label"), flag).groupBy(*names.values(), "label").agg(
        F.count_if(~F.col(flag)).alias("train"), F.count_if(F.col(flag)).alias("held")
    )


def without_inputs(counted: DataFrame, places: Sequence[int], inputs: int) -> DataFrame:
    """Counted rows that differ in some inputs only become one, with bin 0 there."""
    bins = [(F.lit(0) if i in places else F.col(f"_b{i}")).alias(f"_b{i}") for i in range(inputs)]
    return counted.select(*bins, "label", "train", "held").groupBy(*[f"_b{i}" for i in range(inputs)], "label").agg(
        F.sum("train").alias("train"), F.sum("held").alias("held")
    )


def blocks(counted: DataFrame, inputs: int, rows: int) -> RDD:
    """(part, {test: block}) per partition of counted rows (test, bins, label, train, held). Rows are hashed and sorted, so that a lost part comes back the same."""
    cores = counted.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, math.ceil(rows / (cores * ROWS_PER_BLOCK)))
    names = [f"_b{i}" for i in range(inputs)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.int64) for b in batches if b.num_rows]
        if not held:
            return
        table = np.concatenate(held, axis=1)
        out = {}
        for test in np.unique(table[0]).tolist():
            own = table[1:, table[0] == test]
            own = own[:, np.lexsort((*own[: inputs + 1], own[inputs + 1] == 0))]  # rows to train on first
            out[test] = {
                "bins": np.ascontiguousarray(own[:inputs].astype(np.uint8)), "label": own[inputs].astype(np.int8), "held": own[inputs + 2],
                "train": own[inputs + 1][own[inputs + 1] > 0],
            }
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps(out, 5)])], names=["part", "block"])

    dealt = counted.select("test", *names, "label", "train", "held").repartition(parts, "test", *names, "label")
    return dealt.mapInArrow(pack, "part long, block binary").rdd.map(lambda r: (r[0], pickle.loads(r[1])))


# Trees ----------------------------------------------------------------------------------------------------------------


@dataclass
class Head:
    """A tree that grows: which rows it learns from and how. ``key`` is (test, model, class or tree)."""

    key: tuple[int, int, int]
    depth: int
    allowed: tuple[int, ...]  # inputs it may split on
    subset: int  # how many of them each node tries
    left: np.ndarray = field(default=None)
    feature: np.ndarray = field(default=None)
    limit: np.ndarray = field(default=None)
    sums: np.ndarray = field(default=None)  # per node: weight, then the summed statistics
    active: np.ndarray = field(default=None)

    def start(self, stats: int) -> None:
        n = 2 ** (self.depth + 1) - 1
        self.left, self.feature = np.arange(n), np.zeros(n, np.int64)
        self.limit, self.sums, self.active = np.full(n, _LEAF, np.uint8), np.zeros((n, 1 + stats)), np.array([0])

    def sent(self, level: int) -> tuple:
        n = 2 ** (level + 1) - 1
        slot = np.full(n, -1, np.int32)
        slot[self.active] = np.arange(self.active.size)
        return self.key, self.left[:n], self.feature[:n], self.limit[:n], slot, self.active.size

    def split(self, found: tuple, level: int) -> None:
        total, good, feature, limit, low, high = found
        self.sums[self.active] = total
        node = self.active[good]
        child = 2 * node + 1
        self.left[node], self.feature[node], self.limit[node] = child, feature[good], limit[good]
        self.sums[child], self.sums[child + 1] = low[good], high[good]
        grown = np.concatenate([child, child + 1]) if level + 1 < self.depth else child[:0]
        # A node of a single class is a leaf; with one statistic that cannot be told from the sums.
        self.active = np.sort(grown[(self.sums[grown, 1:] > 0).sum(axis=1) > 1]) if self.sums.shape[1] > 2 else np.sort(grown)

    def prune(self) -> None:
        """Two leaves that name the same class become one, from the bottom up."""
        best = self.sums[:, 1:].argmax(axis=1)
        for level in reversed(range(self.depth)):
            node = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            node = node[self.left[node] != node]
            low = self.left[node]
            node = node[(self.left[low] == low) & (self.left[low + 1] == low + 1) & (best[low] == best[low + 1])]
            self.left[node], self.feature[node], self.limit[node] = node, 0, _LEAF


def _route(bins: np.ndarray, rows: int, left: np.ndarray, feature: np.ndarray, limit: np.ndarray, steps: int) -> np.ndarray:
    """The node that each of the first ``rows`` rows has come to after ``steps`` steps."""
    if not steps or left[0] == 0:
        return np.zeros(rows, np.int64)
    flat, at, start = bins.ravel(), np.arange(rows), feature * bins.shape[1]
    node = left[0] + (bins[feature[0], :rows] > limit[0])
    for _ in range(steps - 1):
        node = left.take(node) + (flat.take(start.take(node) + at) > limit.take(node))
    return node


def _histogram(bins: np.ndarray, slot: np.ndarray, slots: int, width: int, weights: Sequence[np.ndarray], code: np.ndarray | None, codes: int) -> np.ndarray:
    """Sums by slot, input, bin and statistic: one per weight, or one per code of the first weight."""
    keep = np.flatnonzero((slot >= 0) & (weights[0] > 0))
    if keep.size < slot.size:
        slot, bins, weights, code = slot[keep], bins[:, keep], [w[keep] for w in weights], None if code is None else code[keep]
    base = slot.astype(np.int64) * width
    out = np.empty((slots, bins.shape[0], width, len(weights) if code is None else codes))
    for f, b in enumerate(bins):
        at = base + b
        if code is None:
            for s, w in enumerate(weights):
                out[:, f, :, s] = np.bincount(at, w, slots * width).reshape(slots, width)
        else:
            out[:, f] = np.bincount(at * codes + code, weights[0], slots * width * codes).reshape(slots, width, codes)
    return out


def _best_splits(sums: np.ndarray, tried: np.ndarray) -> tuple:
    """Of each slot: its totals, whether a split gains, its input and last lower bin, and both sides' sums (weight first)."""
    slots, inputs, width, _ = sums.shape
    low = sums.cumsum(axis=2)[:, :, :-1]
    high = sums[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]
    total = sums[:, 0].sum(axis=1)

    def worth(side: np.ndarray) -> np.ndarray:
        return np.divide((side[..., 1:] ** 2).sum(axis=-1), side[..., 0], out=np.zeros(side.shape[:-1]), where=side[..., 0] > 0)

    after, before = worth(low) + worth(high), worth(total)[:, None, None]
    gain = np.where((low[..., 0] > 0) & (high[..., 0] > 0) & tried[:, :, None], after - before, -1.0)
    place = gain.reshape(slots, -1).argmax(axis=1)
    feature, limit, every = place // (width - 1), place % (width - 1), np.arange(slots)
    good = gain[every, feature, limit] > 1e-12 * after[every, feature, limit]
    return total, good, feature, limit, low[every, feature, limit], high[every, feature, limit]


def _packed(sums: np.ndarray):
    flat = sums.ravel()
    filled = np.flatnonzero(flat)
    return (sums.shape, filled.astype(np.uint32), flat[filled]) if filled.size * 12 < flat.size * 8 else (sums.shape, None, flat)


def _grow(state: RDD, heads: Sequence[Head], stats: int, width: int, inputs: int, seed: int, summed, classes: bool) -> None:
    """Grow the trees by all their levels. ``summed(part, block, head, node, slot, slots)`` gives a block's histogram of one tree."""
    for head in heads:
        head.start(stats)
    reducers = state.getNumPartitions()
    for level in range(max(h.depth for h in heads)):
        waiting = [h for h in heads if h.depth > level and h.active.size]
        while waiting:
            size, now = 0, []
            while waiting and (not now or size + waiting[0].active.size * inputs * width * 8 * (1 + stats) <= BYTES_PER_JOB):
                now.append(waiting.pop(0))
                size += now[-1].active.size * inputs * width * 8 * (1 + stats)
            sent = [h.sent(level) for h in now]
            rules = {h.key: (h.allowed, h.subset, h.active) for h in now}

            def partial(items, sent=sent, level=level):
                for part, held in items:
                    for i, (key, left, feature, limit, slot, slots) in enumerate(sent):
                        block = held.get(key[0])
                        if block is not None and block["train"].size:
                            node = _route(block["bins"], block["train"].size, left, feature, limit, level)
                            yield i % reducers, (key, part, _packed(summed(part, block, key, slot.take(node), slots)))

            def best(items, rules=rules, level=level):
                found: dict = {}
                for _, (key, part, packed) in items:
                    found.setdefault(key, []).append((part, packed))
                for key, parts in found.items():
                    sums = np.zeros(math.prod(parts[0][1][0]))
                    for _, (_, filled, values) in sorted(parts, key=lambda p: p[0]):  # in one order, so that sums repeat to the last digit
                        if filled is None:
                            sums += values
                        else:
                            sums[filled] += values
                    sums = sums.reshape(parts[0][1][0])
                    if classes:
                        sums = np.concatenate([sums.sum(axis=-1, keepdims=True), sums], axis=-1)
                    allowed, subset, active = rules[key]
                    tried = np.zeros((active.size, inputs), bool)
                    if subset >= len(allowed):
                        tried[:, list(allowed)] = True
                    else:
                        draws = np.random.default_rng([seed, *key, level]).random((2**level, len(allowed)))[active - (2**level - 1)]
                        tried[np.arange(active.size)[:, None], np.array(allowed)[draws.argsort(axis=1)[:, :subset]]] = True
                    yield key, _best_splits(sums, tried)

            by_key = {h.key: h for h in now}
            sums = state.mapPartitions(partial)
            if size * reducers <= BYTES_ON_DRIVER:  # a second stage would take longer than adding these up
                splits = best(sums.collect())
            else:
                splits = sums.partitionBy(reducers, int).mapPartitions(best).collect()
            for key, found in splits:
                by_key.pop(key).split(found, level)
            for head in by_key.values():
                head.active = head.active[:0]


# Models ---------------------------------------------------------------------------------------------------------------


def forests(
    state: RDD, tests: Sequence[Mapping], model: int, trees: int, depth: int, classes: int, width: int, inputs: int, seed: int, *, bootstrap: bool = True
) -> list[Head]:
    """``trees`` Gini trees per test on bootstrap draws of its rows; a node tries the square root of the inputs, that of a single tree all."""
    weights = [t["weights"] for t in tests]
    heads = [
        Head((i, model, k), depth, t["allowed"], math.ceil(math.sqrt(len(t["allowed"]))) if trees > 1 else len(t["allowed"]))
        for i, t in enumerate(tests) for k in range(trees)
    ]

    def summed(part, block, key, slot, slots):
        rows = block["train"]
        drawn = np.random.default_rng([seed, *key, part]).poisson(rows) if bootstrap else rows
        label = block["label"][: rows.size]
        return _histogram(block["bins"][:, : rows.size], slot, slots, width, [drawn * weights[key[0]].take(label)], label, classes)

    _grow(state, heads, classes, width, inputs, seed, summed, True)
    for head in heads:
        head.prune()
    return heads


def _residual(score: np.ndarray, sign: np.ndarray) -> np.ndarray:
    return 4 * sign / (1 + np.exp(2 * sign * score))


def boosted(
    state: RDD, tests: Sequence[Mapping], models: Mapping[int, int], rounds: int, step: float, subsample: float, classes: int, width: int, inputs: int, seed: int
) -> RDD:
    """Boosted trees of each model (number: depth), test and class. The result's blocks hold ``scores`` of (model, class) for all their rows.

    The first tree fits the signs of the class, each later one the residuals of the logistic loss, at ``step`` of its value.
    A round draws each row with probability ``subsample``.
    """
    weights = [t["weights"] for t in tests]
    place = {(m, c): i * classes + c for i, m in enumerate(models) for c in range(classes)}

    def prepared(trees: list[tuple], number: int, scale: float):
        """Blocks after the trees of a round, with the draws of round ``number``."""
        def run(item):
            part, held = item
            out = {}
            for test, block in held.items():
                rows, n = block["train"], block["label"].size
                scores = block["scores"].copy() if "scores" in block else np.zeros((len(place), n))
                for (at, model, c), left, feature, limit, value, depth in trees:
                    if at == test:
                        scores[place[model, c]] += scale * value.take(_route(block["bins"], n, left, feature, limit, depth))
                rng = np.random.default_rng([seed, test, number, part])
                drawn = rows if subsample >= 1 or not rows.size else rng.binomial(rows, subsample)
                out[test] = {**block, "scores": scores, "drawn": drawn.astype(np.int32) if rows.size and rows.max() < 1 << 31 else drawn}
            return part, out

        return run

    trees: list[tuple] = []
    earlier = None
    for number in range(rounds):
        now = state.map(prepared(trees, number, 1.0 if number <= 1 else step)).persist(StorageLevel.MEMORY_AND_DISK)
        if number and number % CHECKPOINT_ROUNDS == 0:
            now.checkpoint()
        heads = [Head((i, m, c), depth, t["allowed"], inputs) for m, depth in models.items() for i, t in enumerate(tests) for c in range(classes)]

        def summed(part, block, key, slot, slots, first=number == 0):
            n = block["train"].size
            label = block["label"][:n]
            sign = np.where(label == key[2], 1.0, -1.0)
            weight = block["drawn"] * weights[key[0]].take(label)
            target = sign if first else _residual(block["scores"][place[key[1:]], :n], sign)
            return _histogram(block["bins"][:, :n], slot, slots, width, [weight, weight * target], None, 0)

        _grow(now, heads, 1, width, inputs, seed, summed, False)
        if earlier is not None:
            earlier.unpersist()
        trees = []
        for h in heads:
            value = np.divide(h.sums[:, 1], h.sums[:, 0], out=np.zeros(len(h.sums)), where=h.sums[:, 0] > 0)
            trees.append((h.key, h.left, h.feature, h.limit, value, h.depth))
        earlier = state = now
    return state.map(prepared(trees, rounds, 1.0 if rounds <= 1 else step))


def class_probabilities(state: RDD, spark, forest: tuple[int, Sequence[Head]] | None, models: Sequence[int], classes: int) -> DataFrame:
    """(model, test, actual, stress_code, p0.., n): the held rows with the class probabilities of each model, equal rows counted."""
    trees: dict[int, list[tuple]] = {}
    grown, first = (forest[1], forest[0]) if forest else ((), None)
    for h in grown:
        share = h.sums[:, 1:] / np.maximum(h.sums[:, :1], 1e-300)
        trees.setdefault(h.key[0], []).append((h.left, h.feature, h.limit, share, h.depth))

    def scored(item):
        _, held = item
        tables = []
        for test, block in held.items():
            keep = np.flatnonzero(block["held"] > 0)
            found = {}
            if first is not None:
                total = np.zeros((block["label"].size, classes))
                for left, feature, limit, share, depth in trees[test]:
                    total += share.take(_route(block["bins"], len(total), left, feature, limit, depth), axis=0)
                found[first] = total[keep] / len(trees[test])
            for i, m in enumerate(models):
                own = 1 / (1 + np.exp(-2 * block["scores"][i * classes : (i + 1) * classes, keep].T))
                every = own.sum(axis=1, keepdims=True)
                found[m] = np.divide(own, every, out=np.full(own.shape, 1 / classes), where=every > 0)
            for m, p in found.items():
                best = p.argmax(axis=1).astype(np.int32)
                columns = [np.full(keep.size, m, np.int32), np.full(keep.size, test, np.int32), block["label"][keep].astype(np.int32), best, *p.T, block["held"][keep]]
                tables.append(pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names))
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, arrow) as out:
            for t in tables:
                out.write_batch(t)
        return (sink.getvalue(),)

    names = ["model", "test", "actual", "stress_code", *[f"p{i}" for i in range(classes)], "n"]
    arrow = pa.schema([(n, pa.float64() if n[0] == "p" else pa.int64() if n == "n" else pa.int32()) for n in names])

    def opened(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield from pa.ipc.open_stream(raw)

    ddl = ", ".join(f"{n} {'double' if n[0] == 'p' else 'long' if n == 'n' else 'int'}" for n in names)
    return spark.createDataFrame(state.map(scored), "b binary").mapInArrow(opened, ddl)


def checkpoint_folder(spark) -> None:
    """Rounds of boosting are checkpointed to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
