"""Benchmark decontamination by SimHash windows, a multi-index over their fingerprints, and exact weighted shingle similarity.

A window as long as a benchmark item, or the whole of a shorter text, matches where its weighted Jaccard similarity reaches
the threshold. Windows that hold one of an item's rarest shingles, as every match must, get a SimHash of their weighted
shingles. The items of their size lie in an index of fingerprint blocks: two fingerprints within the radius agree on some block
up to a few bits, so the index gives all items within it, and those are compared exactly. At the threshold two fingerprints
differ in 10 bits on average; the radius leaves out one match in some ten thousands. Where the index finds no match
for an item whose shingle was met, an upper bound from running sums of shingle weights picks the windows that could still
match, so that nothing is lost. Shingle weights come from all items, however many blocks of items there are.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, process_wide, put_back, set_apart, stored
from .shingles import BulkHashes, mixed, positions, shingle_sets

ITEMS_PER_BLOCK = 50_000
MAX_SHARED = 2_000_000  # shingles of more than one item: a table of numbers beside each block of items; more is an error
SLACK = 1e-9  # for sums of weights in another order


@dataclass(frozen=True)
class Matching:
    """``radius`` 22 over 11 blocks: of two fingerprints that differ in at most 22 bits, one block differs in at most two bits. At
    weighted similarity 0.8 a bit differs with probability 0.15, so more than 22 of 64 do in about 1 of 20,000 pairs."""

    words: int = 5
    similarity: float = 0.8
    radius: int = 22
    blocks: int = 11


def shingle_bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    bits = np.unpackbits(mixed(shingles).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def window_prints(shingles: np.ndarray, weights: np.ndarray, wide: int) -> np.ndarray:
    """SimHash of each run of ``wide`` shingles. A vote weighs the root of its shingle's weight, so that the angle between two
    vote vectors follows from the weighted overlap."""
    votes = shingle_bits(shingles) * np.sqrt(weights).astype(np.float32)[:, None]
    sums = np.zeros((len(shingles) + 1, 64))
    np.cumsum(votes, axis=0, dtype=np.float64, out=sums[1:])
    return np.packbits(sums[wide:] - sums[:-wide] > 1e-9, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


class HammingIndex:
    """Fingerprints by the value of each block; values of a block that differ in up to ``radius // blocks`` bits are looked up too."""

    def __init__(self, prints: np.ndarray, matching: Matching):
        self.prints, self.radius = prints, matching.radius
        edges = np.linspace(0, 64, matching.blocks + 1).astype(int)
        self.parts = [(int(a), int(b - a)) for a, b in zip(edges, edges[1:], strict=False)]
        self.near = matching.radius // matching.blocks
        self.tables: list[dict[int, np.ndarray]] = []
        for start, width in self.parts:
            table = defaultdict(list)
            for i, value in enumerate(self._block(prints, start, width).tolist()):
                for change in range(self.near + 1):
                    for bits in combinations(range(width), change):
                        table[value ^ sum(1 << b for b in bits)].append(i)
            self.tables.append({v: np.array(ids) for v, ids in table.items()})

    @staticmethod
    def _block(prints: np.ndarray, start: int, width: int) -> np.ndarray:
        return (prints >> np.uint64(start)) & np.uint64((1 << width) - 1)

    def within(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(position, item) of every fingerprint of the index within the radius."""
        blocks = [self._block(prints, *part).tolist() for part in self.parts]
        found = []
        for at, own in enumerate(prints):
            met = [ids for table, values in zip(self.tables, blocks, strict=True) if (ids := table.get(values[at])) is not None]
            if met:
                ids = np.unique(np.concatenate(met))
                found += [(at, int(i)) for i in ids[np.bitwise_count(self.prints[ids] ^ own) <= self.radius]]
        return found


@dataclass(frozen=True)
class Spread:
    """How many of all items hold each shingle: their number, and those shingles that more than one of them holds."""

    items: int
    shared: dict[int, int]


def spread_of(bags: list[Counter]) -> Spread:
    counts = Counter(s for bag in bags for s in bag)
    return Spread(len(bags), {s: n for s, n in counts.items() if n > 1})


class Benchmark:
    """Items with their shingles, weights, rarest shingles and fingerprints. ``spread`` is that of all items where these are some."""

    def __init__(self, items: list[tuple[int, str]], matching: Matching, spread: Spread | None = None):
        self.matching, self.hashes = matching, BulkHashes()
        self.ids, self.sizes, self.bags = [], [], []
        every, places = self.hashes([t for _, t in items])
        for (item, _), start, end in zip(items, places, places[1:], strict=False):
            hashes = every[start:end]
            if len(hashes):
                self.ids.append(item)
                self.sizes.append(len(hashes))
                self.bags.append(Counter(positions(hashes, matching.words).tolist()))
        spread = spread or spread_of(self.bags)
        self.top = math.log1p(max(1, spread.items))
        self.weight = {s: self.top for bag in self.bags for s in bag} | {s: math.log1p(spread.items / n) for s, n in spread.shared.items()}
        self.totals = [sum(self.weight[s] * c for s, c in bag.items()) for bag in self.bags]
        self.owners = defaultdict(list)
        for i, bag in enumerate(self.bags):
            for s in self.rarest(bag, self.totals[i]):
                self.owners[s].append(i)
        self.short = sorted({s for s in self.sizes if s < matching.words})
        self.known = np.array(sorted(self.weight), np.uint64)
        self.weights = np.array([self.weight[s] for s in self.known.tolist()])
        self.rare = np.array(sorted(self.owners), np.uint64)
        self.of_size: dict[int, tuple[np.ndarray, HammingIndex]] = {}
        for size in sorted(set(self.sizes)):
            some = np.array([i for i, n in enumerate(self.sizes) if n == size])
            self.of_size[size] = some, HammingIndex(np.array([self.fingerprint(self.bags[i]) for i in some], np.uint64), matching)
        self.flags = np.zeros(1 << 22, bool)
        self.flags[(self.rare & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def rarest(self, bag: Counter, total: float) -> Iterator[int]:
        """The item's heaviest shingles, until the others weigh less than ``similarity`` of it. A window with none of them
        shares less than that, so it cannot match."""
        rest = total
        for s in sorted(bag, key=lambda s: (-self.weight[s], s)):
            if rest < (self.matching.similarity - SLACK) * total:
                return
            yield s
            rest -= self.weight[s] * bag[s]

    def fingerprint(self, bag: Counter) -> int:
        shingles = np.fromiter(sorted(bag.elements()), np.uint64)
        return int(window_prints(shingles, self.weights_of(shingles), len(shingles))[0])

    def similarity(self, bag: Counter, item: int) -> float:
        """Weighted Jaccard similarity; shingles that fewer items hold weigh more."""
        other = self.bags[item]
        both = every = 0.0
        for s in bag.keys() | other.keys():
            w = self.weight.get(s, self.top)
            both += w * min(bag[s], other[s])
            every += w * max(bag[s], other[s])
        return both / every

    def matches(self, texts: list[str]) -> list[list[tuple[int, float, int]]]:
        """(item, similarity, first word) of the best window of each item found in each text."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in texts]
        every, places = self.hashes(texts)
        if not len(every) or not len(self.known):
            return out
        spans: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for n in [*self.short, self.matching.words]:
            if n > len(every):
                continue
            at = positions(every, n)  # those that cross into the next text are left out below
            some = np.flatnonzero(self.flags[(at & np.uint64((1 << 22) - 1)).astype(np.int64)])
            some = some[np.isin(at[some], self.rare)]
            owner = np.searchsorted(places, some, side="right") - 1
            for p, k in zip(some.tolist(), owner.tolist(), strict=True):
                start, end = int(places[k]), int(places[k + 1])
                if p + n <= end:
                    for item in self.owners[int(at[p])]:
                        size = self.sizes[item]
                        low, high = max(start, p + n - size), max(start, min(p, end - size))  # a shorter text is one window
                        spans[k][item].add((low - start, high - start))
        for k, items in spans.items():
            hashes = every[places[k] : places[k + 1]]
            found = self.indexed(hashes, items)
            rest = {i: s for i, s in items.items() if i not in found}
            out[k] = sorted([(self.ids[i], *best) for i, best in found.items()] + self.confirmed(hashes, rest))
        return out

    def indexed(self, hashes: np.ndarray, items: dict[int, set[tuple[int, int]]]) -> dict[int, tuple[float, int]]:
        """The best window of each item that the index gives for the windows of the spans, where it is similar enough."""
        found: dict[int, tuple[float, int]] = {}
        spans: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for item, places in items.items():
            spans[self.sizes[item]] |= places
        for size, places in sorted(spans.items()):
            some, index = self.of_size[size]
            wide = max(1, min(size, len(hashes)) - self.matching.words + 1)
            for low, high in merged(places):
                at = positions(hashes[low : high + size], min(size, self.matching.words))
                for a, k in index.within(window_prints(at, self.weights_of(at), wide)):
                    item = int(some[k])
                    likeness = self.similarity(Counter(at[a : a + wide].tolist()), item)
                    if likeness >= self.matching.similarity - SLACK and likeness > found.get(item, (0.0, 0))[0]:
                        found[item] = likeness, low + a
        return found

    def weights_of(self, at: np.ndarray) -> np.ndarray:
        """Weight of each shingle; those of no item weigh most."""
        place = np.minimum(np.searchsorted(self.known, at), len(self.known) - 1)
        return np.where(self.known[place] == at, self.weights[place], self.top)

    def confirmed(self, hashes: np.ndarray, items: dict[int, set[tuple[int, int]]]) -> list[tuple[int, float, int]]:
        """The best window of each item among those that start inside its spans, where it is similar enough."""
        least, found = self.matching.similarity - SLACK, []
        for item, spans in sorted(items.items()):
            size, bag, best, first = self.sizes[item], self.bags[item], 0.0, 0
            own = np.fromiter(bag, np.uint64, len(bag))
            for low, high in merged(spans):
                at = positions(hashes[low : high + size], min(size, self.matching.words))
                weight = self.weights_of(at)
                shared = np.where(np.isin(at, own), weight, 0.0)
                wide = max(1, min(size, len(hashes)) - self.matching.words + 1)
                window, most = (np.concatenate([[0.0], np.cumsum(w)]) for w in (weight, shared))
                window, most = window[wide:] - window[:-wide], most[wide:] - most[:-wide]
                for a in np.flatnonzero(most * (1 + least) >= least * (window + self.totals[item]) - SLACK * (window + self.totals[item])).tolist():
                    likeness = self.similarity(Counter(at[a : a + wide].tolist()), item)
                    if likeness >= least and likeness > best:
                        best, first = likeness, low + a
            if best:
                found.append((self.ids[item], best, first))
        return found


def merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, item: str, text: str, matching: Matching) -> Iterator[tuple[list[tuple[int, str]], Spread]]:
    """The benchmark in blocks of about ITEMS_PER_BLOCK items, each small enough to go to every task, with the spread of shingles
    over all items. A missing text is empty and matches nothing."""
    rows = benchmark.select(F.col(item).cast("bigint").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()

    def build():
        hashes = BulkHashes()
        return lambda texts: [[s.astype(np.int64, casting="unsafe").tolist() if len(s) else [] for s in shingle_sets(texts, matching.words, hashes)]]

    held = stored(map_texts(rows, "t", ["i", "t"], "shingles array<bigint>", build), "benchmark")
    with_words = held.where(F.size("shingles") > 0)
    counts = with_words.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    shared = {r["s"] % (1 << 64): r["n"] for r in counts.limit(MAX_SHARED + 1).collect()}
    if len(shared) > MAX_SHARED:
        raise ValueError(f"more than {MAX_SHARED} shingles lie in several benchmark items: take out repeated items first")
    spread = Spread(with_words.count(), shared)
    blocks = max(1, -(-held.count() // ITEMS_PER_BLOCK))
    for k in range(blocks):
        yield [(r["i"], r["t"]) for r in held.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).select("i", "t").orderBy("i", "t").collect()], spread


def _finder(items: list[tuple[int, str]], matching: Matching, spread: Spread):
    name = f"benchmark {matching} {spread.items} {hash(tuple(items))}"
    return lambda: process_wide(name, lambda: Benchmark(items, matching, spread))


def leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], *, text: str = "text", item: str = "item_id", item_text: str = "text", matching: Matching = Matching()) -> DataFrame:
    """One row per row of ``docs`` and item found in it: ``keep`` columns, item_id, similarity and start_word of the best window.

    Rows without a match give none. Repeated items with one id count as that id once per text.
    """
    out = None
    for items, spread in item_blocks(benchmark, item, item_text, matching):
        build = _finder(items, matching, spread)

        def compute_all(build=build):
            finder = build()

            def compute(texts: list[str]):
                found = finder.matches(texts)
                return [[m[0] for m in f] for f in found], [[m[1] for m in f] for f in found], [[m[2] for m in f] for f in found]

            return compute

        rows = map_texts(docs, text, keep, "items array<bigint>, likeness array<double>, starts array<bigint>", compute_all).where(F.size("items") > 0)
        part = rows.select(*keep, F.explode(F.arrays_zip("items", "likeness", "starts")).alias("_m")).select(
            *keep, F.col("_m.items").alias("item_id"), F.col("_m.likeness").alias("similarity"), F.col("_m.starts").alias("start_word"),
        )
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", matching: Matching = Matching()) -> DataFrame:
    """The rows of ``docs``, all columns kept whatever their names, in which no item is found."""
    columns, docs = docs.columns, set_apart(docs, [text])
    names = docs.columns
    for items, spread in item_blocks(benchmark, item, item_text, matching):
        build = _finder(items, matching, spread)

        def compute_all(build=build):
            finder = build()
            return lambda texts: [[bool(m) for m in finder.matches(texts)]]

        docs = map_texts(docs, text, names, "_leaked boolean", compute_all).where(~F.col("_leaked")).select(*names)
    return put_back(docs, columns)
