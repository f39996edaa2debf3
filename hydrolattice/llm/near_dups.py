"""Near-duplicate groups by one-permutation MinHash, banded buckets, star-shaped candidates and exact confirmation.

Rows with equal shingle sets form one class. Each class has one signature: one permutation cut into bins, empty bins
filled by optimal densification. Classes that share a band meet in a bucket, and each bucket gives a star: its members
against its smallest class. Stars are confirmed on full sets. A bucket whose members then lie in different groups may
still hide a link between two of its members, so these buckets are completed exactly: their classes are cut into blocks
of bounded size, and each pair of blocks is compared in one task that returns a spanning forest of the links it finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import map_texts, marked, put_back, set_apart, slices, stored
from .shingles import MULTIPLIER, BulkHashes, common, mixed, shingle_sets

STAR_PARTS = 32
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20


@dataclass(frozen=True)
class Linking:
    """Documents are linked where 100 * intersection >= percent * union. At 80 percent, 48 bands of 5 bins miss a pair with
    probability 5e-9; above, less."""

    percent: int = 80
    words: int = 5
    bins: int = 240
    band: int = 5

    def linked(self, a, b, both):
        return 100 * both >= self.percent * (a + b - both)


class Sketcher:
    """One-permutation signatures with optimal densification (Shrivastava 2017), as band hashes."""

    def __init__(self, linking: Linking):
        self.bins, self.band = linking.bins, linking.band
        self.salt = mixed(np.arange(1, self.bins // self.band + 1, dtype=np.uint64) * MULTIPLIER)

    def probe(self, empty: np.ndarray, attempt: int) -> np.ndarray:
        """The bin that each empty bin looks at in this attempt, alike for every document."""
        with np.errstate(over="ignore"):
            return (mixed(empty.astype(np.uint64) * MULTIPLIER + np.uint64(attempt)) % np.uint64(self.bins)).astype(np.int64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Smallest hash of each bin; an empty bin takes that of the first filled bin on its own probe sequence."""
        filled, first = np.unique((shingles % np.uint64(self.bins)).astype(np.int64), return_index=True)
        values, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        values[filled], full[filled] = shingles[first], True
        out, empty, attempt = values.copy(), np.flatnonzero(~full), 0
        while len(empty):
            seen = self.probe(empty, attempt)
            hit = full[seen]
            out[empty[hit]] = values[seen[hit]]
            empty, attempt = empty[~hit], attempt + 1
        return out

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        parts = self.signature(shingles).reshape(-1, self.band)
        total = self.salt.copy()
        with np.errstate(over="ignore"):
            for i in range(self.band):
                total = mixed(total * MULTIPLIER + parts[:, i])
        return total.view(np.int64)


def sketches(docs: DataFrame, keep: list[str], text: str, linking: Linking) -> DataFrame:
    """``keep`` columns with n_shingles, class (digest of the set; missing for an empty one) and bands."""
    def build():
        hashes, sketcher = BulkHashes(), Sketcher(linking)

        def compute(texts: list[str]):
            sets = shingle_sets(texts, linking.words, hashes)
            classes = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            return [len(s) for s in sets], classes, [sketcher.bands(s) if len(s) else [] for s in sets]

        return compute

    return map_texts(docs, text, keep, "n_shingles bigint, class string, bands array<bigint>", build)


def confirm_stars(pairs: DataFrame, texts: DataFrame, linking: Linking) -> DataFrame:
    """The (a, b) whose texts are linked. Members stream past their star's centre, whose set is all that a task holds; the
    members of a star are dealt over up to STAR_PARTS tasks."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(STAR_PARTS)))
    side = texts.select(F.col("node").alias("_c"), "body")
    members = dealt.join(side, F.col("b") == F.col("_c")).select("a", "part", F.lit(1).alias("kind"), "b", "body")
    centres = dealt.select("a", "part").distinct().join(side, F.col("a") == F.col("_c")).select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = BulkHashes()
        centre, held = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for piece in slices(batch, batch.schema.get_field_index("body")):
                sets = shingle_sets(piece.column("body").to_pylist(), linking.words, hashes)
                for a, kind, b, shingles in zip(*(piece.column(c).to_pylist() for c in ("a", "kind", "b")), sets, strict=True):
                    if kind == 0:
                        centre, held = a, shingles
                    elif centre == a and linking.linked(len(held), len(shingles), common(held, shingles)):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    rows = members.unionAll(centres).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return rows.mapInArrow(run, "a bigint, b bigint")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one list with every set of the other: frequent shingles through a matrix
    product a few columns at a time, the others one by one."""
    out = np.zeros((len(left), len(right)), np.float64)
    flat = [np.concatenate([np.empty(0, np.uint64), *side]) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    shared = np.intersect1d(*flat)
    if not len(shared):
        return out
    lists = []
    for values, owner in zip(flat, rows, strict=True):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        order = np.argsort(at[hit], kind="stable")
        lists.append((owner[hit][order], np.searchsorted(at[hit][order], np.arange(len(shared) + 1))))
    (a, a_at), (b, b_at) = lists
    weight = np.diff(a_at) * np.diff(b_at)
    for k in np.flatnonzero(weight <= 2048):
        out[np.ix_(a[a_at[k] : a_at[k + 1]], b[b_at[k] : b_at[k + 1]])] += 1
    heavy = np.flatnonzero(weight > 2048)
    for start in range(0, len(heavy), 512):
        some = heavy[start : start + 512]
        x, y = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        for c, k in enumerate(some):
            x[a[a_at[k] : a_at[k + 1]], c] = 1
            y[b[b_at[k] : b_at[k + 1]], c] = 1
        out += x @ y.T
    return out


def forest(pairs: Iterator[tuple[int, int]], groups: list) -> list[tuple[int, int]]:
    """The pairs that join two groups that were apart so far."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i, j in pairs:
        a, b = root(groups[i]), root(groups[j])
        if a != b:
            parent[a] = b
            kept.append((i, j))
    return kept


def complete(buckets: DataFrame, groups: DataFrame, texts: DataFrame, linking: Linking) -> DataFrame:
    """Links between members of one bucket that lie in different groups, as a forest per pair of blocks.

    ``buckets`` has (bucket, node), ``groups`` (node, component); a node without a group is its own.
    """
    members = stored(buckets.join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "bucket_members")
    ends = members.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.min("node").alias("a"))
    inside = members.join(stored(ends.where("c <> d").select("bucket", "a"), "open_buckets"), "bucket")
    clusters = components(inside.select("a", F.col("node").alias("b"))).withColumnRenamed("component", "cluster")
    rows = clusters.join(groups, "node", "left").join(texts, "node").select("node", "cluster", F.coalesce("component", "node").alias("component"), "n_shingles", "body")
    rows = stored(rows, "cluster_rows")
    sizes = stored(
        rows.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "cluster_sizes",
    )
    blocked = rows.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "body",
    )

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block = np.array(table.column("block").to_pylist())
        names, groups_of = table.column("node").to_pylist(), table.column("component").to_pylist()
        sets = shingle_sets(table.column("body").to_pylist(), linking.words, BulkHashes())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        both = intersections([sets[k] for k in left], [sets[k] for k in right])
        sizes_of = np.array([len(s) for s in sets], np.float64)
        hits = np.argwhere(linking.linked(sizes_of[left][:, None], sizes_of[right][None, :], both))
        kept = forest(((left[x], right[y]) for x, y in hits), groups_of)
        return pa.table({"a": pa.array([names[x] for x, _ in kept], pa.int64()), "b": pa.array([names[y] for _, y in kept], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", linking: Linking = Linking()) -> DataFrame:
    """One row per document: the key, ``text_hash`` (xxhash64 of its text), n_shingles, component_id and kept.

    ``component_id`` is the smallest key that a document reaches over links, itself included, and ``kept`` holds where it
    is the document's own. Texts without words are linked with nothing. Rows that share a key count as linked. A row
    without a key is linked with nothing, has no component and is kept. Repeated rows stay.
    """
    source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    rows = stored(sketches(source, ["_key", "_hash"], "_text", linking), "sketches")
    keyed = rows.where("_key is not null and class is not null")
    first = keyed.groupBy("class").agg(F.min(F.struct("_key", "_hash")).alias("_r"))
    classes = stored(first.select("class", "_r._key", "_r._hash", F.monotonically_increasing_id().alias("node")), "classes")  # numbered once, then read
    one = keyed.select("_key", "_hash", "n_shingles", "bands").join(classes.select("_key", "_hash", "node"), ["_key", "_hash"])
    one = stored(one.dropDuplicates(["node"]).select("node", "n_shingles", "bands"), "signatures")
    banded = one.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("bucket", "a")
    stars = stored(banded.join(stored(shared, "buckets"), "bucket").select("bucket", "node", "a"), "stars")
    members = stored(stars.select("node").distinct(), "members")
    wanted = stored(classes.join(members, "node", "left_semi").join(one.select("node", "n_shingles"), "node").select("_key", "_hash", "node", "n_shingles"), "wanted")
    likely = marked(source, F.col("_hash"), wanted, F.col("_hash")).where("_maybe")
    texts = stored(likely.join(wanted, ["_key", "_hash"]).dropDuplicates(["node"]).select("node", "n_shingles", F.col("_text").alias("body")), "texts")
    pairs = stored(stars.where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    confirmed = stored(confirm_stars(pairs, texts, linking), "links")
    rest = stored(complete(stars.select("bucket", "node"), stored(components(confirmed), "groups"), texts, linking), "more_links")
    again = stored(keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "repeated_keys")
    same = stored(keyed.select("_key", "class").join(again, "_key").join(classes.select("class", "node"), "class").select("_key", "node").distinct(), "repeated_classes")
    same_key = same.join(same.groupBy("_key").agg(F.min("node").alias("a")), "_key").select("a", F.col("node").alias("b"))
    final = components(confirmed.unionAll(rest).unionAll(same_key))
    rooted = stored(classes.join(final, "node", "left").select("class", "_key", "component"), "rooted")
    smallest = stored(rooted.where("component is not null").groupBy("component").agg(F.min("_key").alias("component_id")), "smallest")
    of_class = stored(rooted.join(smallest, "component", "left").select("class", F.coalesce("component_id", "_key").alias("component_id")), "class_components")
    numbered = rows.select("_key", "_hash", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("_key").isNotNull(), F.coalesce("component_id", "_key"))
    return numbered.select(
        F.col("_key").alias(key), F.col("_hash").alias("text_hash"), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", linking: Linking = Linking()) -> DataFrame:
    """The rows of one document of each group, all columns kept; of rows repeated whole, one stays.

    Rows without a key stay. Of different texts under one kept key, the one with the smallest hash stays. Other columns may have any name.
    """
    columns, docs = docs.columns, set_apart(docs, [key, text])
    found = stored(near_duplicates(docs, key=key, text=text, linking=linking), "near_duplicates")
    alive = found.where(F.col("kept") & F.col(key).isNotNull()).groupBy(key).agg(F.min("text_hash").alias("_keep"), F.count("*").alias("_n"))
    alive = stored(alive, "alive")
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    gone = stored(
        found.join(alive.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").where(F.col(key).isNotNull() & (F.col("_keep").isNull() | (F.col("text_hash") != F.col("_keep"))))
        .select(F.col(key).alias("_k"), F.col("text_hash").alias("_h")).distinct(), "gone",
    )
    doubtful = marked(hashed, F.col("_hash"), gone, F.col("_h"))
    checked = doubtful.where("_maybe").join(gone, (F.col(key) == F.col("_k")) & (F.col("_hash") == F.col("_h")), "left_anti")
    left = doubtful.where("not _maybe").unionByName(checked).drop("_maybe")
    if alive.where("_n > 1").isEmpty():
        return put_back(left, columns)
    again = alive.where("_n > 1").select(F.col(key).alias("_k"))
    single = left.join(again, F.col(key) == F.col("_k"), "left_anti")
    repeated = left.join(again, F.col(key) == F.col("_k"), "left_semi").dropDuplicates([key, "_hash"])
    return put_back(single.unionByName(repeated), columns)
