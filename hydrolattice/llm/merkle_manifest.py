"""Merkle manifest of a dataset as a content-addressed graph of digests.

Every row is a leaf. The leaves of a group are numbered in order, each run of FANOUT neighbours becomes one node, and so
on until one node is left, the group's subroot; the subroots of all groups, in order, likewise give the root. Stored is one
record per distinct node: its digest and the digests of its children. A request for a leaf carries its place alone. It
descends from the root: on each level the digit of its place chooses a child in the record under the current digest, and
the children not chosen are one segment of its proof. Requests with common leading digits descend as one. The segments,
met from the root down, are reversed in the end, because a proof is folded from the leaf up.

Leaves are numbered by sorted ranges, never by one task for a group. Rows repeated whole are counted first and numbered as
one run, so that no range is a single key. Nodes with equal digests share one record; a digest that many nodes share is
looked up in a small table of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

FANOUT = 8
RUN_ROWS = 4096  # copies that one row stands for while they are dealt out
HOT_SHARE = 1000  # a digest shared by over one in so many nodes of a level is hot, so a level has fewer hot digests than that
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Level:
    """Records (digest, children) of the nodes on one level, and again those of its hot digests where there are any."""

    records: DataFrame
    hot: DataFrame | None


@dataclass(frozen=True)
class Manifest:
    """``leaves``: (group, place, key, leaf, carried columns); ``levels``: of the group trees, the lowest first; ``subroots``:
    (group, subroot, height, turn); ``top``: levels of the tree over the subroots; ``start``: the root's (digest) as a table of
    one row, none for an empty table; ``root``: its value or None."""

    leaves: DataFrame
    levels: list[Level]
    subroots: DataFrame
    top: list[Level]
    start: DataFrame
    root: str | None


def row_digest(**changed: Column) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and its value, or ``-`` where it is missing."""
    def framed(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[framed(name) for name in FIELDS]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 within each group in ascending order (missing values first), and ``n``, the group's places.

    A row takes ``copies`` places from ``place`` on. Sorted ranges are written once and each goes on from those before it, so
    a group of any size is numbered by many tasks. Rows with equal ``order`` must be equal.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranges = stored(rows.repartitionByRange(F.col(group).asc_nulls_first(), *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(group, "_range").agg(F.sum("copies").alias("_in"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = counts.select(
        F.struct(group, "_range").alias("_in_range"), F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_in").over(Window.partitionBy(group)).alias("n"),
    )
    inside = Window.partitionBy(group, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("_at", F.coalesce(F.sum("copies").over(inside), F.lit(0))).withColumn("_in_range", F.struct(group, "_range"))
    return placed.join(before, "_in_range").withColumn("place", F.col("_at") + F.col("_before")).drop("_at", "_before", "_in_range", "_range")


def each_copy(placed: DataFrame) -> DataFrame:
    """One row per place. Long runs of copies are cut and dealt out before they are written out."""
    cut = placed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN_ROWS))))
    long = F.col("copies") > RUN_ROWS
    dealt = cut.where(~long).unionByName(cut.where(long).repartition("group", "place", "_part"))
    size = F.least(F.col("copies") - F.col("_part") * RUN_ROWS, F.lit(RUN_ROWS).cast("long"))
    steps = dealt.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    return steps.withColumn("place", F.col("place") + F.col("_part") * RUN_ROWS + F.col("_step")).drop("_part", "_step", "copies")


def make_levels(nodes: DataFrame, name: str) -> tuple[list[Level], DataFrame]:
    """Levels over nodes (group, place, n, digest), and each group's last node with the height it was reached at.

    ``n`` counts the group's nodes on a level. Each round leaves an eighth of the nodes.
    """
    levels: list[Level] = []
    ended = nodes.where("n = 1").select("group", "digest", F.lit(0).alias("height"))
    rest = nodes.where("n > 1")
    while not rest.isEmpty():
        runs = rest.groupBy("group", F.floor(F.col("place") / FANOUT).alias("place")).agg(
            F.ceil(F.first("n") / FANOUT).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda c: c["digest"]).alias("children"),
        )  # FANOUT rows a group at most
        made = stored(runs.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{name}_nodes")
        distinct = stored(made.groupBy("digest").agg(F.first("children").alias("children"), F.count("*").alias("nodes")), f"{name}_records")
        bound = max(FANOUT, made.count() // HOT_SHARE)
        hot = distinct.where(F.col("nodes") > bound).drop("nodes")
        levels.append(Level(distinct.drop("nodes"), None if hot.isEmpty() else hot))
        ended = ended.unionByName(made.where("n = 1").select("group", "digest", F.lit(len(levels)).alias("height")))
        rest = made.where("n > 1").select("group", "place", "n", "digest")
    return levels, ended


def build(rows: DataFrame, *, group: str = "lang", key: str = "doc_id", leaf: Column | None = None, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows``; the ``carried`` columns stay beside their leaf.

    Groups ascend with the missing one first, leaves by key with missing ones first. Leaves with one key ascend by digest, then
    by carried columns. Repeated rows are leaves of their own, other columns are ignored, and an empty table has no leaf.
    """
    more = carried or {}
    base = rows.select(
        F.col(group).alias("group"), F.col(key).alias("key"), (row_digest() if leaf is None else leaf).alias("leaf"), *[c.alias(n) for n, c in more.items()],
    )
    counted = base.groupBy("group", "key", "leaf", *more).agg(F.count("*").alias("copies"))
    leaves = stored(each_copy(numbered(counted, "group", ["key", "leaf", *more])), "leaves")
    levels, ended = make_levels(leaves.select("group", "place", "n", F.col("leaf").alias("digest")), "group")
    ends = stored(ended.select(F.lit(0).alias("all"), F.struct("group").alias("of"), "digest", "height", F.lit(1).cast("long").alias("copies")), "ends")
    turns = stored(numbered(ends, "all", ["of"]).select(F.col("of.group").alias("group"), F.col("digest").alias("subroot"), "height", F.col("place").alias("turn"), "n"), "subroots")
    top, last = make_levels(turns.select(F.lit(0).alias("group"), F.col("turn").alias("place"), "n", F.col("subroot").alias("digest")), "top")
    start = stored(last.select("digest"), "root")
    found = start.first()
    return Manifest(leaves.drop("n"), levels, turns.drop("n"), top, start, found["digest"] if found else None)


def with_children(nodes: DataFrame, level: Level) -> DataFrame:
    """Nodes (digest, ...) beside the children of their record. Hot digests take a table of fewer than HOT_SHARE records."""
    record = level.records.select(F.col("digest").alias("_d"), "children")
    if level.hot is None:
        return nodes.join(record, F.col("digest") == F.col("_d")).drop("_d")
    hot = F.broadcast(level.hot.select(F.col("digest").alias("_h"), F.col("children").alias("_c")))
    split = nodes.join(hot, F.col("digest") == F.col("_h"), "left")
    cold = split.where("_h is null").drop("_h", "_c").join(record, F.col("digest") == F.col("_d")).drop("_d")
    return cold.unionByName(split.where("_h is not null").withColumnRenamed("_c", "children").drop("_h"))


def segment(children, digit) -> Column:
    """The children beside the chosen one."""
    return F.struct(
        F.array_join(F.slice(children, 1, digit), "").alias("left"),
        F.array_join(F.slice(children, digit + 2, FANOUT), "").alias("right"),
    )


def _step(nodes: DataFrame, level: Level) -> DataFrame:
    """From nodes (group, place, digest, path) to their children, each with the segment it left behind."""
    each = with_children(nodes, level).select("group", "place", "path", "children", F.posexplode("children").alias("_digit", "_child"))
    path = F.concat("path", F.array(segment(F.col("children"), F.col("_digit")))).alias("path")
    return each.select("group", (F.col("place") * FANOUT + F.col("_digit")).alias("place"), F.col("_child").alias("digest"), path)


def _wanted(nodes: DataFrame, prefixes: DataFrame | None, height: int) -> DataFrame:
    """The nodes that lie above a requested leaf."""
    if prefixes is None:
        return nodes
    above = prefixes.select(F.struct("group", F.floor(F.col("place") / FANOUT**height).alias("place")).alias("_at")).distinct()
    return nodes.withColumn("_at", F.struct("group", F.col("place").cast("long").alias("place"))).join(above, "_at", "left_semi").drop("_at")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Requests (group, place, ...) beside ``leaf``, ``subroot``, ``root`` and ``path``, the segments from the leaf to the root.

    Without requests every leaf is asked for, with all its columns. Places that do not exist give no row.
    """
    asked = manifest.leaves.drop("leaf") if requests is None else requests
    places = None if requests is None else stored(requests.select("group", "place").distinct(), "requests")
    nodes = manifest.start.select(F.lit(0).alias("group"), F.lit(0).cast("long").alias("place"), "digest", F.array().cast(PATH).alias("path"))
    for level in reversed(manifest.top):
        nodes = _step(nodes, level)
    starts = stored(nodes.select(F.col("place").alias("turn"), "path").join(manifest.subroots, "turn"), "starts")

    def start(height: int) -> DataFrame:
        return _wanted(starts.where(F.col("height") == height).select("group", F.lit(0).cast("long").alias("place"), F.col("subroot").alias("digest"), "path"), places, height)

    nodes = None
    for height in range(len(manifest.levels), 1, -1):
        nodes = start(height) if nodes is None else nodes.unionByName(start(height))
        nodes = _wanted(_step(nodes, manifest.levels[height - 1]), places, height - 1)
    alone = start(0).select("group", "place", F.array("digest").alias("children"), "path", F.lit(True).alias("alone"))
    if manifest.levels:
        nodes = start(1) if nodes is None else nodes.unionByName(start(1))
        alone = alone.unionByName(with_children(nodes, manifest.levels[0]).select("group", "place", "children", "path", F.lit(False).alias("alone")))
    runs = alone.select(F.struct("group", "place").alias("_run"), "children", F.col("path").alias("_down"), "alone")
    met = asked.withColumn("_run", F.struct("group", F.floor(F.col("place") / FANOUT).alias("place"))).join(runs, "_run")
    digit = (F.col("place") % FANOUT).cast("int")
    down = F.when(F.col("alone"), F.col("_down")).otherwise(F.concat("_down", F.array(segment(F.col("children"), digit))))
    found = met.where(digit < F.size("children")).select(*asked.columns, F.get("children", digit).alias("leaf"), F.reverse(down).alias("path"))
    names = manifest.subroots.select(F.struct("group").alias("_of"), "subroot")
    return found.withColumn("_of", F.struct("group")).join(names, "_of").drop("_of").withColumn("root", F.lit(manifest.root))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf's digest gives along its path."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def proof_digest(path: str = "path") -> Column:
    """Digest of all siblings of a path, level by level from the leaf, each level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
