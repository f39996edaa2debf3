"""How far the sources of a language differ in their use of words.

Each language keeps the terms of enough documents. A term has a smoothed share in every source, as an integer of parts per
billion; two sources differ by the sum of the distances of their shares over all kept terms. Most terms are missing from
most sources, and a missing term's share depends on the source alone. So a pair's sum is taken apart: what it would be if
no term occurred, what each occurring term of one source changes against the other's missing one, and a correction for
terms that occur in both. For the corrections the terms become rows, their nonzero counts in the order of the sources,
equal rows with a multiplicity. Sorted rows are inserted into a frequent-pattern tree: rows with a common prefix share the
path, and a node is corrected against each of its ancestors once, times the rows that run through it.

Each task inserts a sorted range of rows and keeps the current path alone, so the tree needs no memory beyond one path and
the bounded table of pair sums. A path cut by a range border is two nodes with a part of the multiplicity each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import slices, stored

TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8: all but ASCII that is no letter
INSIDE = frozenset(b"abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
UNIT = 1_000_000_000
SMOOTH = 5
HELD_TERMS = 200_000  # terms in a task's counters before it hands on its partial counts
HELD_CELLS = 1_000_000  # pair sums in a task before it hands them on
TEXT_PIECE = 1 << 20
SALTS = 16


def pieces_of(data: bytes, size: int = TEXT_PIECE) -> Iterator[bytes]:
    """The bytes of a text cut between terms, so that a long text's terms are never held all at once."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] in INSIDE:
            end += 1
        yield data[at:end]
        at = end


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """Partial (lang, source, term, count, docs) of all documents; missing values are empty."""
    inner = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (of, site), (total, spread) in held.items():
            terms = list(total)
            yield pa.RecordBatch.from_arrays([
                pa.array([of] * len(terms), pa.string()), pa.array([site] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()),
                pa.array(total.values(), pa.int64()), pa.array([spread[t] for t in terms], pa.int64()),
            ], names=["lang", "source", "term", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                for of, site, words in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    total, spread = held.setdefault((of, site), (Counter(), Counter()))
                    seen: set[bytes] = set()
                    for piece in pieces_of(words.encode().lower()):
                        terms = TERM.findall(piece)
                        total.update(terms)
                        seen.update(terms)
                    spread.update(seen)
                if sum(len(t) for t, _ in held.values()) > HELD_TERMS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return inner.mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint")


def share(count, total, kept) -> Column:
    """Smoothed parts per billion, at least 1: exact whole numbers. Without kept terms there is nothing to share, which gives 1."""
    whole = F.expr(f"cast({count} + {SMOOTH} as decimal(20,0)) * {UNIT} div cast({total} + {SMOOTH} * {kept} as decimal(20,0))")
    return F.when(F.col(kept) > 0, whole + 1).otherwise(F.lit(1).cast("long"))


class PatternTree:
    """The current path of a frequent-pattern tree over sorted rows, and the pair sums of all nodes that it has left."""

    def __init__(self) -> None:
        self.lang: str | None = None
        self.path: list[tuple[int, int, int, int]] = []
        self.passing: list[int] = []
        self.shares = np.zeros((2, 0), np.int64)
        self.orders = np.zeros(0, np.int64)
        self.sums: dict[int, np.ndarray] = {}
        self.cells = 0

    def insert(self, row: list[tuple[int, int, int, int]], times: int) -> None:
        """A row of (source's place, count, share, share of a missing term), of which there are ``times``."""
        common = 0
        for a, b in zip(self.path, row, strict=False):
            if a != b:
                break
            common += 1
        self.leave(common)
        if len(row) > len(self.orders):
            self.orders = np.zeros(2 * len(row), np.int64)
            self.shares = np.zeros((2, 2 * len(row)), np.int64)
            for d, (o, _, p, q) in enumerate(self.path):
                self.orders[d], self.shares[:, d] = o, (p, q)
        for d in range(common, len(row)):
            o, _, p, q = row[d]
            self.orders[d], self.shares[0, d], self.shares[1, d] = o, p, q
            self.path.append(row[d])
            self.passing.append(0)
        self.passing[-1] += times

    def leave(self, depth: int) -> None:
        """Close the nodes below ``depth``: each is corrected against all its ancestors once."""
        while len(self.path) > depth:
            o, _, p, q = self.path.pop()
            times = self.passing.pop()
            d = len(self.path)
            if not d:
                continue
            self.passing[-1] += times
            there, missing = self.shares[0, :d], self.shares[1, :d]
            change = np.abs(there - p) - np.abs(there - q) - np.abs(missing - p) + np.abs(missing - q)
            if o not in self.sums:
                self.sums[o] = np.zeros(o, np.int64)  # ancestors come before it in the order of sources
                self.cells += o
            self.sums[o][self.orders[:d]] += change * times

    def take(self) -> Iterator[tuple[int, int, int]]:
        """(place, later place, sum) so far."""
        for o, values in self.sums.items():
            for a in np.flatnonzero(values).tolist():
                yield a, o, int(values[a])
        self.sums, self.cells = {}, 0


def corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) partial sums from distinct rows (lang, row, times), which are dealt in sorted ranges."""
    dealt = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = PatternTree()

        def out() -> Iterator[pa.RecordBatch]:
            found = list(tree.take())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([tree.lang] * len(found), pa.string()), *[pa.array(c, pa.int64()) for c in zip(*found, strict=True)]], names=["lang", "a", "b", "value"])

        for batch in batches:
            lists = batch.column("row")
            ends = lists.offsets.to_numpy()
            cells = list(zip(*(lists.values.field(c).to_pylist() for c in ("place", "count", "share", "missing")), strict=True))
            for i, (lang, times) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist(), strict=True)):
                if lang != tree.lang:
                    tree.leave(0)
                    yield from out()
                    tree.lang = lang
                tree.insert(cells[ends[i] : ends[i + 1]], times)
                if tree.cells > HELD_CELLS:
                    yield from out()
        tree.leave(0)
        yield from out()

    return dealt.mapInArrow(run, "lang string, a bigint, b bigint, value bigint")


def salted(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join of a table with few hot keys and a table that is unique or small per key: the second goes along SALTS times."""
    spun = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return spun.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"]).drop("_salt")


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows against every other source of the language, and ``term`` rows, the
    ``top`` terms that a source uses more than its language does.

    Missing texts, languages and sources are empty ones, other columns are ignored, repeated rows count each. A language without
    kept terms has pairs of value 0 and no terms; an empty table has no rows. Ranks break ties by item in UTF-8 order.
    """
    partial = term_counts(docs, lang, source, text)
    counts = stored(partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "term_counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("in"))
    terms = stored(by_term.where(F.col("docs") >= min_docs).select("lang", "term", "total", "in"), "kept_terms")  # a source per list entry
    held = terms.select("lang", F.explode("in").alias("i")).groupBy("lang", F.col("i.source").alias("source")).agg(F.sum("i.count").alias("n"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    sized = every.join(held, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("n_lang"))
    placed = sized.join(kept, "lang", "left").select(
        "lang", "source", "n", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"),
        (F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "source")) - 1).cast("long").alias("place"),
    )
    sources = stored(placed.withColumn("missing", share("0", "n", "kept")), "sources")  # a row per language and source
    use = salted(terms.select("lang", "term", "total", F.explode("in").alias("i")).select("lang", "term", "total", "i.*"), sources, ["lang", "source"])
    use = stored(use.withColumn("share", share("count", "n", "kept")).withColumn("overall", share("total", "n_lang", "kept")), "term_shares")

    rows = use.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("place", "count", "share", "missing"))).alias("row"))
    patterns = stored(rows.groupBy("lang", "row").agg(F.count("*").alias("times")), "patterns")
    other = sources.select("lang", F.col("place").alias("b"), F.col("missing").alias("b_missing"))
    met = salted(sources.select("lang", F.col("place").alias("a"), "missing", "kept"), other, ["lang"]).where("a < b")
    unused = met.select("lang", "a", "b", (F.abs(F.col("missing") - F.col("b_missing")) * F.col("kept")).alias("value"))
    levels = use.groupBy("lang", "place", "share", "missing").agg(F.count("*").alias("times"))
    against = salted(levels, other, ["lang"]).where("place <> b")
    change = F.abs(F.col("share") - F.col("b_missing")) - F.abs(F.col("missing") - F.col("b_missing"))
    used = against.select("lang", F.least("place", "b").alias("a"), F.greatest("place", "b").alias("b"), (change * F.col("times")).alias("value"))
    pairs = stored(unused.unionByName(used).unionByName(corrections(patterns)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair_sums")

    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = sources.select("lang", "place", "source")
    named = salted(salted(both, names.withColumnsRenamed({"place": "a"}), ["lang", "a"]), names.withColumnsRenamed({"place": "b", "source": "item"}), ["lang", "b"])
    out = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    over = use.where(F.col("share") > F.col("overall")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("overall")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    return out.select("*", rank).unionByName(over.select("*", rank).where(F.col("rank") <= top))
