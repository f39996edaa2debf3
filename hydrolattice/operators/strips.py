"""Band blocks as strips of pixel lines: alignment and resampling on arrays.

A strip is one 20 m line of a scene, cut at a fixed number of columns, with the two 10 m lines over it and the 20 m lines
above and below it. Block lines are dealt to the strips that need them, one pixel beyond both ends for the bands that are
interpolated, so a strip holds all it needs whatever the shapes of the blocks. One shuffle moves line pieces; bands are
aligned and resampled as arrays, and single pixels appear only after it, in the stage that reduces them to cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral

FINE = ("B02", "B03", "B04", "B08")
SMOOTH = ("B11", "B12")
CLASS = "SCL"
COLUMNS = 1024  # 20 m pixels of a strip


def line_pieces(blocks: DataFrame, keys: Sequence[str], columns: int = COLUMNS) -> DataFrame:
    """(keys, line, part, band, d, at, values): pieces of block lines, once for each strip (line, part) that they belong to.

    ``d`` is the piece's line within the strip: 0 or 1 of a 10 m band, -1, 0 or 1 of an interpolated band, 0 of the class;
    ``at`` is the place of its first value. Bands other than the seven are left out.
    """
    fine, smooth = F.col("band").isin(*FINE), F.col("band").isin(*SMOOTH)
    rows = blocks.filter(F.col("band").isin(*FINE, *SMOOTH, CLASS)).select(*keys, "band", "row0", "col0", F.posexplode("px").alias("_r", "_line"))
    row = F.col("row0") + F.col("_r")
    lines = rows.filter(F.size("_line") > 0).select(
        *keys, "band", F.col("col0").cast("long").alias("_from"), (F.col("col0") + F.size("_line") - 1).cast("long").alias("_to"), F.col("_line").cast("array<double>").alias("_line"),
        F.when(fine, F.lit(2 * columns)).otherwise(F.lit(columns)).alias("_wide"), F.when(smooth, 1).otherwise(0).alias("_over"), row.alias("_row"),
        F.explode(F.when(fine, F.array(F.pmod(row, F.lit(2)))).when(smooth, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("d"),
    )
    part = F.sequence(F.floor((F.col("_from") - F.col("_over")) / F.col("_wide")), F.floor((F.col("_to") + F.col("_over")) / F.col("_wide")))
    dealt = lines.withColumn("part", F.explode(part)).withColumn("_start", F.col("part") * F.col("_wide") - F.col("_over"))
    skip = F.greatest(F.col("_start") - F.col("_from"), F.lit(0).cast("long"))
    at = F.greatest(F.col("_from") - F.col("_start"), F.lit(0).cast("long"))
    room = F.col("_wide") + 2 * F.col("_over") - at
    line = F.when(fine, F.floor((F.col("_row") - F.col("d")) / 2)).otherwise(F.col("_row") - F.col("d"))
    return dealt.select(
        *keys, line.cast("long").alias("line"), "part", "band", "d", at.cast("int").alias("at"),
        F.slice("_line", (skip + 1).cast("int"), room.cast("int")).alias("values"),
    )


def joined(pieces: str, width: str) -> Column:
    """One array of ``width`` values from pieces (at, values), both SQL text; gaps are missing, and of pieces that overlap the
    first counts."""
    def gap(size: str) -> str:
        return f"array_repeat(cast(null as double), greatest({size}, 0))"

    seen = "greatest(size(a) - p.at, 0)"
    add = f"concat(a, {gap('p.at - size(a)')}, slice(p.values, {seen} + 1, greatest(size(p.values) - {seen}, 0)))"
    return F.expr(f"aggregate(array_sort({pieces}), cast(array() as array<double>), (a, p) -> {add}, a -> slice(concat(a, {gap(f'{width} - size(a)')}), 1, {width}))")


def between(values: str, beside: str) -> str:
    """SQL text: values a quarter of the way to their neighbours; a missing neighbour has no weight."""
    return f"zip_with({values}, {beside}, (v, b) -> if(b is null, v, v * 0.75D + b * 0.25D))"


def interleaved(left: str, right: str) -> Column:
    return F.expr(f"flatten(zip_with({left}, {right}, (a, b) -> array(a, b)))")


def block_pixels(blocks: DataFrame, scenes: DataFrame, *, keys: Sequence[str] = ("scene_id", "date"), key: str = "scene_id", baseline: str = "baseline", columns: int = COLUMNS) -> DataFrame:
    """10 m pixels with the seven bands and the scene's offset from blocks (keys, band, row0, col0, px).

    A pixel exists where a block of a 10 m band covers it; other bands are missing where no block has them. The bands B11 and
    B12 are resampled before the offset, which follows from the processing baseline of each scene; a scene without one fails.
    """
    pieces = line_pieces(blocks, keys, columns)
    strips = pieces.groupBy(*keys, "line", "part").agg(F.collect_list(F.struct("band", "d", "at", "values")).alias("_p"))  # 15 lines

    size, fine = F.col("_size"), f"p.band in {FINE}"  # the size counts 20 m pixels up to the last 10 m pixel of the strip

    def slot(band: str, d: int, width: str) -> Column:
        return joined(f"transform(filter(_p, p -> p.band = '{band}' and p.d = {d}), p -> named_struct('at', p.at, 'values', p.values))", width)

    def covered(d: int) -> Column:
        return joined(f"transform(filter(_p, p -> {fine} and p.d = {d}), p -> named_struct('at', p.at, 'values', array_repeat(1.0D, size(p.values))))", "_size * 2")

    offsets = scenes.select(key, F.col(baseline).alias("_baseline"))
    sized = strips.withColumn("_size", F.expr(f"cast(ceil(array_max(transform(filter(_p, p -> {fine}), p -> p.at + size(p.values))) / 2) as int)")).filter(size > 0)
    whole = sized.join(offsets, key, "left").withColumn("offset", spectral.baseline_offset("_baseline"))
    slots = {f"_{b}{d}": slot(b, d, "_size * 2") for b in FINE for d in (0, 1)} | {f"_{b}{d + 1}": slot(b, d, "_size + 2") for b in SMOOTH for d in (-1, 0, 1)}
    whole = whole.select(*keys, "line", "part", "offset", "_size", slot(CLASS, 0, "_size").alias("_class"), *[v.alias(n) for n, v in slots.items()], *[covered(d).alias(f"_covered{d}") for d in (0, 1)])
    # Along each 20 m line first, which has one value more at both ends, then towards the line above and the line below.
    sides = {f"_{b}{k}{s}": F.expr(between(f"slice(_{b}{k}, 2, _size)", f"slice(_{b}{k}, {at}, _size)")) for b in SMOOTH for k in range(3) for s, at in (("l", 1), ("r", 3))}
    whole = whole.select(*[c for c in whole.columns if c[1:4] not in SMOOTH], *[v.alias(n) for n, v in sides.items()])
    sharp = {b: [interleaved(*[between(f"_{b}1{s}", f"_{b}{k}{s}") for s in "lr"]) for k in (0, 2)] for b in SMOOTH}
    lines = F.array(*[
        F.struct(
            (F.col("line") * 2 + d).alias("row"), F.col(f"_covered{d}").alias("_covered"), *[F.col(f"_{b}{d}").alias(b.lower()) for b in FINE],
            *[sharp[b][d].alias(b.lower()) for b in SMOOTH], interleaved("_class", "_class").alias("scl"),
        )
        for d in (0, 1)
    ])
    names = [b.lower() for b in (*FINE, *SMOOTH, CLASS)]
    each = whole.select(*keys, "offset", "part", "_size", F.inline(lines))
    place = F.sequence(F.col("part") * (2 * columns), F.col("part") * (2 * columns) + 2 * size - 1).alias("col")
    pixels = each.select(*keys, "offset", "row", "_covered", place, *names).select(*keys, "offset", "row", F.inline(F.arrays_zip("col", "_covered", *names)))
    return pixels.filter(F.col("_covered").isNotNull()).drop("_covered").withColumn("scl", F.col("scl").cast("int"))
