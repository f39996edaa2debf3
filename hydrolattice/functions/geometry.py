"""Polygon predicates over an edge list.

A shape is ``edges ARRAY<STRUCT<x1,y1,x2,y2>>`` holding every ring of every part, so holes and
multi-part shapes follow from the even-odd rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

EDGE_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def ring_edges(ring) -> Column:
    """Edges of one ring of ``STRUCT<x,y>`` vertices; an open ring is closed."""
    ring = as_col(ring)
    size = F.size(ring)
    return F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            ring[i]["x"].alias("x1"), ring[i]["y"].alias("y1"),
            ring[(i + 1) % size]["x"].alias("x2"), ring[(i + 1) % size]["y"].alias("y2"),
        ),
    )


def shape_edges(rings) -> Column:
    return F.flatten(F.transform(as_col(rings), ring_edges))


def contains_point(edges, x, y, ray: str = "x") -> Column:
    """Even-odd ray cast from a point towards +x or +y; only edges that span the point across the ray count."""
    along, across = (as_col(x), as_col(y)) if ray == "x" else (as_col(y), as_col(x))
    a, c = ("x", "y") if ray == "x" else ("y", "x")

    def crosses(e: Column) -> Column:
        a1, a2, c1, c2 = e[f"{a}1"], e[f"{a}2"], e[f"{c}1"], e[f"{c}2"]
        spans = (c1 > across) != (c2 > across)
        at = F.try_divide((a2 - a1) * (across - c1), c2 - c1) + a1
        return spans & F.coalesce(along < at, F.lit(False))

    return F.size(F.filter(as_col(edges), crosses)) % 2 == 1


def edges_between(edges, axis: str, low, high) -> Column:
    """Edges that reach into a closed interval of one axis."""
    low, high = as_col(low), as_col(high)
    one, two = f"{axis}1", f"{axis}2"
    return F.filter(as_col(edges), lambda e: (F.greatest(e[one], e[two]) >= low) & (F.least(e[one], e[two]) <= high))


def edge_distance(edges, x, y) -> Column:
    """Distance from a point to the nearest edge."""
    x, y = as_col(x), as_col(y)

    def distance(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - (e["x1"] + along * dx), y - (e["y1"] + along * dy))

    return F.array_min(F.transform(as_col(edges), distance))


def box_meets_shape(edges, minx, miny, maxx, maxy) -> Column:
    """Closed intersection: an edge meets the box, or the box lies inside the shape.

    Needs only the edges that reach into the box's x-range, because the ray runs along y.
    """
    minx, miny, maxx, maxy = map(as_col, (minx, miny, maxx, maxy))

    def meets(e: Column) -> Column:
        near = (
            (F.greatest(e["x1"], e["x2"]) >= minx) & (F.least(e["x1"], e["x2"]) <= maxx)
            & (F.greatest(e["y1"], e["y2"]) >= miny) & (F.least(e["y1"], e["y2"]) <= maxy)
        )
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        # Sides of the four corners, relative to the edge's line.
        sides = [dx * (cy - e["y1"]) - dy * (cx - e["x1"]) for cx in (minx, maxx) for cy in (miny, maxy)]
        return near & (F.greatest(*sides) >= 0) & (F.least(*sides) <= 0)

    return F.exists(as_col(edges), meets) | contains_point(edges, minx, miny, ray="y")
