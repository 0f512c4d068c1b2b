"""Axis-aligned boxes as flat columns ``min_0, max_0, min_1, ...`` and as column expressions over them.

Bounds are FLOAT: coordinates are narrowed as the records' are, so that a query box and the records
compare alike.  Flat columns let comparisons reach the Parquet scan.  All intervals are closed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, mul

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a box without points: no ordinary box meets it.
FLOAT_MAX = float(np.finfo(np.float32).max)


def narrow(x: float) -> float:
    """The value as float32."""
    if math.isnan(x) or math.isinf(x) or abs(x) > FLOAT_MAX:
        raise ValueError(f"not a finite float32 coordinate: {x}")
    return float(np.float32(x))


@dataclass(frozen=True)
class Box:
    """A query box; a point if both corners are equal.  ``coord_type`` double keeps coordinates as they are."""

    lo: tuple[float, ...]
    hi: tuple[float, ...]
    coord_type: str = "float"

    def __init__(self, lo: Sequence[float], hi: Sequence[float] | None = None, coord_type: str = "float") -> None:
        hi = lo if hi is None else hi
        if len(lo) != len(hi) or not len(lo):
            raise ValueError("corners need the same number of dimensions, one at least")
        keep = narrow if coord_type == "float" else float
        a, b = tuple(map(keep, lo)), tuple(map(keep, hi))
        if any(x > y for x, y in zip(a, b)):
            raise ValueError(f"lower corner above the upper one: {a} {b}")
        object.__setattr__(self, "lo", a)
        object.__setattr__(self, "hi", b)
        object.__setattr__(self, "coord_type", coord_type)

    @property
    def dims(self) -> int:
        return len(self.lo)

    def bounds(self) -> Bounds:
        lit = lambda x: F.lit(x).cast(self.coord_type)
        return Bounds([lit(x) for x in self.lo], [lit(x) for x in self.hi])


@dataclass(frozen=True)
class Bounds:
    """The bounds of one box per row, as columns."""

    lo: list[Column]
    hi: list[Column]

    @property
    def dims(self) -> int:
        return len(self.lo)


def bounds(dims: int, alias: str = "", prefix: str = "") -> Bounds:
    """The bound columns of a DataFrame, of an alias of it if one is given."""
    dot = f"{alias}." if alias else ""
    return Bounds([F.col(f"{dot}{prefix}min_{i}") for i in range(dims)], [F.col(f"{dot}{prefix}max_{i}") for i in range(dims)])


def bound_names(dims: int) -> list[str]:
    return [x for i in range(dims) for x in (f"min_{i}", f"max_{i}")]


def dims_of(columns: Sequence[str]) -> int:
    """How many dimensions a DataFrame with these columns has."""
    n = 0
    while f"min_{n}" in columns and f"max_{n}" in columns:
        n += 1
    if not n:
        raise ValueError("no bound columns min_0, max_0")
    return n


def _pair(a: Bounds, b: Bounds) -> None:
    if a.dims != b.dims:
        raise ValueError(f"{a.dims} and {b.dims} dimensions")


def intersects(a: Bounds, b: Bounds) -> Column:
    """Touching edges count; symmetric."""
    _pair(a, b)
    return reduce(and_, ((a.lo[i] <= b.hi[i]) & (a.hi[i] >= b.lo[i]) for i in range(a.dims)))


def contains(a: Bounds, b: Bounds) -> Column:
    """The record's box a holds the query's box b."""
    _pair(a, b)
    return reduce(and_, ((a.lo[i] <= b.lo[i]) & (a.hi[i] >= b.hi[i]) for i in range(a.dims)))


def within(a: Bounds, b: Bounds) -> Column:
    """The record's box a lies in the query's box b; boxes without points don't."""
    _pair(a, b)
    return reduce(and_, ((a.lo[i] >= b.lo[i]) & (a.hi[i] <= b.hi[i]) for i in range(a.dims))) & ~is_empty(a)


def equals(a: Bounds, b: Bounds) -> Column:
    _pair(a, b)
    return reduce(and_, (a.lo[i].eqNullSafe(b.lo[i]) & a.hi[i].eqNullSafe(b.hi[i]) for i in range(a.dims)))


PREDICATES = {"intersects": intersects, "contains": contains, "within": within, "equals": equals}


def predicate(name: str, a: Bounds, b: Bounds) -> Column:
    if name not in PREDICATES:
        raise ValueError(f"unknown predicate {name}; known: {', '.join(PREDICATES)}")
    return PREDICATES[name](a, b)


def is_point(a: Bounds) -> Column:
    return reduce(and_, (a.lo[i] == a.hi[i] for i in range(a.dims)))


def is_empty(a: Bounds) -> Column:
    return a.lo[0] > a.hi[0]


def _extents(a: Bounds) -> list[Column]:
    """Differences are taken as the bounds' type and then widened."""
    return [(a.hi[i] - a.lo[i]).cast("double") for i in range(a.dims)]


def area(a: Bounds) -> Column:
    """Product of the extents; 0 for a box without points."""
    return F.when(is_empty(a), F.lit(0.0)).otherwise(reduce(mul, _extents(a)))


def margin(a: Bounds) -> Column:
    """Sum of the extents; 0 for a box without points."""
    return F.when(is_empty(a), F.lit(0.0)).otherwise(reduce(add, _extents(a)))


def overlap(a: Bounds, b: Bounds) -> Column:
    """Area of what both have; 0 if they are apart or only touch."""
    _pair(a, b)
    sides = [(F.least(a.hi[i], b.hi[i]) - F.greatest(a.lo[i], b.lo[i])).cast("double") for i in range(a.dims)]
    return reduce(mul, (F.greatest(F.lit(0.0), s) for s in sides))


def percent_overlap(a: Bounds, b: Bounds) -> Column:
    """2 overlap / (area + area); 0 if a is a point or nothing overlaps."""
    shared = overlap(a, b)
    return F.when(is_point(a) | (shared == 0), F.lit(0.0)).otherwise(2 * shared / (area(a) + area(b)))


def union(a: Bounds, b: Bounds) -> Bounds:
    """The smallest box that holds both; one without points changes nothing."""
    _pair(a, b)
    return Bounds([F.least(a.lo[i], b.lo[i]) for i in range(a.dims)], [F.greatest(a.hi[i], b.hi[i]) for i in range(a.dims)])


def enlargement(a: Bounds, b: Bounds, mode: str = "exact") -> Column:
    """How much a's area grows to hold b.

    compat: the product of the union's extents stops before the first axis on which a has no extent;
    a box that is flat on its first axis gives -1.
    """
    if mode == "exact":
        return area(union(a, b)) - area(a)
    if mode != "compat":
        raise ValueError(f"unknown mode {mode}")
    wide, own = _extents(union(a, b)), _extents(a)
    out = F.lit(-1.0)
    for n in range(1, a.dims + 1):
        rounded = reduce(and_, (x != 0 for x in own[:n]))
        out = F.when(rounded, reduce(mul, wide[:n]) - (area(a) if n == a.dims else F.lit(0.0))).otherwise(out)
    return out


def overlap_enlargement(a: Bounds, b: Bounds, siblings: Sequence[Box], mode: str = "exact") -> Column:
    """How much more of the siblings' boxes a covers once it has grown to hold b.

    compat: for each sibling the product, over the axes on which it starts before the grown box ends, of the
    distance from its start to that end; 0 if there is no such axis or once the product is 0.
    """
    if mode not in ("exact", "compat"):
        raise ValueError(f"unknown mode {mode}")
    grown, out = union(a, b), F.lit(0.0)
    for s in (x.bounds() for x in siblings):
        if mode == "exact":
            out = out + overlap(grown, s) - overlap(a, s)
            continue
        _pair(a, s)
        far = [(grown.hi[i] - s.lo[i]).cast("double") for i in range(a.dims)]
        met = reduce(lambda x, y: x | y, (x >= 0 for x in far))
        out = out + F.when(met, reduce(mul, (F.when(x >= 0, x).otherwise(F.lit(1.0)) for x in far))).otherwise(F.lit(0.0))
    return out


def to_text(a: Bounds) -> Column:
    """``[(min, max) ...]``."""
    pairs = [F.concat(F.lit("("), a.lo[i].cast("string"), F.lit(", "), a.hi[i].cast("string"), F.lit(")")) for i in range(a.dims)]
    return F.concat(F.lit("["), F.concat_ws(" ", *pairs), F.lit("]"))


def union_agg(dims: int) -> list[Column]:
    """The union of all boxes as aggregates, partial before the exchange; boxes without points change nothing."""
    return [x for i in range(dims) for x in (F.min(f"min_{i}").alias(f"min_{i}"), F.max(f"max_{i}").alias(f"max_{i}"))]
