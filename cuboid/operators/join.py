"""Joins of boxes with boxes.

A join on overlapping ranges alone would be planned as a nested loop.  Here boxes meet in the cells
of a grid of several levels, with a width of its own on each axis: a box belongs to the level whose cells
are at least as large as it is, so it touches two cells at most on each axis; two boxes meet on the larger
one's level.  Large boxes thus need no path of their own.  A pair counts only in the cell that holds the
lower corner of what the two have in common, so no pair comes twice and nothing must be made distinct.  Hot
cells are split by Spark's handling of skewed joins.

Each side is computed once: it is checkpointed, and its rows and extents are observed while it is written.
Where the sides' rows make few pairs, which is checked, the smaller one is broadcast instead.  What was not
counted is never broadcast: Spark's estimate knows nothing of the cells a box is dealt to, and follows the
size of packed files, so a side of a few MB there may be a GB in the driver.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cuboid.functions import geometry as G
from cuboid.settings import shared_dir

#: Rows up to which a side is broadcast, if all pairs of both are ``PAIRS`` at most or it has ``FEW`` rows at most.
SMALL, FEW, PAIRS = 2_000, 32, 50_000_000
AXES = 2
#: Cells of a level are so many times as wide as those of the one below; boxes of the widest level are all larger ones.
_STEP, _LEVELS = 8.0, 12


def rows_at_most(df: DataFrame) -> int | None:
    """A bound on the rows that the plan itself proves, as for ranges and local rows, without a job."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    if plan.nodeName() == "Range":
        return int(str(plan.numElements()))
    return int(plan.data().size()) if plan.nodeName() == "LocalRelation" else None


class _Side:
    """One side, computed once: its rows, mean and largest extents, and the spread of its boxes."""

    def __init__(self, df: DataFrame, axes: int, dims: int) -> None:
        shared_dir(df.sparkSession)
        seen, ordinary = Observation(), df.where(~G.is_empty(G.bounds(dims)))
        wide = [(F.col(f"max_{i}") - F.col(f"min_{i}")).cast("double") for i in range(axes)]
        of = lambda name, fn, cols: [fn(c).alias(f"{name}{i}") for i, c in enumerate(cols)]
        ends = [*of("low", F.min, [F.col(f"min_{i}") for i in range(axes)]), *of("high", F.max, [F.col(f"max_{i}") for i in range(axes)])]
        self.df = ordinary.observe(seen, F.count(F.lit(1)).alias("n"), *of("mean", F.avg, wide), *of("most", F.max, wide), *ends).checkpoint()
        row = seen.get
        pick = lambda name: [float(row[f"{name}{i}"] or 0.0) for i in range(axes)]
        self.n, self.mean, self.most = row["n"], pick("mean"), pick("most")
        self.span = [b - a for a, b in zip(pick("low"), pick("high"))]


def _widths(left: _Side, right: _Side, axes: int) -> list[float]:
    """Cells as wide as the boxes' mean extent, but no smaller than an even share of the spread for each row."""
    share = max(left.n, right.n, 1) ** (1 / axes)
    out = []
    for i in range(axes):
        width = max(left.mean[i], right.mean[i], max(left.span[i], right.span[i]) / share)
        out.append(width if width > 0 and math.isfinite(width) else 1.0)
    return out


def _level(axes: int, widths: list[float], top: int) -> Column:
    """The level whose cells are at least as wide as the box on every axis."""
    out = F.lit(0)
    for level in range(top):
        wider = reduce(lambda a, b: a | b, ((F.col(f"max_{i}") - F.col(f"min_{i}")).cast("double") > widths[i] * _STEP**level for i in range(axes)))
        out = F.when(wider, F.lit(level + 1)).otherwise(out)
    return out


def _cell(x: Column, level: Column, width: float) -> Column:
    """Index of the cell that holds a coordinate; both sides use this very expression."""
    return F.floor(x.cast("double") / (F.lit(width) * F.pow(F.lit(_STEP), level))).cast("long")


def _dealt(side: DataFrame, axes: int, widths: list[float], top: int, left: bool) -> DataFrame:
    """Each box in the cells that it touches, on its own level and on larger ones.

    A pair is on the level of its larger box, of the left one if both are alike: kind 0.  There boxes of the
    left side are on their own level only, those of the right side on their own and all larger ones.  Where the
    right box is larger, kind 1, it is the other way round.  So no cell holds boxes that can't be a pair on its level.
    """
    own = _level(axes, widths, top)
    larger = F.sequence(F.col("__own") + 1, F.lit(top))
    larger = F.when(F.col("__own") < top, larger).otherwise(F.array().cast("array<int>"))
    of = lambda levels, kind: F.transform(levels, lambda v: F.struct(v.alias("level"), F.lit(kind).alias("kind")))
    here = F.array(F.col("__own"))
    places = F.concat(of(here, 0), of(larger, 1)) if left else F.concat(of(F.concat(here, larger), 0), of(here, 1))
    out = side.withColumn("__own", own).withColumn("__at", F.explode(places)).withColumn("__level", F.col("__at.level")).withColumn("__kind", F.col("__at.kind"))
    for i in range(axes):
        out = out.withColumn(f"__c{i}", F.explode(F.sequence(_cell(F.col(f"min_{i}"), F.col("__level"), widths[i]), _cell(F.col(f"max_{i}"), F.col("__level"), widths[i]))))
    return out.drop("__at", "__own")


def _broadcast(left: DataFrame, right: DataFrame, small: int) -> str | None:
    """Which side is small enough to be broadcast, by proven bounds and then by counts of at most ``small`` + 1 rows."""
    known = {"right": rows_at_most(right), "left": rows_at_most(left)}
    if not small:
        return None
    if None not in known.values() and min(known.values()) <= small and known["left"] * known["right"] <= PAIRS:
        return min(known, key=known.get)
    for name, side in (("right", right), ("left", left)):
        n = known[name] if known[name] is not None else side.limit(FEW + 1).count()
        if n <= FEW:
            return name
    return None


def box_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", how: str = "inner", axes: int = AXES, small: int = SMALL) -> DataFrame:
    """Pairs (inner), or rows of ``left`` with (left_semi) or without (left_anti) a partner in ``right``.

    inner: all columns of both sides; those of ``right`` start with ``r_``.  Boxes without points meet nothing.
    """
    dims = G.dims_of(left.columns)
    if dims != G.dims_of(right.columns):
        raise ValueError("sides have different numbers of dimensions")
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how}")
    axes = min(axes, dims)
    r_ = lambda df: df.select(*(F.col(c).alias(f"r_{c}") for c in df.columns))
    a, b = G.bounds(dims), G.bounds(dims, prefix="r_")
    condition = G.predicate(predicate, a, b) & G.intersects(a, b) & ~G.is_empty(a) & ~G.is_empty(b)
    which = _broadcast(left, right, small)
    if which == "right":
        return left.join(F.broadcast(r_(right)), condition, how)
    if which == "left" and how == "inner":
        return F.broadcast(left).join(r_(right), condition)
    names = G.bound_names(dims)
    # Whether a row has a partner depends on its box alone: distinct boxes are joined, then rows with them.
    one = _Side(left if how == "inner" else left.select(*names).distinct(), axes, dims)
    two = _Side(right if how == "inner" else right.select(*names).distinct(), axes, dims)
    widths = _widths(one, two, axes)
    most = max((m / w for side in (one, two) for m, w in zip(side.most, widths)), default=1.0)
    top = min(_LEVELS, max(0, math.ceil(math.log(max(most, 1.0), _STEP))))
    dealt, dealt_right = _dealt(one.df, axes, widths, top, True), r_(_dealt(two.df, axes, widths, top, False))
    cells = ["__level", "__kind", *(f"__c{i}" for i in range(axes))]
    meets = reduce(and_, (F.col(c) == F.col(f"r_{c}") for c in cells))
    corner = reduce(and_, (_cell(F.greatest(a.lo[i], b.lo[i]), F.col("__level"), widths[i]) == F.col(f"__c{i}") for i in range(axes)))
    if how == "inner":
        return dealt.join(dealt_right.hint("merge"), meets & condition & corner).drop(*cells, *(f"r_{c}" for c in cells))
    met = dealt.join(dealt_right.hint("merge"), meets & condition, "left_semi").select(*names).distinct()
    same = reduce(and_, (left[n].eqNullSafe(met[n]) for n in names))
    return left.join(met.hint("merge"), same, how)


def batch_query_counts(records: DataFrame, queries: DataFrame, predicate: str = "intersects", **how) -> DataFrame:
    """(qid, n): matches of each query box, by its id; queries without any have 0.  One exchange beyond the join's."""
    pairs = box_join(records, queries, predicate, **how).select(F.col("r_qid").alias("qid"), F.lit(1).cast("long").alias("n"))
    return pairs.union(queries.select("qid", F.lit(0).cast("long").alias("n"))).groupBy("qid").agg(F.sum("n").alias("n"))
