"""Records: an id, its points and the flat bounds of their box, from several kinds of input.

Coordinates that are NaN, infinite or beyond float32 have no defined order in a box: ``invalid="raise"``
fails the job, ``"drop"`` leaves such rows out.  A null coordinate counts as no point.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from cuboid.functions.geometry import FLOAT_MAX

RECORD = StructType([StructField("row_id", StringType(), False), StructField("points", ArrayType(ArrayType(DoubleType())), False)])


def finite(x: Column) -> Column:
    """Whether a coordinate can be a float32 bound; null can't."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= FLOAT_MAX)


def _checked(df: DataFrame, good: Column, invalid: str) -> DataFrame:
    if invalid == "drop":
        return df.where(good)
    if invalid != "raise":
        raise ValueError(f"unknown way with invalid coordinates: {invalid}")
    return df.where(F.when(good, True).otherwise(F.raise_error(F.lit("a coordinate is null, NaN, infinite or beyond float32")).cast("boolean")))


def records_from_points(df: DataFrame, row_id: str | Column, coords: Sequence[str | Column], invalid: str = "drop", coord_type: str = "float", keep: Sequence[str] = ()) -> DataFrame:
    """One point per row: ``row_id`` and equal bounds, and further columns that are named."""
    cols = [F.col(c) if isinstance(c, str) else c for c in coords]
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    checked = _checked(df, reduce(and_, map(finite, cols)), invalid)
    own = [c.cast(coord_type) for c in cols]
    return checked.select(rid.cast("string").alias("row_id"), *keep, *(x.alias(n) for i, x in enumerate(own) for n in (f"min_{i}", f"max_{i}")))


def records_from_groups(df: DataFrame, row_id: str, coords: Sequence[str], coord_type: str = "float", points: bool = False) -> DataFrame:
    """One record per id over all its rows' points: the bounds are partial aggregates, so no id's rows meet in one task.

    points: gather them too; only for ids with few rows.
    """
    good = df.where(reduce(and_, (finite(F.col(c)) for c in coords)))
    aggs = [x for i, c in enumerate(coords) for x in (F.min(F.col(c)).cast(coord_type).alias(f"min_{i}"), F.max(F.col(c)).cast(coord_type).alias(f"max_{i}"))]
    if points:
        aggs.insert(0, F.collect_list(F.array(*(F.col(c).cast("double") for c in coords))).alias("points"))
    return good.groupBy(F.col(row_id).cast("string").alias("row_id")).agg(*aggs)


def _axis(points: Column, i: int) -> Column:
    # A default argument would be taken for the element's place.
    return F.transform(points, lambda p: p[i].cast("float"))


def records_from_point_arrays(df: DataFrame, dims: int, row_id: str = "row_id", points: str = "points", invalid: str = "raise") -> DataFrame:
    """Records with all their points in one array; without points the box is the inverted one that nothing meets."""
    flat = F.flatten(F.col(points))
    whole = F.forall(F.col(points), lambda p: F.size(p) == dims) & F.forall(flat, finite)
    checked = _checked(df, F.coalesce(whole, F.lit(False)), invalid)
    out = [F.col(row_id).cast("string").alias("row_id"), F.col(points).cast("array<array<double>>").alias("points")]
    for i in range(dims):
        axis = _axis(F.col(points), i)
        out.append(F.coalesce(F.array_min(axis), F.lit(FLOAT_MAX).cast("float")).alias(f"min_{i}"))
        out.append(F.coalesce(F.array_max(axis), F.lit(-FLOAT_MAX).cast("float")).alias(f"max_{i}"))
    return checked.select(*out)


def records(spark: SparkSession, rows: Sequence[tuple[str, Sequence[Sequence[float]]]], dims: int) -> DataFrame:
    """Records from Python values, for small inputs and tests."""
    made = [(str(rid), [[float(x) for x in p] for p in points]) for rid, points in rows]
    if any(len(p) != dims for _, points in made for p in points):
        raise ValueError(f"points need {dims} dimensions")
    return records_from_point_arrays(spark.createDataFrame(made, RECORD), dims)
