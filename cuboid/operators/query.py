"""Range, point and paged queries over records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cuboid.functions import geometry as G
from cuboid.functions.geometry import Box


def range_query(records: DataFrame, box: Box, predicate: str = "intersects") -> DataFrame:
    """The records whose box meets the predicate; plain comparisons of bounds, which reach the scan of a stored table."""
    dims = G.dims_of(records.columns)
    if dims != box.dims:
        raise ValueError(f"records have {dims} dimensions, the box has {box.dims}")
    return records.where(G.predicate(predicate, G.bounds(dims), box.bounds()))


def point_query(records: DataFrame, point: Sequence[float]) -> DataFrame:
    """The records whose box holds the point."""
    return range_query(records, Box(point))


def full_scan(records: DataFrame) -> DataFrame:
    """All records that have points, as an all-covering box would find them."""
    return records.where(~G.is_empty(G.bounds(G.dims_of(records.columns))))


def points_in_box(df: DataFrame, coords: Sequence[str], box: Box) -> DataFrame:
    """Rows of a raw table whose coordinates, as float32, lie in the box.

    A comparison of a cast column can't reach the Parquet scan.  So the coordinates themselves are
    compared too, with the box widened by one float32 step on each side, which loses nothing.
    """
    if len(coords) != box.dims:
        raise ValueError(f"{len(coords)} coordinates, the box has {box.dims} dimensions")
    return df.where(reduce(and_, (_in_interval(F.col(c), lo, hi) for c, lo, hi in zip(coords, box.lo, box.hi))))


def _in_interval(x: Column, lo: float, hi: float) -> Column:
    below = float(np.nextafter(np.float32(lo), np.float32(-np.inf)))
    above = float(np.nextafter(np.float32(hi), np.float32(np.inf)))
    narrow = x.cast("float")
    return (x >= below) & (x <= above) & (narrow >= F.lit(lo).cast("float")) & (narrow <= F.lit(hi).cast("float"))


def page(df: DataFrame, order: Sequence[Column | str], size: int = 100, number: int = 0) -> DataFrame:
    """One page of a total order; the first ones never sort the whole table."""
    return df.orderBy(*order).offset(size * number).limit(size)


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows one after another, a partition at a time, the next one fetched ahead."""
    return df.toLocalIterator(prefetchPartitions=True)


def order_by_axis(records: DataFrame, axis: int, upper: bool = False) -> DataFrame:
    return records.orderBy(F.col(f"{'max' if upper else 'min'}_{axis}"), "row_id")


def least_enlargement(records: DataFrame, box: Box, count: int) -> DataFrame:
    """The records whose boxes grow least to hold the box; a bounded top list in each task."""
    grow = G.enlargement(G.bounds(G.dims_of(records.columns)), box.bounds())
    return records.withColumn("enlargement", grow).orderBy("enlargement", "row_id").limit(count)
