"""Physical layout: records near each other in space stand near each other on disk.

Clustering is what lets file and row-group statistics skip data: a Z-order key over the boxes' centres
ranges the records into files and sorts them within.  The key has room for boxes far outside the extent that
scales it, and records of one key are ranged by their bounds and ids, so a task gets its share of the records
wherever they are; only rows with the same id and the same lower corner stay together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuboid.functions import geometry as G

#: The extent is scaled to so many bits; an axis has what is left of 63 for boxes outside, 32 in all at most.
BITS = 16
#: Axes in the key: more would leave each with few bits.
KEY_AXES = 3


def _scaled(i: int, low: float, high: float, bits: int) -> Column:
    """The box's centre on an axis as a number of ``bits`` bits, the extent's low end in the middle; boxes without points are at 0."""
    centre = (F.col(f"min_{i}").cast("double") + F.col(f"max_{i}").cast("double")) / 2
    half, width = float(1 << (bits - 1)), high - low if high > low else 1.0
    place = F.floor(F.least(F.lit(half - 1), F.greatest(F.lit(-half), (centre - low) / width * ((1 << BITS) - 1))))
    return (place + F.lit(int(half))).cast("long")


def z_key(extent: list[tuple[float, float]]) -> Column:
    """Interleaved bits of the scaled centres, as expressions that Spark compiles."""
    axes = extent[:KEY_AXES]
    bits = min(32, 63 // len(axes))
    places = [_scaled(i, low, high, bits) for i, (low, high) in enumerate(axes)]
    if len(places) == 1:
        return places[0]
    terms = [F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")), b * len(axes) + i) for i, x in enumerate(places) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def extent_of(records: DataFrame) -> list[tuple[float, float]]:
    """(low, high) of each axis over records that have points."""
    dims = G.dims_of(records.columns)
    row = records.where(~G.is_empty(G.bounds(dims))).agg(*G.union_agg(dims)).first()
    return [(row[f"min_{i}"] or 0.0, row[f"max_{i}"] or 0.0) for i in range(dims)]


def clustered(records: DataFrame, files: int | None, extent: list[tuple[float, float]] | None = None) -> DataFrame:
    """Records ranged and sorted by the key: one exchange.  Without a number of files adaptive execution sizes them."""
    key = z_key(extent or extent_of(records))
    keyed = records.withColumn("__z", key)
    ties = [F.col(f"min_{i}") for i in range(G.dims_of(records.columns))] + [F.xxhash64("row_id")] * ("row_id" in records.columns)
    ranged = keyed.repartitionByRange("__z", *ties) if files is None else keyed.repartitionByRange(files, "__z", *ties)
    return ranged.sortWithinPartitions("__z").drop("__z")


def zone_map(stored: DataFrame) -> DataFrame:
    """(path, n, min_0, max_0, ...) of each file of a stored table."""
    dims = G.dims_of(stored.columns)
    return stored.select(F.col("_metadata.file_path").alias("path"), *G.bound_names(dims)).groupBy("path").agg(F.count("*").alias("n"), *G.union_agg(dims))


def tile_map(records: DataFrame, axis: int, width: float) -> DataFrame:
    """(tile, n, bounds) by the lower bound's tile on one axis."""
    tile = F.floor(F.col(f"min_{axis}").cast("double") / width).cast("long")
    return records.groupBy(tile.alias("tile")).agg(F.count("*").alias("n"), *G.union_agg(G.dims_of(records.columns)))
