"""Places of rows in a total order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuboid.settings import shared_dir

_SHIFT = 33  # monotonically_increasing_id: the partition stands above the row's place in it


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 1, in the order; rows that are equal in it are placed arbitrarily.

    The rows are ranged into sorted partitions and written to the checkpoint folder, so that their
    partitions stay as they are; then the numbers of rows in the partitions before, one for each
    partition, are added to the place in the own one.
    """
    spark = df.sparkSession
    shared_dir(spark)
    placed = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__id", _SHIFT)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    table = spark.createDataFrame(offsets, "__p long, __before long")
    joined = placed.join(F.broadcast(table), part == F.col("__p"))
    return joined.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << _SHIFT) - 1) + 1).drop("__id", "__p", "__before")
