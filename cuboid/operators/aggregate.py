"""Reductions over boxes and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuboid.functions import geometry as G


def extent(records: DataFrame) -> DataFrame:
    """The box of all records, one row."""
    return records.agg(*G.union_agg(G.dims_of(records.columns)))


def union_by(records: DataFrame, *keys: str | Column) -> DataFrame:
    """The box of each group, with its number of records."""
    return records.groupBy(*keys).agg(F.count("*").alias("n"), *G.union_agg(G.dims_of(records.columns)))


def order_statistics(df: DataFrame, key: str, value: str, shares: Sequence[float], slack: float = 0.002) -> DataFrame:
    """(key, share, v): for each group and share p the value at place floor(p * (n - 1)) of its sorted values, exactly.

    No group is sorted as a whole.  A mergeable sketch brackets each place; rows below a bracket are
    counted, and only rows inside it are ranked.  A bracket that turns out to miss its place is the
    whole group's range.  Null values don't count.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    steps = sorted({min(1.0, max(0.0, p + d)) for p in shares for d in (-slack, slack)})
    sketch = F.percentile_approx("v", steps, 20_000)
    n_by = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), sketch.alias("q"))
    wanted = []
    for p in shares:
        a, b = (steps.index(min(1.0, max(0.0, p + d))) for d in (-slack, slack))
        wanted.append(F.struct(F.lit(float(p)).alias("share"), F.floor(F.lit(float(p)) * (F.col("n") - 1)).cast("long").alias("place"), F.col("q")[a].alias("a"), F.col("q")[b].alias("b")))
    brackets = n_by.select("k", "low", "high", F.explode(F.array(*wanted)).alias("w")).select("k", "low", "high", "w.*")
    # Few groups or many: the optimizer broadcasts the brackets only if their size allows.
    near = rows.join(brackets.withColumnRenamed("k", "g"), F.col("k").eqNullSafe(F.col("g")))
    counted = near.groupBy(F.col("k").alias("g"), F.col("share").alias("s")).agg(F.sum((F.col("v") < F.col("a")).cast("long")).alias("below"), F.sum((F.col("v") <= F.col("b")).cast("long")).alias("upto"))
    checked = brackets.join(counted, F.col("k").eqNullSafe(F.col("g")) & (F.col("share") == F.col("s")))
    good = (F.col("below") <= F.col("place")) & (F.col("place") < F.col("upto"))
    final = checked.select("g", "share", "place", F.when(good, F.col("a")).otherwise(F.col("low")).alias("a"), F.when(good, F.col("b")).otherwise(F.col("high")).alias("b"), F.when(good, F.col("below")).otherwise(F.lit(0)).alias("below"))
    # Equal values are one row with their number, before anything is ranked.
    inside = rows.join(final, F.col("k").eqNullSafe(F.col("g")) & (F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b")))
    values = inside.groupBy("k", "share", "place", "below", "v").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy("k", "share").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("upto", F.col("below") + upto)
    hit = ranked.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("times") <= F.col("place")))
    return hit.select(F.col("k").alias(key), "share", "v")


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per group: count, sum, min, max, mean, p50, p95, p99 of a value."""
    v = F.col(value).cast("double")
    base = df.groupBy(key).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))
    places = order_statistics(df, key, value, (0.5, 0.95, 0.99)).groupBy(key).agg(*(F.max(F.when(F.col("share") == p, F.col("v"))).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))
    return base.join(places.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")


def smoothed(df: DataFrame, key: str, bucket: Column, share: float) -> DataFrame:
    """(key, rate): the number of rows in a bucket, exponentially smoothed over each key's buckets in their order, at the last one.

    Only the counts of buckets meet in a task, not the rows; buckets without rows don't count.
    """
    counts = df.groupBy(F.col(key), bucket.alias("__b")).agg(F.count("*").cast("double").alias("__n"))
    inorder = F.array_sort(F.collect_list(F.struct("__b", "__n")))
    step = lambda rate, x: rate + F.lit(share) * (x["__n"] - rate)
    return counts.groupBy(key).agg(inorder.alias("__x")).select(key, F.aggregate("__x", F.lit(0.0), step).alias("rate"))
