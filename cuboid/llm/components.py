"""Connected components over a distributed table of links, by alternating large and small stars.

No link ever reaches the driver; it only learns whether a round changed anything.  Minima are taken
map-side first.  Rows of a hub aren't gathered: ``spread_join`` brings the hub's row to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm.common import checkpointed

#: A key with more rows than this, and than one in HUBS of all, is a hub; so at most HUBS rows are broadcast.
LEAST, HUBS = 256, 50_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``n`` the number of rows that have it; of ``total`` rows in all.

    Keys of many rows are few: their part of the table is broadcast and their rows stay where they are.
    """
    most = max(LEAST, total // HUBS)
    hubs = table.where(F.col(n) > most).drop(n)
    own = F.broadcast(hubs.select(key))
    light = rows.join(own, key, "left_anti").join(table.where(F.col(n) <= most).drop(n), key)
    return rows.join(F.broadcast(hubs), key).unionByName(light)


def _minima(edges: DataFrame) -> DataFrame:
    """(u, m, n): the smallest of a node and its neighbours, and their number."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = spread_join(both, _minima(both), "u", "n", 2 * total)
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links go from the larger to the smaller node; each node and its smaller neighbours join the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = spread_join(down, _minima(down), "u", "n", total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node that it reaches, itself for a root.

    Null ends and loops are left out; an empty table gives an empty result.
    """
    clean = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = checkpointed(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state()
    while before[0]:
        # A node has fewer links behind the large star than there were in all.
        starred = checkpointed(_large_star(edges, before[0]))
        edges = checkpointed(_small_star(starred, before[0]).where("u <> v").distinct())
        now = state()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def named(groups: DataFrame, roots: DataFrame, node: str, least: str) -> DataFrame:
    """``groups`` with ``component_id``: the least value of column ``least`` among those of one root; ``roots`` as from ``components``."""
    joined = checkpointed(groups.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node)))
    ids = joined.groupBy("root").agg(F.min(least).alias("component_id"), F.count("*").alias("__n"))
    return spread_join(joined, ids, "root", "__n", joined.count()).drop("root")
