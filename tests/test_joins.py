"""Joins of boxes against nested loops, counts and order statistics against Python."""

import random

import pytest
from pyspark.sql import functions as F

from cuboid.functions import geometry as G
from cuboid.operators import aggregate, join


def boxes(spark, n, seed, wide=()):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice([0, 0.5, 1, 3, *wide])
        x, y = rng.uniform(-50, 50), rng.uniform(-5, 5)
        out.append((f"{seed}-{i}", x, x + w, y, y + rng.choice([0, 1])))
    out.append((f"{seed}-empty", G.FLOAT_MAX, -G.FLOAT_MAX, G.FLOAT_MAX, -G.FLOAT_MAX))
    return spark.createDataFrame(out, "row_id string, min_0 float, max_0 float, min_1 float, max_1 float")


TEST = {
    "intersects": lambda a, b: all(a[i] <= b[i + 1] and a[i + 1] >= b[i] for i in (1, 3)),
    "contains": lambda a, b: all(a[i] <= b[i] and a[i + 1] >= b[i + 1] for i in (1, 3)),
    "within": lambda a, b: all(b[i] <= a[i] and b[i + 1] >= a[i + 1] for i in (1, 3)),
}


@pytest.mark.parametrize("predicate", list(TEST))
@pytest.mark.parametrize("wide", [(), (40, 1e6)])
@pytest.mark.parametrize("axes", [1, 2])
def test_grid_join_is_the_nested_loop(spark, predicate, wide, axes):
    left, right = boxes(spark, 120, 1, wide), boxes(spark, 90, 2, wide)
    a, b = left.collect(), right.collect()
    want = sorted((x[0], y[0]) for x in a for y in b if "empty" not in x[0] + y[0] and TEST[predicate](x, y))
    for small in (0, 1000):
        got = sorted((r["row_id"], r["r_row_id"]) for r in join.box_join(left, right, predicate, axes=axes, small=small).collect())
        assert got == want
    ids = {x for x, _ in want}
    assert {r["row_id"] for r in join.box_join(left, right, predicate, "left_semi", small=0).collect()} == ids
    assert {r["row_id"] for r in join.box_join(left, right, predicate, "left_anti", small=0).collect()} == {x[0] for x in a} - ids


def test_semi_join_keeps_repeated_rows(spark):
    left = boxes(spark, 20, 3)
    twice = left.union(left)
    once = join.box_join(left, left, how="left_semi", small=0).count()
    assert once == 20 and join.box_join(twice, left, how="left_semi", small=0).count() == 40


def test_a_hot_cell_loses_nothing(spark):
    left = spark.range(3000).select(F.col("id").cast("string").alias("row_id"), *(F.lit(1.0).cast("float").alias(n) for n in G.bound_names(2)))
    right = left.limit(5)
    assert join.box_join(left, right, small=0).count() == 15000


def test_empty_sides(spark):
    left = boxes(spark, 10, 1)
    none = left.where("1 = 0")
    assert join.box_join(left, none, small=0).count() == 0
    assert join.box_join(none, left, small=0).count() == 0
    assert join.box_join(left, none, how="left_anti", small=0).count() == 11


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_no_side_is_broadcast_by_an_estimate(spark, how):
    # Ranges are known to be small, so that Spark would broadcast them, and what is made of them.
    side = spark.range(40).select(F.col("id").cast("string").alias("row_id"), *(F.col("id").cast("float").alias(n) for n in G.bound_names(2)))
    plan = join.box_join(side, side, how=how, small=0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_repeated_partners_are_dealt_once(spark):
    left, right = boxes(spark, 30, 9), boxes(spark, 30, 10)
    many = right.crossJoin(spark.range(50).select(F.col("id").alias("copy"))).drop("copy")
    for how in ("left_semi", "left_anti"):
        once, often = (join.box_join(left, x, how=how, small=0) for x in (right, many))
        assert sorted(r["row_id"] for r in once.collect()) == sorted(r["row_id"] for r in often.collect())


def test_counts_keep_queries_without_matches(spark):
    records, queries = boxes(spark, 200, 4), boxes(spark, 30, 5).withColumnRenamed("row_id", "qid")
    a, b = records.collect(), queries.collect()
    want = {q[0]: sum("empty" not in r[0] + q[0] and TEST["intersects"](r, q) for r in a) for q in b}
    assert {r["qid"]: r["n"] for r in join.batch_query_counts(records, queries, small=0).collect()} == want


@pytest.mark.parametrize("slack", [0.002, 0.0])
def test_order_statistics(spark, slack):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(40)), rng.random()])) for _ in range(3000)] + [("one", 5.0), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["share"]): r["v"] for r in aggregate.order_statistics(df, "g", "v", (0.0, 0.5, 0.95, 1.0), slack).collect()}
    for g in ("a", "b", None, "one"):
        own = sorted(v for x, v in rows if x == g and v is not None)
        for p in (0.0, 0.5, 0.95, 1.0):
            assert got[g, p] == own[int(p * (len(own) - 1))]
    assert ("null", 0.5) not in got


def test_ranks(spark):
    from cuboid.operators.ranking import ranked

    rng = random.Random(8)
    rows = [(rng.random(), i) for i in range(2000)]
    got = {r["i"]: r["rank"] for r in ranked(spark.createDataFrame(rows, "v double, i long").repartition(7), "v").collect()}
    assert got == {i: k + 1 for k, (_, i) in enumerate(sorted(rows))}
    assert ranked(spark.createDataFrame([], "v double"), "v").count() == 0
