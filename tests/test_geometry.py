"""Predicates and measures of boxes, with cases by hand and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cuboid.functions import geometry as G
from cuboid.functions.geometry import Box
from cuboid.operators import aggregate, query
from cuboid.sources.records import records


def rows(spark, *boxes):
    """Records r0, r1, ... with two corner points each."""
    return records(spark, [(f"r{i}", [lo, hi]) for i, (lo, hi) in enumerate(boxes)], len(boxes[0][0]))


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


@pytest.mark.parametrize(
    "lo, hi, expected",
    [
        ((20, 20), (30, 30), []),
        ((5, 5), (15, 15), ["r0"]),
        ((10, 0), (20, 10), ["r0"]),  # touching edges count
        ((10, 10), (10, 10), ["r0"]),  # and touching corners
        ((10.001, 0), (20, 10), []),
        ((5, 5), (5, 5), ["r0"]),
    ],
)
def test_intersects(spark, lo, hi, expected):
    assert ids(query.range_query(rows(spark, ((0, 0), (10, 10))), Box(lo, hi))) == expected


def test_predicates_take_the_records_side(spark):
    df = rows(spark, ((0, 0), (10, 10)), ((2, 2), (3, 3)), ((-5, -5), (50, 50)))
    assert ids(query.range_query(df, Box((1, 1), (4, 4)), "contains")) == ["r0", "r2"]
    assert ids(query.range_query(df, Box((0, 0), (10, 10)), "within")) == ["r0", "r1"]
    assert ids(query.range_query(df, Box((2, 2), (3, 3)), "equals")) == ["r1"]
    with pytest.raises(ValueError):
        query.range_query(df, Box((0, 0), (1, 1)), "near")


def test_three_dimensions(spark):
    df = rows(spark, ((0, 0, 0), (10, 10, 10)))
    assert ids(query.range_query(df, Box((0, 0, 11), (10, 10, 12)))) == []
    assert ids(query.range_query(df, Box((0, 0, 10), (10, 10, 12)))) == ["r0"]
    with pytest.raises(ValueError):
        query.range_query(df, Box((0, 0), (1, 1)))


def test_matching_is_on_the_box_not_on_its_points(spark):
    route = records(spark, [("route", [(0, 0), (10, 10)])], 2)
    assert ids(query.range_query(route, Box((4, 1), (6, 2)))) == ["route"]


def test_bounds_grow_with_points(spark):
    r = records(spark, [("a", [(1, 1), (5, 2), (3, 6), (-1, 4)])], 2).first()
    assert (r["min_0"], r["max_0"], r["min_1"], r["max_1"]) == (-1, 5, 1, 6)
    assert r["points"] == [[1, 1], [5, 2], [3, 6], [-1, 4]]


def test_records_without_points(spark):
    df = records(spark, [("none", []), ("one", [(1, 1)])], 2)
    everything = Box((-1e30, -1e30), (1e30, 1e30))
    for name in ("intersects", "contains", "within"):
        assert "none" not in ids(query.range_query(df, everything, name))
    assert ids(query.full_scan(df)) == ["one"]
    b = G.bounds(2)
    r = df.where("row_id = 'none'").select(G.area(b).alias("a"), G.margin(b).alias("m")).first()
    assert (r["a"], r["m"]) == (0.0, 0.0)
    e = aggregate.extent(df).first()
    assert (e["min_0"], e["max_1"]) == (1, 1)


def test_coordinates_are_float32(spark):
    df = records(spark, [("a", [(23.46, 0.1)])], 2)
    assert ids(query.point_query(df, (23.46, 0.1))) == ["a"]
    assert ids(query.range_query(records(spark, [("a", [(16777217.0, 0)])], 2), Box((16777216, 0)))) == ["a"]


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf"), 1e39])
def test_coordinates_without_order_are_refused(spark, bad):
    with pytest.raises(ValueError):
        Box((bad, 0))
    with pytest.raises(Exception, match="coordinate"):
        records(spark, [("a", [(bad, 0.0)])], 2).collect()


def test_bad_boxes():
    for args in (((1, 2), (0, 3)), ((1,), (1, 2)), ((), ())):
        with pytest.raises(ValueError):
            Box(*args)


def test_negative_zero(spark):
    assert ids(query.point_query(records(spark, [("a", [(-0.0, 0.0)])], 2), (0.0, -0.0))) == ["a"]


def test_measures_against_python(spark):
    rng = random.Random(42)
    draw = lambda: sorted(rng.choice([0, 1, 2, 5, 7]) for _ in range(2))
    boxes = [tuple(zip(draw(), draw())) for _ in range(60)]
    df = rows(spark, *boxes)
    q = ((1, 1), (5, 4))
    a, b = G.bounds(2), Box(*q).bounds()
    got = df.select("row_id", G.area(a).alias("area"), G.margin(a).alias("margin"), G.overlap(a, b).alias("overlap"), G.percent_overlap(a, b).alias("share"), G.enlargement(a, b).alias("more"), G.enlargement(a, b, "compat").alias("compat"), G.is_point(a).alias("point")).collect()
    for r in got:
        lo, hi = boxes[int(r["row_id"][1:])]
        side = [h - x for x, h in zip(lo, hi)]
        wide = [max(h, y) - min(x, z) for x, h, z, y in zip(lo, hi, *q)]
        shared = 1
        for x, h, z, y in zip(lo, hi, *q):
            shared *= max(0, min(h, y) - max(x, z))
        assert (r["area"], r["margin"], r["overlap"]) == (side[0] * side[1], sum(side), shared)
        assert r["share"] == (0 if shared == 0 else 2 * shared / (side[0] * side[1] + 12))
        assert r["more"] == wide[0] * wide[1] - side[0] * side[1]
        assert r["compat"] == (-1 if side[0] == 0 else wide[0] if side[1] == 0 else r["more"])
        assert r["point"] == (side == [0, 0])


def test_nested_boxes_find_no_less(spark):
    rng = random.Random(42)
    df = records(spark, [(str(i), [(rng.uniform(-1000, 1000), rng.uniform(-1000, 1000))]) for i in range(1000)], 2)
    found = [set(ids(query.range_query(df, Box((-w, -w), (w, w))))) for w in (1, 100, 500)]
    assert found[0] <= found[1] <= found[2]
    for name in ("contains", "within"):
        box = Box((-100, -100), (100, 100))
        assert set(ids(query.range_query(df, box, name))) <= set(ids(query.range_query(df, box)))


def test_grid_cells(spark):
    df = rows(spark, *(((10 * i, 10 * j), (10 * i + 9, 10 * j + 9)) for i in range(10) for j in range(10)))
    assert ids(query.range_query(df, Box((25, 25), (35, 35)))) == ["r22", "r23", "r32", "r33"]
    assert len(ids(query.full_scan(df))) == 100
    assert ids(query.range_query(df, Box((1000, 1000), (2000, 2000)))) == []


def test_text_and_order(spark):
    df = rows(spark, ((0, 1), (2, 3)), ((-1, 0), (9, 9)))
    assert df.where("row_id = 'r0'").select(G.to_text(G.bounds(2))).first()[0] == "[(0.0, 2.0) (1.0, 3.0)]"
    assert [r["row_id"] for r in query.order_by_axis(df, 0).collect()] == ["r1", "r0"]
    assert query.least_enlargement(df, Box((1, 1), (2, 2)), 1).first()["row_id"] == "r0"
    assert [r["row_id"] for r in query.page(df, ["row_id"], 1, 1).collect()] == ["r1"]
    assert sorted(r["row_id"] for r in query.iterate(df)) == ["r0", "r1"]


def test_pushdown_keeps_the_answer(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select((F.col("id") / 7).alias("x"), F.col("id").alias("k")).write.parquet(path)
    df = spark.read.parquet(path)
    box = Box((1.0 / 7 * 21,), (1.0 / 7 * 30,))
    found = query.points_in_box(df, ["x"], box)
    assert sorted(r["k"] for r in found.collect()) == list(range(21, 31))
    assert "GreaterThanOrEqual(x" in found._jdf.queryExecution().toString()
