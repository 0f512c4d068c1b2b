"""Epoch tables, the catalog, layout, ordering keys and streaming ingest."""

import random

import pytest
from pyspark import StorageLevel

from cuboid.functions.geometry import Box
from cuboid.functions.ordering import float_to_sortable, natural_text, sortable_to_float
from cuboid.plans import layout
from cuboid.sources.catalog import Registry, State, cache_policy
from cuboid.sources.records import records, records_from_points
from cuboid.sources.table import IndexTable, feature_table, geo_table
from cuboid.streaming.ingest import ingest

ALL = Box((-1e6, -1e6), (1e6, 1e6))


def grid(spark, low, high):
    return records(spark, [(str(i), [(i % 100, i // 100)]) for i in range(low, high)], 2).drop("points")


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


def test_commit_reopen_and_epochs(spark, tmp_path):
    table = IndexTable.create(spark, str(tmp_path / "t"), 2)
    assert table.epoch == 0 and table.count() == 0 and table.query(ALL).count() == 0
    for at in range(0, 300, 100):
        assert table.append(grid(spark, at, at + 100), files=2) == at // 100 + 1
    assert table.append(grid(spark, 0, 0)) == 3  # no rows, no epoch
    again = IndexTable.open(spark, str(tmp_path / "t"))
    assert again.epoch == 3 and again.count() == 300 and again.query(ALL).count() == 300
    assert again.read(epoch=1).count() == 100
    assert ids(again.query(Box((5, 1), (6, 2)))) == ["105", "106", "205", "206"]
    assert again.extent() == [(0, 99), (0, 2)] and again.validate() == 0
    assert again.stats()["parts"] == 3 and again.stats()["bytes"] > 0


def test_the_same_id_may_stand_twice(spark, tmp_path):
    table = IndexTable.create(spark, str(tmp_path / "t"), 2)
    table.append(grid(spark, 0, 5))
    table.append(grid(spark, 0, 5))
    assert table.query(ALL).count() == 10


def test_a_reader_keeps_its_state(spark, tmp_path):
    table = IndexTable.create(spark, str(tmp_path / "t"), 2)
    table.append(grid(spark, 0, 10))
    reader = IndexTable.open(spark, str(tmp_path / "t"))
    table.append(grid(spark, 10, 20))
    assert reader.query(ALL).count() == 10
    assert reader.refresh().query(ALL).count() == 20


def test_read_only_sees_checkpoints_and_refuses_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    table = IndexTable.create(spark, path, 2)
    with pytest.raises(FileNotFoundError):
        IndexTable.open(spark, path, read_only=True)
    table.append(grid(spark, 0, 10))
    table.checkpoint()
    table.append(grid(spark, 10, 20))
    reader = IndexTable.open(spark, path, read_only=True)
    assert reader.query(ALL).count() == 10
    for write in (lambda: reader.append(grid(spark, 0, 1)), reader.checkpoint, reader.compact, reader.vacuum, reader.purge):
        with pytest.raises(PermissionError):
            write()


def test_two_writers_can_not_take_one_epoch(spark, tmp_path):
    path = str(tmp_path / "t")
    a = IndexTable.create(spark, path, 2)
    b = IndexTable.open(spark, path)
    a.append(grid(spark, 0, 5))
    b._held = b._held | {"epoch": 0}
    with pytest.raises(RuntimeError):
        b._commit(b._held["parts"])
    assert b.append(grid(spark, 5, 9)) == 2 and b.count() == 9


def test_batches_commit_once(spark, tmp_path):
    table = IndexTable.create(spark, str(tmp_path / "t"), 2)
    assert table.append(grid(spark, 0, 5), batch="s:0") == 1
    assert table.append(grid(spark, 0, 5), batch="s:0") == 1
    assert table.count() == 5


def test_compact_and_vacuum(spark, tmp_path):
    table = IndexTable.create(spark, str(tmp_path / "t"), 2)
    for at in range(0, 40, 10):
        table.append(grid(spark, at, at + 10), files=1)
    before = ids(table.query(ALL))
    table.checkpoint()
    table.compact(files=2)
    assert ids(table.query(ALL)) == before and table.stats()["parts"] == 1
    assert table.vacuum() == 0  # the checkpoint still needs its parts
    table.checkpoint()
    assert table.vacuum() == 4
    assert ids(IndexTable.open(spark, str(tmp_path / "t"), read_only=True).query(ALL)) == before


def test_errors(spark, tmp_path):
    table = geo_table(spark, str(tmp_path / "t"))
    assert table.dimension("latitude") == 1
    with pytest.raises(KeyError):
        table.dimension("height")
    for wrong in (lambda: IndexTable.create(spark, str(tmp_path / "t"), 3), lambda: table.query(Box((1,))), lambda: IndexTable.create(spark, str(tmp_path / "u"), 2, durability="NEVER"), lambda: IndexTable.create(spark, str(tmp_path / "u"), 2, ("x",))):
        with pytest.raises(ValueError):
            wrong()
    table.purge()
    with pytest.raises(FileNotFoundError):
        IndexTable.open(spark, str(tmp_path / "t"))
    assert feature_table(spark, str(tmp_path / "f"), 8).labels[7] == "f7"


def test_clustering_narrows_the_files(spark, tmp_path):
    rng = random.Random(7)
    df = records(spark, [(str(i), [(rng.uniform(0, 100), rng.uniform(0, 100))]) for i in range(2000)], 2).drop("points")
    df.repartition(8).write.parquet(str(tmp_path / "a"))
    layout.clustered(df, 8).write.parquet(str(tmp_path / "b"))
    hit = []
    for name in "ab":
        zones = layout.zone_map(spark.read.parquet(str(tmp_path / name)))
        assert zones.agg({"n": "sum"}).first()[0] == 2000
        hit.append(zones.where("min_0 <= 20 AND max_0 >= 10 AND min_1 <= 20 AND max_1 >= 10").count())
    assert hit[1] < hit[0]


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_records_outside_the_extent_are_ranged_too(spark, dims):
    """All lie above the extent that scales the key, as those of a table's next batch may."""
    far = records_from_points(spark.range(4000).selectExpr("id", "40.0 + id % 50 AS x", "40.0 + id div 50 AS y"), "id", ["x", "y", "x", "y"][:dims])
    laid = layout.clustered(far, 8, [(0.0, 15.0)] * dims).selectExpr("*", "spark_partition_id() AS p").groupBy("p").agg({"*": "count", "min_0": "min", "max_0": "max"}).collect()
    assert len(laid) == 8 and max(r["count(1)"] for r in laid) <= 1000
    assert min(r["max(max_0)"] - r["min(min_0)"] for r in laid) < 25


def test_a_later_batch_is_dealt_to_all_files(spark, tmp_path):
    """As of durability_policies: a first batch of small values, then one of large ones, of few distinct values."""
    table = IndexTable.create(spark, str(tmp_path / "t"), 1, durability="STRICT")
    points = records_from_points(spark.range(6000).selectExpr("id", "double(1 + id % 50) AS x"), "id", ["x"])
    table.append(points.where("min_0 <= 15"), files=8, batch="a")
    table.append(points.where("min_0 > 15"), files=8, batch="b")
    second = [r["n"] for r in table.zone_map().collect() if r["min_0"] > 15]
    assert sum(second) == 4200 and len(second) == 8 and max(second) <= 1050


def test_records_of_one_place_are_dealt_to_all_files(spark):
    same = records_from_points(spark.range(4000).selectExpr("id", "7.0 AS x", "8.0 AS y"), "id", ["x", "y"])
    laid = layout.clustered(same, 8).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(laid) == 8 and max(r["count"] for r in laid) <= 1000


def test_registry(spark, tmp_path):
    for name in ("geo", "time", "features"):
        IndexTable.create(spark, str(tmp_path / name), 2).append(grid(spark, 0, 10))
    now, events = [0.0], []
    registry = Registry(spark, StorageLevel.MEMORY_ONLY, lambda n: events.append(("+", n)), lambda n: events.append(("-", n)), lambda: now[0])
    assert registry.register_folder(str(tmp_path)) == 3 and not registry.register("geo", "x")
    assert registry.get("none") is None and registry.state("none") is None and registry.metadata("none") is None
    assert registry.state("geo") is State.REGISTERED and registry.loaded() == []
    geo = registry.get("geo")
    assert registry.get("geo") is geo and registry.state("geo") is State.LOADED and registry.metadata("geo")["dims"] == 2
    now[0] = 10
    registry.get("time")
    assert sorted(registry.loaded()) == ["geo", "time"] and registry.memory() > 0
    assert registry.frame("time").count() == 10
    assert registry.unload_idle(5) == 1 and registry.loaded() == ["time"]
    registry.get("geo")
    assert registry.unload_cold(1) > 0 and len(registry.loaded()) == 1
    assert registry.remove("geo") and not registry.remove("geo")
    registry.reset()
    assert registry.names() == [] and ("+", "geo") in events and ("-", "geo") in events


def test_a_missing_table_fails_to_load(spark, tmp_path):
    registry = Registry(spark)
    registry.register("gone", str(tmp_path / "gone"))
    with pytest.raises(FileNotFoundError):
        registry.get("gone")
    assert registry.state("gone") is State.FAILED


def test_cache_policies():
    assert cache_policy("512MB")[1] == 512 << 20 and cache_policy("25%")[2] == 0.25
    assert cache_policy("bulk")[0] == StorageLevel.DISK_ONLY and cache_policy("minimal") == (None, None, None)
    assert cache_policy("other") is None and cache_policy("x%") is None and cache_policy("500%") is None


def test_sortable_floats(spark):
    values = [float("-inf"), -1e30, -1.5, -1e-40, -0.0, 0.0, 1e-40, 1.5, 1e30, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, v double").selectExpr("i", "cast(v as float) v")
    got = df.select("i", "v", float_to_sortable("v").alias("s")).select("i", "v", "s", sortable_to_float("s").alias("b")).orderBy("i").collect()
    keys = [r["s"] for r in got[:-1]]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert all(str(r["b"]) == str(r["v"]) for r in got)


def test_natural_order():
    names = ["a1", "a 2", "a10", "a 10 b", "b05", "b5", "b50", "c"]
    assert sorted(names, key=natural_text) == names
    assert natural_text("A1", True) == natural_text("a1")


def test_stream_into_a_table(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(50).selectExpr("id", "cast(id as double) x").repartition(3).write.parquet(source)
    stream = records_from_points(spark.readStream.schema("id long, x double").option("maxFilesPerTrigger", 1).parquet(source), "id", ["x"])
    table = IndexTable.create(spark, str(tmp_path / "t"), 1)
    for _ in range(2):  # the second run finds nothing new
        ingest(stream, table, str(tmp_path / "c"), available_now=True).awaitTermination()
    assert table.refresh().epoch == 3 and table.query(Box((10,), (19,))).count() == 10
