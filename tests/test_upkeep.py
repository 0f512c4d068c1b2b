"""Safety and upkeep of tables, the catalog's file and budget, metrics, settings and checksums."""

import threading
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from cuboid import settings
from cuboid.functions import checksums
from cuboid.functions import geometry as G
from cuboid.functions.geometry import Box
from cuboid.functions.ordering import natural_key, natural_key_nocase, natural_text
from cuboid.metrics import Metrics
from cuboid.sources.catalog import CachePolicy, Registry
from cuboid.sources.files import Store, TornFile
from cuboid.sources.records import records
from cuboid.sources.table import IndexTable
from cuboid.sources.upkeep import Policy, Rate, Upkeep


def grid(spark, low, high):
    return records(spark, [(str(i), [(i % 100, i // 100)]) for i in range(low, high)], 2).drop("points")


def table(spark, tmp_path, commits=2):
    t = IndexTable.create(spark, str(tmp_path / "t"), 2)
    for k in range(commits):
        t.append(grid(spark, 10 * k, 10 * k + 10), files=1)
    return t


def test_publish_is_create_if_absent(spark, tmp_path):
    store, won = Store(spark, str(tmp_path / "s")), []
    store.publish("other.json", {})
    racers = [threading.Thread(target=lambda i=i: won.append(store.publish("a.json", {"i": i}))) for i in range(8)]
    for r in racers:
        r.start()
    for r in racers:
        r.join()
    assert sorted(won) == [False] * 7 + [True] and store.names("") == ["a.json", "other.json"]


def test_torn_files_are_told(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n, body in enumerate(("", '{"a": 1', '[1]', '{"a": 1, "crc": 5}')):
        (tmp_path / f"{n}.json").write_text(body)
        with pytest.raises(TornFile):
            store.read(f"{n}.json")


def test_a_torn_manifest_is_passed_over_and_written_above(spark, tmp_path):
    t = table(spark, tmp_path)
    (tmp_path / "t/manifests/000000002.json").write_text('{"epoch": 2')
    again = IndexTable.open(spark, t.path)
    assert again.epoch == 1 and again.count() == 10
    assert again.append(grid(spark, 50, 60)) == 3 and IndexTable.open(spark, t.path).count() == 20
    for n in (1, 3):
        (tmp_path / f"t/manifests/00000000{n}.json").write_text("")
    (tmp_path / "t/manifests/000000000.json").write_text("")
    with pytest.raises(TornFile):
        IndexTable.open(spark, t.path)


def test_columns_widen_and_keep_their_types(spark, tmp_path):
    t = IndexTable.create(spark, str(tmp_path / "t"), 2)
    plain = grid(spark, 0, 5)
    t.append(plain)
    t.append(plain.withColumn("k", F.lit("x")))
    t.append(plain)
    assert t.read().columns[-1] == "k" and t.read().where("k = 'x'").count() == 5 and t.count() == 15
    assert t.read(epoch=1).columns == plain.columns
    with pytest.raises(ValueError):
        t.append(plain.withColumn("k", F.lit(1)))
    t.compact()
    assert IndexTable.open(spark, t.path).read().where("k IS NULL").count() == 10


def test_vacuum_leaves_what_is_staged(spark, tmp_path):
    now = [1000.0]
    t = table(spark, tmp_path)
    t.clock = lambda: now[0]
    store = Store(spark, t.path)
    grid(spark, 90, 95).write.parquet(f"{t.path}/data/epoch=3-abc")
    store.publish("staged/x.json", {"part": "data/epoch=3-abc", "until": 2000.0})
    assert t.vacuum() == 0
    now[0] = 3000.0
    assert t.vacuum() == 1 and store.names("staged") == []


def test_vacuum_leaves_what_is_pinned(spark, tmp_path):
    t = table(spark, tmp_path)
    reader = IndexTable.open(spark, t.path)
    with reader.pin():
        t.append(grid(spark, 50, 60))
        t.compact()
        assert t.vacuum() == 1 and t.min_active_epoch() == 2 and reader.read().count() == 20  # only the third epoch's part goes
    assert t.vacuum() == 2 and t.min_active_epoch() == t.epoch


def test_only_small_parts_are_merged(spark, tmp_path):
    t = table(spark, tmp_path, 3)
    sizes = sorted(p["bytes"] for p in t._held["parts"])
    t.append(grid(spark, 100, 3000), files=1)
    t.compact(below=sizes[-1] + 1)
    assert t.stats()["parts"] == 2 and t.count() == 2930 and t.validate() == 0


def test_when_a_checkpoint_is_due(spark, tmp_path):
    now = [0.0]
    t = table(spark, tmp_path, 1)
    t.checkpoint()
    u = Upkeep(t, Policy(most_bytes=10**9, compact_parts=99), clock=lambda: now[0])
    assert not u.due()
    t.append(grid(spark, 20, 30), files=1)
    u.committed()
    assert not u.due() and t.checkpoints() == [1]
    now[0] = 46
    assert u.due()
    u.checkpoint()
    assert t.checkpoints() == [1, 2] and not u.due()
    u = Upkeep(t, Policy(most_bytes=1, compact_parts=99), clock=lambda: now[0])
    t.append(grid(spark, 30, 40), files=1)
    u.committed()
    assert t.checkpoints() == [2, 3]


def test_a_fast_stream_has_a_smaller_threshold(spark, tmp_path):
    now = [0.0]
    u = Upkeep(table(spark, tmp_path, 1), Policy(fast_rate=100), clock=lambda: now[0])
    assert u.threshold() == u.policy.most_bytes
    u.rate.add(100_000)
    now[0] = 2
    u.rate.add(0)
    assert u.rate.value == pytest.approx(0.2 * 50_000) and u.threshold() == u.policy.fast_bytes
    rate = Rate(0.5, lambda: now[0])
    rate.add(10)
    now[0] = 2.5
    rate.add(10)
    assert rate.value == 0
    now[0] = 4
    rate.add(0)
    assert rate.value == 5


def test_nodes_and_visits(spark, tmp_path):
    t = table(spark, tmp_path)
    by = {order: [(r["level"], r["n"]) for r in t.nodes(order).orderBy("place").collect()] for order in ("breadth", "depth")}
    assert by == {"breadth": [(0, 20), (1, 10), (1, 10), (2, 10), (2, 10)], "depth": [(0, 20), (1, 10), (2, 10), (1, 10), (2, 10)]}
    with pytest.raises(ValueError):
        t.nodes("sideways")
    seen = t.visit(lambda batches: (b[["row_id"]] for b in batches), "row_id string", Box((3, 0), (5, 9)))
    assert sorted(r["row_id"] for r in seen.collect()) == ["3", "4", "5"]


def test_catalog_file_and_budget(spark, tmp_path):
    for name in "abc":
        IndexTable.create(spark, str(tmp_path / name), 2).append(grid(spark, 0, 10))
    now = [0.0]

    class Two(CachePolicy):
        def budget(self, spark):
            return int(2.5 * registry.metadata("a")["bytes"])

    registry = Registry(spark, policy=Two(), clock=lambda: now[0])
    assert registry.register_folder(str(tmp_path)) == 3
    for name in "abc":
        now[0] += 1
        registry.get(name)
    assert sorted(registry.loaded()) == ["b", "c"] or registry.metadata("a")["bytes"] == 0
    assert registry.save(str(tmp_path / "roots_")) == 1 and registry.save(str(tmp_path / "roots_")) == 2
    other = Registry(spark)
    with pytest.raises(FileNotFoundError):
        other.load(str(tmp_path / "none"))
    assert other.load(str(tmp_path / "roots_")) == 3 and other.get("b").count() == 10 and other.load(str(tmp_path / "roots_")) == 0
    with pytest.raises(ValueError):
        Registry(spark, policy="nonsense")
    assert Registry(spark, policy="25%")._policy.budget(spark) > 1 << 20


def test_metrics():
    m, seen = Metrics(), []
    m.counter("c").add()
    m.counter("c").add(2)
    m.gauge("g").set(4)
    for v in range(101):
        m.histogram("h").observe(v)
    m.on_export(seen.append)
    got = m.export()
    assert seen == [got] and got["c"] == 3 and got["g"] == 4 and got["h"]["p95"] == 95 and got["h"]["mean"] == 50
    with pytest.raises(ValueError):
        m.gauge("c")


def test_settings(spark, monkeypatch, tmp_path):
    assert settings.size("1.5 GB") == 3 << 29 and settings.size("10") == 10
    for wrong in ("", "x", "5 parsecs"):
        with pytest.raises(ValueError):
            settings.size(wrong)
    monkeypatch.setenv("CUBOID_COMPACT_PARTS", "7")
    assert settings.setting("compact_parts", spark) == 7 and Policy.of(spark).compact_parts == 7
    monkeypatch.setenv("CUBOID_WORKLOAD", "query")
    assert settings.memory_conf(spark) == {"spark.memory.storageFraction": "0.6"}
    monkeypatch.setenv("CUBOID_LOG_FILE", str(tmp_path / "log"))
    monkeypatch.setenv("CUBOID_LOG_LEVEL", "INFO")
    settings.start_log(spark).info("said")
    assert "said" in (tmp_path / "log").read_text()
    settings.log.handlers.clear()


def test_checksums(spark):
    texts = ["123456789", "", "é", "a" * 300, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    x = F.col("x")
    rows = df.select("i", checksums.adler32(x).alias("a"), F.hex(checksums.crc32c(x)).alias("c"), F.hex(checksums.crc64(x)).alias("d"), checksums.xxh64(x).alias("h")).orderBy("i").collect()
    for t, r in zip(texts[:4], rows):
        assert r["a"] == zlib.adler32(t.encode()) and int(r["h"]) == xxhash.xxh64_intdigest(t.encode())
    assert (rows[0]["c"], rows[0]["d"]) == ("E3069283", "995DC9BBDF1939FA") and tuple(rows[4])[1:] == (None,) * 4


def test_natural_key_sorts_as_the_text(spark):
    names = ["a1", "a 2", "a10", "a 10 b", "b05", "b5", "b50", "c", "", "9", "10", "x007y", "x7y", "B6"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    got = [r["n"] for r in df.where("n IS NOT NULL").orderBy(natural_key("n"), "n").collect()]
    assert got == sorted(names, key=lambda n: (natural_text(n), n))
    got = [r["n"] for r in df.where("n IS NOT NULL").orderBy(natural_key_nocase("n"), "n").collect()]
    assert got == sorted(names, key=lambda n: (natural_text(n, True), n))
    assert df.where("n IS NULL").select(natural_key("n").alias("k")).first()["k"] is None


def test_overlap_enlargement_refuses_unknown_modes():
    with pytest.raises(ValueError):
        G.overlap_enlargement(G.bounds(2), G.bounds(2), [], "other")
