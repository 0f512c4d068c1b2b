"""The registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.functions import checksums
from cuboid.functions import geometry as G
from cuboid.functions.geometry import Box
from cuboid.functions.ordering import float_to_sortable, natural_key, sortable_less, sortable_less_equal, sortable_to_float
from cuboid.operators import aggregate, join, query
from cuboid.operators.ranking import ranked
from cuboid.plans import layout
from cuboid.settings import shared_dir
from cuboid.sources import records as R
from cuboid.sources.catalog import Registry
from cuboid.sources.files import Store
from cuboid.sources.table import DURABILITY, IndexTable, time_table
from cuboid.sources.upkeep import Policy, Upkeep
from cuboid.streaming.ingest import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _registered(sql: str):
    """Registers a query by its function's name, with its SQL."""

    def keep(fn):
        _QUERIES[fn.__name__] = fn
        _SQL[fn.__name__] = sql
        return fn

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Lines as points, orders as boxes over their lines, and their SQL.

_AXES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber")


def _points(spark: SparkSession, sf_dir: str, dims: int = 2) -> DataFrame:
    return R.records_from_points(_table(spark, sf_dir, "lineitem"), _line_id(), _AXES[:dims])


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records_from_groups(_table(spark, sf_dir, "lineitem"), "l_orderkey", _AXES[:2])


_ID = "concat(l_orderkey, '-', l_linenumber)"
_ROWS = " (SELECT *, " + _ID + " AS row_id FROM lineitem) "
_OB = """(SELECT CAST(l_orderkey AS VARCHAR) AS row_id, CAST(min(l_quantity) AS FLOAT) AS min_0, CAST(max(l_quantity) AS FLOAT) AS max_0,
  CAST(min(l_extendedprice) AS FLOAT) AS min_1, CAST(max(l_extendedprice) AS FLOAT) AS max_1 FROM lineitem GROUP BY l_orderkey)"""


def _f(x: float | str) -> str:
    return f"CAST({x} AS FLOAT)"


def _between(column: str, lo: float, hi: float) -> str:
    return f"{_f(column)} BETWEEN {_f(lo)} AND {_f(hi)}"


_LO, _HI = (10.0, 20000.0, 0.02, 0.01), (20.0, 30000.0, 0.06, 0.05)
_NARROW = Box(_LO[:2], _HI[:2])


def _points_sql(dims: int) -> str:
    return f"SELECT row_id FROM {_ROWS} WHERE " + " AND ".join(_between(c, a, b) for c, a, b in zip(_AXES[:dims], _LO, _HI))


@_registered(_points_sql(2))
def range_points_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query.points_in_box(_table(spark, sf_dir, "lineitem"), _AXES[:2], _NARROW)
    return found.select(_line_id().alias("row_id"))


@_registered(_points_sql(3))
def range_points_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.points_in_box(_table(spark, sf_dir, "lineitem"), _AXES[:3], Box(_LO[:3], _HI[:3])).select(_line_id().alias("row_id"))


@_registered(_points_sql(4))
def range_points_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.points_in_box(_table(spark, sf_dir, "lineitem"), _AXES, Box(_LO, _HI)).select(_line_id().alias("row_id"))


_FROM_US, _TO_US = 1704412800000000, 1704844800000000  # five days


@_registered(f"SELECT event_id, epoch_us(ts) AS us FROM events WHERE epoch_us(ts) BETWEEN {_FROM_US} AND {_TO_US}")
def range_points_1d_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds as 64-bit numbers: float32 can't tell them apart.  The plain comparison of the column reaches the scan."""
    events = _table(spark, sf_dir, "events")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    stamp = lambda us: epoch + F.expr(f"INTERVAL '{us // 1_000_000}' SECOND")
    found = events.where((F.col("ts") >= stamp(_FROM_US)) & (F.col("ts") <= stamp(_TO_US)))
    return found.select("event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"))


_POINT = "(SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1)"


@_registered(f"SELECT row_id FROM {_ROWS}, {_POINT} WHERE {_f('l_quantity')} = {_f('q')} AND {_f('l_extendedprice')} = {_f('p')}")
def point_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first line stands."""
    first = _table(spark, sf_dir, "lineitem").orderBy("l_orderkey", "l_linenumber").first()
    there = Box((first["l_quantity"], first["l_extendedprice"]))
    return query.points_in_box(_table(spark, sf_dir, "lineitem"), _AXES[:2], there).select(_line_id().alias("row_id"))


@_registered(f"SELECT row_id FROM {_OB} WHERE min_0 <= {_f(20)} AND max_0 >= {_f(10)} AND min_1 <= {_f(30000)} AND max_1 >= {_f(20000)}")
def range_boxes_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.range_query(_boxes(spark, sf_dir), _NARROW).select("row_id")


@_registered(f"SELECT row_id FROM {_OB} WHERE min_0 <= {_f(20)} AND max_0 >= {_f(25)} AND min_1 <= {_f(30000)} AND max_1 >= {_f(40000)}")
def range_boxes_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.range_query(_boxes(spark, sf_dir), Box((20, 30000), (25, 40000)), "contains").select("row_id")


@_registered(f"SELECT row_id FROM {_OB} WHERE min_0 >= {_f(5)} AND max_0 <= {_f(45)} AND min_1 >= {_f(10000)} AND max_1 <= {_f(90000)}")
def range_boxes_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.range_query(_boxes(spark, sf_dir), Box((5, 10000), (45, 90000)), "within").select("row_id")


_EDGE = "(SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem WHERE l_quantity = 10)"


@_registered(f"SELECT row_id FROM {_ROWS}, {_EDGE} WHERE {_between('l_quantity', 10, 11)} AND {_f('l_extendedprice')} BETWEEN {_f('a')} AND {_f('b')}")
def range_edge_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box whose sides are values that records have."""
    row = _table(spark, sf_dir, "lineitem").where("l_quantity = 10").agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return query.points_in_box(_table(spark, sf_dir, "lineitem"), _AXES[:2], Box((10, row[0]), (11, row[1]))).select(_line_id().alias("row_id"))


@_registered(f"SELECT count(*) AS n FROM lineitem WHERE {_between('l_quantity', 1000, 2000)}")
def range_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.points_in_box(_table(spark, sf_dir, "lineitem"), _AXES[:2], Box((1000, 0), (2000, 1e6))).agg(F.count("*").alias("n"))


@_registered("SELECT count(*) AS n FROM lineitem")
def full_scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.full_scan(_points(spark, sf_dir)).agg(F.count("*").alias("n"))


@_registered(f"SELECT row_id, min_0 = max_0 AND min_1 = max_1 AS is_point FROM {_OB}")
def box_is_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("row_id", G.is_point(G.bounds(2)).alias("is_point"))


_FIRST = f"(SELECT min_0 AS a0, max_0 AS b0, min_1 AS a1, max_1 AS b1 FROM {_OB} ORDER BY CAST(row_id AS BIGINT) LIMIT 1)"


@_registered(f"SELECT row_id FROM {_OB}, {_FIRST} WHERE min_0 = a0 AND max_0 = b0 AND min_1 = a1 AND max_1 = b1")
def box_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    r = boxes.orderBy(F.col("row_id").cast("long")).first()
    return query.range_query(boxes, Box((r["min_0"], r["min_1"]), (r["max_0"], r["max_1"])), "equals").select("row_id")


_AREA = "CAST(max_0 - min_0 AS DOUBLE) * CAST(max_1 - min_1 AS DOUBLE)"


@_registered(f"SELECT row_id, {_AREA} AS area, CAST(max_0 - min_0 AS DOUBLE) + CAST(max_1 - min_1 AS DOUBLE) AS margin FROM {_OB}")
def box_area_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("row_id", G.area(G.bounds(2)).alias("area"), G.margin(G.bounds(2)).alias("margin"))


_SIDES = [f"greatest(CAST(0 AS DOUBLE), CAST(least(max_{i}, {_f(b)}) - greatest(min_{i}, {_f(a)}) AS DOUBLE))" for i, (a, b) in enumerate(zip(_LO[:2], _HI[:2]))]
_OVERLAP = " * ".join(_SIDES)


@_registered(f"SELECT row_id, {_OVERLAP} AS overlap FROM {_OB}")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("row_id", G.overlap(G.bounds(2), _NARROW.bounds()).alias("overlap"))


_OWN_AREA = f"CAST({_f(20)} - {_f(10)} AS DOUBLE) * CAST({_f(30000)} - {_f(20000)} AS DOUBLE)"


@_registered(f"SELECT row_id, CASE WHEN (min_0 = max_0 AND min_1 = max_1) OR {_OVERLAP} = 0 THEN 0.0 ELSE 2 * ({_OVERLAP}) / ({_AREA} + {_OWN_AREA}) END::DOUBLE AS share FROM {_OB}")
def box_percent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("row_id", G.percent_overlap(G.bounds(2), _NARROW.bounds()).alias("share"))


_WIDE = [f"CAST(greatest(max_{i}, {_f(b)}) - least(min_{i}, {_f(a)}) AS DOUBLE)" for i, (a, b) in enumerate(zip(_LO[:2], _HI[:2]))]


@_registered(
    f"SELECT row_id, {' * '.join(_WIDE)} - {_AREA} AS exact, CASE WHEN max_0 - min_0 = 0 THEN -1.0 WHEN max_1 - min_1 = 0 THEN {_WIDE[0]} ELSE {' * '.join(_WIDE)} - {_AREA} END::DOUBLE AS compat FROM {_OB}"
)
def box_enlargement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.bounds(2), _NARROW.bounds()
    return _boxes(spark, sf_dir).select("row_id", G.enlargement(a, b).alias("exact"), G.enlargement(a, b, "compat").alias("compat"))


@_registered(f"SELECT row_id, greatest(min_0, {_f(10)}) AS a, least(max_1, {_f(30000)}) AS b FROM {_OB} WHERE min_0 <= {_f(20)} AND max_0 >= {_f(10)} AND min_1 <= {_f(30000)} AND max_1 >= {_f(20000)}")
def box_intersection_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _NARROW.bounds()
    return query.range_query(_boxes(spark, sf_dir), _NARROW).select("row_id", F.greatest("min_0", q.lo[0]).alias("a"), F.least("max_1", q.hi[1]).alias("b"))


@_registered(
    f"SELECT l_returnflag, count(*) AS n, {_f('min(l_quantity)')} AS min_0, {_f('max(l_quantity)')} AS max_0, {_f('min(l_extendedprice)')} AS min_1, {_f('max(l_extendedprice)')} AS max_1 FROM lineitem GROUP BY 1"
)
def mbr_union_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = R.records_from_points(_table(spark, sf_dir, "lineitem"), _line_id(), _AXES[:2], keep=["l_returnflag"])
    return aggregate.union_by(points, "l_returnflag")


@_registered(f"SELECT {_f('min(l_quantity)')} AS min_0, {_f('max(l_quantity)')} AS max_0, {_f('min(l_extendedprice)')} AS min_1, {_f('max(l_extendedprice)')} AS max_1 FROM lineitem")
def dataset_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.extent(_points(spark, sf_dir))


@_registered(f"SELECT CAST(floor(CAST(min_0 AS DOUBLE) / 10) AS BIGINT) AS tile, count(*) AS n, min(min_0) AS min_0, max(max_0) AS max_0, min(min_1) AS min_1, max(max_1) AS max_1 FROM {_OB} GROUP BY 1")
def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tile_map(_boxes(spark, sf_dir), 0, 10.0)


@_registered(f"SELECT event_type, count(*) AS n FROM events WHERE {_between('value', 50, 150)} GROUP BY 1")
def count_in_box_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.points_in_box(_table(spark, sf_dir, "events"), ["value"], Box((50,), (150,))).groupBy("event_type").agg(F.count("*").alias("n"))


@_registered(f"SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE {_between('l_quantity', 10, 20)} AND {_between('l_extendedprice', 20000, 30000)}")
def count_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.points_in_box(_table(spark, sf_dir, "lineitem"), _AXES[:2], _NARROW).agg(F.countDistinct("l_orderkey").alias("n"))


def _grid(spark: SparkSession) -> DataFrame:
    """25 query boxes, of which the last row's reach beyond all records."""
    i = F.col("id")
    x, y = (i % 5) * 10, F.floor(i / 5) * 25000
    return spark.range(25).select(i.alias("qid"), x.cast("float").alias("min_0"), (x + 5).cast("float").alias("max_0"), (y + 10000).cast("float").alias("min_1"), (y + 20000).cast("float").alias("max_1"))


_GRID = "(SELECT i AS qid, CAST(i % 5 * 10 AS FLOAT) AS a0, CAST(i % 5 * 10 + 5 AS FLOAT) AS b0, CAST(i // 5 * 25000 + 10000 AS FLOAT) AS a1, CAST(i // 5 * 25000 + 20000 AS FLOAT) AS b1 FROM range(25) r(i))"
_COUNTS = f"SELECT qid, count(l_orderkey) AS n FROM {_GRID} LEFT JOIN lineitem ON {_f('l_quantity')} BETWEEN a0 AND b0 AND {_f('l_extendedprice')} BETWEEN a1 AND b1 GROUP BY qid"


@_registered(_COUNTS)
def batch_query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.batch_query_counts(_points(spark, sf_dir), _grid(spark))


@_registered(f"SELECT avg(n)::DOUBLE AS mean FROM ({_COUNTS})")
def avg_matches_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_query_counts(spark, sf_dir).agg(F.avg("n").alias("mean"))


def _thin(boxes: DataFrame) -> DataFrame:
    """Boxes that are small in price: the join's left side."""
    return boxes.where((F.col("max_1") - F.col("min_1")).cast("double") < 300)


_THIN = f"(SELECT * FROM {_OB} WHERE CAST(max_1 - min_1 AS DOUBLE) < 300)"
_ON = "a.min_0 <= b.max_0 AND a.max_0 >= b.min_0 AND a.min_1 <= b.max_1 AND a.max_1 >= b.min_1"
_PRICE = "(SELECT CAST(o_orderkey AS VARCHAR) AS row_id, CAST(o_orderkey % 50 AS FLOAT) AS min_0, CAST(o_orderkey % 50 + 1 AS FLOAT) AS max_0, CAST(o_totalprice / 5 AS FLOAT) AS min_1, CAST(o_totalprice / 5 + 40 AS FLOAT) AS max_1 FROM orders)"


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from orders: the join's right side."""
    key, price = F.col("o_orderkey") % 50, F.col("o_totalprice") / 5
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("row_id"), key.cast("float").alias("min_0"), (key + 1).cast("float").alias("max_0"), price.cast("float").alias("min_1"), (price + 40).cast("float").alias("max_1"))


@_registered(f"SELECT a.row_id, b.row_id AS r_row_id FROM {_THIN} a JOIN {_PRICE} b ON {_ON}")
def box_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.box_join(_thin(_boxes(spark, sf_dir)), _prices(spark, sf_dir), small=0).select("row_id", "r_row_id")


@_registered(f"SELECT a.row_id FROM {_THIN} a WHERE EXISTS (SELECT 1 FROM {_PRICE} b WHERE {_ON})")
def box_join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.box_join(_thin(_boxes(spark, sf_dir)), _prices(spark, sf_dir), how="left_semi", small=0).select("row_id")


@_registered(f"SELECT a.row_id FROM {_THIN} a WHERE NOT EXISTS (SELECT 1 FROM {_PRICE} b WHERE {_ON})")
def box_join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.box_join(_thin(_boxes(spark, sf_dir)), _prices(spark, sf_dir), how="left_anti", small=0).select("row_id")


_PLACES = "SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL"


@_registered(
    f"""SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most,
  max(value) FILTER (k = CAST(floor(0.5 * (c - 1)) AS BIGINT)) AS p50,
  max(value) FILTER (k = CAST(floor(CAST(0.95 AS DOUBLE) * (c - 1)) AS BIGINT)) AS p95,
  max(value) FILTER (k = CAST(floor(CAST(0.99 AS DOUBLE) * (c - 1)) AS BIGINT)) AS p99 FROM ({_PLACES}) GROUP BY 1"""
)
def histogram_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.histogram(_table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", "least", "most", "p50", "p95", "p99")


@_registered(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_between('l_quantity', 10, 20)} AND {_between('l_extendedprice', 20000, 30000)} ORDER BY ALL LIMIT 100 OFFSET 200")
def page_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query.points_in_box(_table(spark, sf_dir, "lineitem"), _AXES[:2], _NARROW).select("l_orderkey", "l_linenumber", "l_quantity")
    return query.page(found, ["l_orderkey", "l_linenumber", "l_quantity"], 100, 2)


@_registered("SELECT s_name, row_number() OVER (ORDER BY CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT), s_suppkey) AS rank FROM supplier")
def natural_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers' places in natural order."""
    named = _table(spark, sf_dir, "supplier").select("s_name", "s_suppkey", natural_key("s_name").alias("key"))
    return ranked(named, "key", "s_suppkey").select("s_name", "rank")


@_registered("SELECT event_id, CAST(value AS FLOAT) AS back FROM events")
def sortable_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-preserving integers of float values, turned back."""
    return _table(spark, sf_dir, "events").select("event_id", sortable_to_float(float_to_sortable(F.col("value").cast("float"))).alias("back"))


@_registered(f"SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: {_f('x')} BETWEEN {_f(-0.3)} AND {_f(0.3)})) = 64")
def feature_range_64d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range on all of 64 dimensions."""
    embeddings = _table(spark, sf_dir, "embeddings")
    points = R.records_from_points(embeddings, "vec_id", [F.col("embedding")[i] for i in range(64)], keep=["vec_id"])
    return query.range_query(points, Box((-0.3,) * 64, (0.3,) * 64)).select("vec_id")


@_registered(f"SELECT 'line' AS field, count(*) AS n FROM lineitem WHERE {_between('l_quantity', 10, 20)} UNION ALL SELECT 'event', count(*) FROM events WHERE {_between('value', 10, 20)}")
def multi_field_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes of a registry, loaded on demand, asked alike."""
    folder = _folder(spark)
    registry = Registry(spark)
    for name, frame in (("line", _points(spark, sf_dir, 1)), ("event", R.records_from_points(_table(spark, sf_dir, "events"), "event_id", ["value"]))):
        IndexTable.create(spark, f"{folder}/{name}", 1).append(frame)
        registry.register(name, f"{folder}/{name}")
    parts = [registry.get(n).query(Box((10,), (20,))).agg(F.count("*").alias("n")).select(F.lit(n).alias("field"), "n") for n in registry.names()]
    return parts[0].unionByName(parts[1])


def _folder(spark: SparkSession) -> str:
    """A new folder for a written table, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


@_registered(_points_sql(2))
def append_commit_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits, compaction, and the newest state opened again."""
    folder = f"{_folder(spark)}/lines"
    table = IndexTable.create(spark, folder, 2)
    points = _points(spark, sf_dir)
    table.append(points.where("min_0 <= 15"))
    table.append(points.where("min_0 > 15"))
    table.compact()
    table.close()
    return IndexTable.open(spark, folder).query(_NARROW).select("row_id")


@_registered(_points_sql(2) + f" AND {_f('l_quantity')} <= {_f(15)}")
def read_only_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read-only reader sees what was checkpointed, not what was committed later."""
    folder = f"{_folder(spark)}/lines"
    table = IndexTable.create(spark, folder, 2)
    points = _points(spark, sf_dir)
    table.append(points.where("min_0 <= 15"))
    table.checkpoint()
    table.append(points.where("min_0 > 15"))
    return IndexTable.open(spark, folder, read_only=True).query(_NARROW).select("row_id")


@_registered(f"SELECT CAST(event_id AS VARCHAR) AS row_id FROM events WHERE {_between('value', 50, 150)}")
def stream_ingest_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into a table, then a range of it."""
    folder = _folder(spark)
    source = f"{sf_dir}/events.parquet"
    # A pattern names the table whether it is a file or a folder.
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{sf_dir}/events.parque[t]")
    table = IndexTable.create(spark, f"{folder}/events", 1)
    ingest(R.records_from_points(events, "event_id", ["value"]), table, f"{folder}/checkpoint", available_now=True, name="events-" + folder[-8:]).awaitTermination()
    return table.refresh().query(Box((50,), (150,))).select("row_id")


# Records, points and measures.


@_registered(f"SELECT row_id, min_0, max_0, min_1, max_1 FROM {_OB} WHERE min_0 >= {_f(5)} AND max_0 <= {_f(45)} AND min_1 >= {_f(10000)} AND max_1 <= {_f(90000)}")
def project_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.range_query(_boxes(spark, sf_dir), Box((5, 10000), (45, 90000)), "within")


_INNER = f"min_0 <= {_f(20)} AND max_0 >= {_f(10)} AND min_1 <= {_f(30000)} AND max_1 >= {_f(20000)}"


@_registered(f"SELECT b.row_id, count(*) AS n_points, CAST(sum(l_quantity) AS DOUBLE) AS total, max(l_extendedprice) AS furthest FROM {_OB} b JOIN lineitem l ON b.row_id = CAST(l.l_orderkey AS VARCHAR) WHERE {_INNER} GROUP BY 1")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of records, as the doubles that they were."""
    found = query.range_query(R.records_from_groups(_table(spark, sf_dir, "lineitem"), "l_orderkey", _AXES[:2], points=True), _NARROW)
    total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p[0])
    return found.select("row_id", F.size("points").cast("long").alias("n_points"), total.alias("total"), F.array_max(F.transform("points", lambda p: p[1])).alias("furthest"))


@_registered(f"SELECT row_id, min_0, max_0, min_1, max_1 FROM {_OB}")
def point_array_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made from arrays of points."""
    arrays = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in _AXES[:2]))).alias("points"))
    return R.records_from_point_arrays(arrays, 2).drop("points")


@_registered("SELECT count(*) AS n, 0 AS met, count(*) AS inverted FROM nation")
def empty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without points have the inverted box, which nothing meets."""
    none = F.array().cast("array<array<double>>")
    empty = R.records_from_point_arrays(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_id"), none.alias("points")), 2)
    everything = Box((-1e30, -1e30), (1e30, 1e30)).bounds()
    met = G.intersects(G.bounds(2), everything) | G.within(G.bounds(2), everything) | G.contains(G.bounds(2), everything)
    return empty.agg(F.count("*").alias("n"), F.sum(met.cast("int")).cast("int").alias("met"), F.sum(G.is_empty(G.bounds(2)).cast("long")).alias("inverted"))


@_registered(f"SELECT CAST(row_id AS BIGINT) % 7 AS tile, count(*) AS n, min(min_0) AS min_0, max(max_0) AS max_0, min(min_1) AS min_1, max(max_1) AS max_1 FROM {_OB} GROUP BY 1")
def mbr_union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.union_by(_boxes(spark, sf_dir), (F.col("row_id").cast("long") % 7).alias("tile"))


@_registered(f"SELECT row_id, least(min_0, {_f(10)}) AS min_0, greatest(max_0, {_f(20)}) AS max_0, least(min_1, {_f(20000)}) AS min_1, greatest(max_1, {_f(30000)}) AS max_1 FROM {_OB}")
def box_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's box grown to hold another one."""
    grown = G.union(G.bounds(2), _NARROW.bounds())
    return _boxes(spark, sf_dir).select("row_id", *(c.alias(n) for n, c in zip(G.bound_names(2), (x for pair in zip(grown.lo, grown.hi) for x in pair))))


@_registered(f"SELECT row_id, '[(' || min_0 || ', ' || max_0 || ') (' || min_1 || ', ' || max_1 || ')]' AS text FROM {_OB}")
def box_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("row_id", G.to_text(G.bounds(2)).alias("text"))


_SIBLINGS = (Box((5, 15000), (12, 26000)), Box((15, 28000), (30, 60000)), Box((40, 1000), (50, 5000)))


def _sides_sql(box: Box, low: str, high: str) -> str:
    return " * ".join(f"greatest(CAST(0 AS DOUBLE), CAST(least({high.format(i)}, {_f(box.hi[i])}) - greatest({low.format(i)}, {_f(box.lo[i])}) AS DOUBLE))" for i in range(2))


_GROWN = [(f"least(min_{i}, {_f(a)})", f"greatest(max_{i}, {_f(b)})") for i, (a, b) in enumerate(zip(_LO[:2], _HI[:2]))]
_G = f"(SELECT *, {_GROWN[0][0]} AS g0, {_GROWN[0][1]} AS h0, {_GROWN[1][0]} AS g1, {_GROWN[1][1]} AS h1 FROM {_OB})"
_MORE = " + ".join(["CAST(0 AS DOUBLE)", *(f"({_sides_sql(x, 'g{}', 'h{}')}) - ({_sides_sql(x, 'min_{}', 'max_{}')})" for x in _SIBLINGS)])


def _reach_sql(box: Box) -> str:
    far = [f"CAST(h{i} - {_f(box.lo[i])} AS DOUBLE)" for i in range(2)]
    return f"CASE WHEN {far[0]} >= 0 OR {far[1]} >= 0 THEN (CASE WHEN {far[0]} >= 0 THEN {far[0]} ELSE 1 END) * (CASE WHEN {far[1]} >= 0 THEN {far[1]} ELSE 1 END) ELSE 0 END"


@_registered(f"SELECT row_id, ({_MORE})::DOUBLE AS exact, (CAST(0 AS DOUBLE) + {' + '.join(map(_reach_sql, _SIBLINGS))})::DOUBLE AS compat FROM {_G}")
def box_overlap_enlargement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.bounds(2), _NARROW.bounds()
    return _boxes(spark, sf_dir).select("row_id", G.overlap_enlargement(a, b, _SIBLINGS).alias("exact"), G.overlap_enlargement(a, b, _SIBLINGS, "compat").alias("compat"))


@_registered(f"SELECT row_id, min_1 FROM {_OB} ORDER BY min_1, row_id LIMIT 50")
def order_by_axis_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.order_by_axis(_boxes(spark, sf_dir), 1).select("row_id", "min_1").limit(50)


@_registered(f"SELECT row_id, max_0 FROM {_OB} ORDER BY max_0, row_id LIMIT 50")
def order_by_axis_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.order_by_axis(_boxes(spark, sf_dir), 0, upper=True).select("row_id", "max_0").limit(50)


@_registered(f"SELECT row_id, {' * '.join(_WIDE)} - {_AREA} AS enlargement FROM {_OB} ORDER BY 2, 1 LIMIT 132")
def least_enlargement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.least_enlargement(_boxes(spark, sf_dir), _NARROW, 132).select("row_id", "enlargement")


@_registered(f"SELECT least(100, count(*)) AS n FROM lineitem WHERE {_between('l_quantity', 10, 20)}")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller that stops after a page of 100 matches."""
    return query.range_query(_points(spark, sf_dir, 1), Box((10,), (20,))).limit(100).agg(F.count("*").alias("n"))


@_registered(f"SELECT event_id, {_f('value')} < {_f(100)} AS less, {_f('value')} <= {_f(100)} AS less_equal FROM events")
def sortable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving integers compare as their floats do."""
    x, y = float_to_sortable(F.col("value").cast("float")), float_to_sortable(F.lit(100.0).cast("float"))
    return _table(spark, sf_dir, "events").select("event_id", x.alias("x"), y.alias("y")).select("event_id", sortable_less(F.col("x"), F.col("y")).alias("less"), sortable_less_equal(F.col("x"), F.col("y")).alias("less_equal"))


_LOW_BYTES = "list_transform(range(1, len(s_name) + 1), lambda i: ascii(substr(s_name, i, 1)))"
_ADLER = f"list_reduce(list_prepend(CAST(65536 AS BIGINT) * 0 + 1, list_transform({_LOW_BYTES}, lambda b: CAST(b AS BIGINT))), lambda s, b: ((s // 65536 + s % 65536 + b) % 65521) * 65536 + (s % 65536 + b) % 65521)"


def _crc_sql(polynomial: int, ones: int) -> str:
    shift = lambda x: f"xor({x} >> 1, CAST({polynomial} AS UBIGINT) * ({x} & 1))"
    inner = f"list_reduce(list_prepend(xor(s, b), list_transform(range(8), lambda k: CAST(0 AS UBIGINT))), lambda c, k: {shift('c')})"
    return f"xor(list_reduce(list_prepend(CAST({ones} AS UBIGINT), list_transform({_LOW_BYTES}, lambda b: CAST(b AS UBIGINT))), lambda s, b: {inner}), CAST({ones} AS UBIGINT))"


@_registered(f"SELECT s_suppkey, {_ADLER} AS adler, CAST({_crc_sql(checksums.CRC32C, (1 << 32) - 1)} AS BIGINT) AS crc32c, lower(printf('%016x', {_crc_sql(checksums.CRC64, (1 << 64) - 1)})) AS crc64 FROM supplier")
def checksums_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", checksums.adler32(name).alias("adler"), checksums.crc32c(name).alias("crc32c"), F.lower(F.lpad(F.hex(checksums.crc64(name)), 16, "0")).alias("crc64"))


# Measures of streams of values.


@_registered("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS counter, last(value ORDER BY ts, event_id) AS gauge FROM events GROUP BY 1")
def counter_and_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per name the sum of what was added and the last value."""
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("user_id").alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))


@_registered("SELECT event_type, count(value) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def histogram_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.histogram(_table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", F.round("total", 3).alias("total"), F.round("mean", 6).alias("mean"))


_HOURS = "SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1, 2"


@_registered(f"SELECT event_type, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(n AS DOUBLE) ORDER BY hour)), lambda s, x: s + 0.2::DOUBLE * (x - s)), 9) AS rate FROM ({_HOURS}) GROUP BY 1")
def ewma_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed number of events an hour, at the last hour of each type."""
    hour = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 3_600_000_000)
    return aggregate.smoothed(_table(spark, sf_dir, "events"), "event_type", hour, 0.2).select("event_type", F.round("rate", 9).alias("rate"))


# Tables: their states, parts, recovery and upkeep.


def _lines(spark: SparkSession, sf_dir: str, most: float | None = None, labels: tuple[str, ...] = ()) -> IndexTable:
    """A new table of all lines in two epochs, those with a small quantity first."""
    table = IndexTable.create(spark, f"{_folder(spark)}/lines", 2, labels)
    points = _points(spark, sf_dir)
    table.append(points.where("min_0 <= 15"))
    table.append(points.where("min_0 > 15"))
    return table


@_registered(_points_sql(2) + f" AND {_f('l_quantity')} <= {_f(15)}")
def earlier_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).query(_NARROW, epoch=1).select("row_id")


@_registered("SELECT count(*) AS n, 2 AS epoch, 2 AS parts, TRUE AS has_bytes, 0 AS wrong FROM lineitem")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says, and that every record lies in its part's bounds."""
    table = _lines(spark, sf_dir)
    said = table.stats()
    return table.read().agg(F.count("*").alias("n")).select("n", F.lit(said["epoch"]).alias("epoch"), F.lit(said["parts"]).alias("parts"), F.lit(said["bytes"] > 0).alias("has_bytes"), F.lit(table.validate()).cast("int").alias("wrong"))


_EXTENT = f"count(*) AS n, {_f('min(l_quantity)')} AS min_0, {_f('max(l_quantity)')} AS max_0, {_f('min(l_extendedprice)')} AS min_1, {_f('max(l_extendedprice)')} AS max_1"


@_registered(f"SELECT 0 AS level, {_EXTENT} FROM lineitem UNION ALL SELECT 1, {_EXTENT} FROM lineitem GROUP BY {_f('l_quantity')} <= 15")
def index_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's node and those of its parts, from the bounds of stored files."""
    return _lines(spark, sf_dir).nodes().where("level < 2").select("level", "n", *G.bound_names(2))


@_registered("SELECT count(*) AS n, TRUE AS all_small FROM lineitem")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No file has more records than it may have."""
    table = IndexTable.create(spark, f"{_folder(spark)}/lines", 2)
    table.append(_points(spark, sf_dir), most_rows=1000)
    return table.zone_map().agg(F.sum("n").alias("n"), (F.max("n") <= 1000).alias("all_small"))


@_registered(f"SELECT count(*) AS n, CAST(sum(CAST({_f('l_quantity')} AS BIGINT)) AS BIGINT) AS total FROM lineitem WHERE {_between('l_quantity', 10, 20)} AND {_between('l_extendedprice', 20000, 30000)}")
def visit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visitor that reduces the records of each batch; its results are reduced again."""

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [len(b)], "total": [int(b["min_0"].sum())]})

    return _lines(spark, sf_dir).visit(reduced, "n long, total long", _NARROW).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@_registered(f"SELECT count(*) AS n FROM lineitem WHERE {_between('l_extendedprice', 20000, 30000)}")
def labelled_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range on the axis with a name."""
    table = _lines(spark, sf_dir, labels=("quantity", "price"))
    i = table.dimension("price")
    low, high = [-1e30, -1e30], [1e30, 1e30]
    low[i], high[i] = 20000, 30000
    return table.query(Box(low, high)).agg(F.count("*").alias("n"))


@_registered("SELECT unnest(['STRICT', 'BALANCED', 'EVENTUAL']) AS policy, 2 AS epoch, (SELECT count(*) FROM lineitem) AS n")
def durability_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy commits whole batches; one that was committed, or has no rows, makes no epoch."""
    out = None
    for policy in DURABILITY:
        table = IndexTable.create(spark, f"{_folder(spark)}/lines", 1, durability=policy)
        points = _points(spark, sf_dir, 1)
        for name, rows in (("a", points.where("min_0 <= 15")), ("a", points.where("min_0 <= 15")), ("b", points.where("min_0 > 15")), ("c", points.where("min_0 > 1e6"))):
            table.append(rows, batch=name)
        one = table.read().agg(F.count("*").alias("n")).select(F.lit(policy).alias("policy"), F.lit(table.epoch).alias("epoch"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_registered(_points_sql(2) + f" AND {_f('l_quantity')} <= {_f(15)}")
def recovery_torn_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest manifest is cut short: the one before it is opened."""
    table = _lines(spark, sf_dir)
    store = Store(spark, table.path)
    name = f"manifests/{table.epoch:09d}.json"
    store.delete(name)
    stream = store._fs.create(store._path(name), False)
    stream.write(bytearray(b'{"epoch": 2, "par'))
    stream.close()
    return IndexTable.open(spark, table.path).query(_NARROW).select("row_id")


@_registered(_points_sql(2))
def recovery_missing_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest epoch's part is gone: its rows are committed again above it."""
    table = _lines(spark, sf_dir)
    Store(spark, table.path).delete(table._held["parts"][-1]["name"])
    again = IndexTable.open(spark, table.path)
    again.append(_points(spark, sf_dir).where("min_0 > 15"))
    return IndexTable.open(spark, table.path).query(_NARROW).select("row_id")


@_registered(f"SELECT count(*) FILTER ({_f('l_quantity')} <= 15) AS pinned, count(*) AS newest, 1 AS min_active FROM lineitem")
def pinned_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader keeps its epoch while others are written, compacted and vacuumed."""
    table = IndexTable.create(spark, f"{_folder(spark)}/lines", 2)
    points = _points(spark, sf_dir)
    table.append(points.where("min_0 <= 15"))
    reader = IndexTable.open(spark, table.path)
    reader.pin()
    table.append(points.where("min_0 > 15"))
    table.compact()
    table.vacuum()
    newest = F.lit(table.count()).cast("long").alias("newest")
    return reader.read().agg(F.count("*").alias("pinned")).select("pinned", newest, F.lit(table.min_active_epoch()).alias("min_active"))


@_registered(f"SELECT count(*) AS n, count(*) FILTER ({_f('l_quantity')} > 15) AS flagged FROM lineitem")
def widened_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that only a later part has."""
    table = IndexTable.create(spark, f"{_folder(spark)}/lines", 2)
    lines = _table(spark, sf_dir, "lineitem")
    points = R.records_from_points(lines, _line_id(), _AXES[:2], keep=["l_returnflag"])
    table.append(points.where("min_0 <= 15").drop("l_returnflag"))
    table.append(points.where("min_0 > 15"))
    return table.read().agg(F.count("*").alias("n"), F.count("l_returnflag").alias("flagged"))


@_registered("SELECT count(*) AS n, TRUE AS few_parts, TRUE AS few_checkpoints, 8 AS commits FROM lineitem")
def upkeep_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight commits under a policy that merges three small parts and checkpoints every second epoch."""
    table = IndexTable.create(spark, f"{_folder(spark)}/lines", 1)
    upkeep = Upkeep(table, Policy(most_epochs=2, compact_parts=3))
    points = _points(spark, sf_dir, 1)
    for i in range(8):
        table.append(points.where(F.pmod(F.xxhash64("row_id"), F.lit(8)) == i), batch=f"b{i}")
        upkeep.committed()
    upkeep.checkpoint()
    n = IndexTable.open(spark, table.path, read_only=True).read().agg(F.count("*").alias("n"))
    return n.select("n", F.lit(table.stats()["parts"] <= 3).alias("few_parts"), F.lit(len(table.checkpoints()) <= 2).alias("few_checkpoints"), F.lit(len(table._held["batches"])).alias("commits"))


@_registered(f"SELECT count(*) FILTER ({_f('l_quantity')} <= 15) AS before, count(*) AS behind FROM lineitem")
def search_while_inserting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader sees the state that it holds, and the new one once it asks for it."""
    table = IndexTable.create(spark, f"{_folder(spark)}/lines", 1)
    points = _points(spark, sf_dir, 1)
    table.append(points.where("min_0 <= 15"))
    reader = IndexTable.open(spark, table.path)
    table.append(points.where("min_0 > 15"))
    before = reader.read().agg(F.count("*").alias("n")).first()["n"]
    return reader.refresh().read().agg(F.lit(before).alias("before"), F.count("*").alias("behind"))


@_registered("SELECT count(*) AS n FROM events WHERE value IS NOT NULL")
def time_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = time_table(spark, f"{_folder(spark)}/events")
    table.append(R.records_from_points(_table(spark, sf_dir, "events"), "event_id", ["value"]))
    return table.query(Box((-1e30,), (1e30,))).agg(F.count("*").alias("n"))


_STEPS = """VALUES ('registered', 'line', 'registered', 0), ('loaded', 'line', 'loaded', 1), ('both', 'event', 'loaded', 2), ('cold', 'line', 'registered', 1),
  ('idle', 'event', 'registered', 0), ('again', 'line', 'loaded', 1), ('unloaded', 'line', 'registered', 0), ('unknown', 'none', NULL, 0), ('removed', 'line', NULL, 0), ('saved', 'event', 'registered', 0)"""


@_registered(f"SELECT * FROM ({_STEPS}) t(step, name, state, loaded)")
def registry_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registry says of its indexes from registration to removal, on a clock of its own."""
    folder, now, seen = _folder(spark), [0.0], []
    for name, frame in (("line", _points(spark, sf_dir, 1)), ("event", R.records_from_points(_table(spark, sf_dir, "events"), "event_id", ["value"]))):
        IndexTable.create(spark, f"{folder}/tables/{name}", 1).append(frame)
    registry = Registry(spark, StorageLevel.MEMORY_AND_DISK, clock=lambda: now[0])
    registry.register_folder(f"{folder}/tables")

    def step(what: str, name: str) -> None:
        state = registry.state(name)
        seen.append((what, name, None if state is None else state.value, len(registry.loaded())))
        now[0] += 10

    step("registered", "line")
    registry.get("line")
    step("loaded", "line")
    registry.get("event")
    step("both", "event")
    registry.unload_cold(1)
    step("cold", "line")
    registry.unload_idle(5)
    step("idle", "event")
    registry.get("line")
    step("again", "line")
    registry.unload("line")
    step("unloaded", "line")
    step("unknown", "none")
    registry.save(f"{folder}/catalog")
    registry.remove("line")
    step("removed", "line")
    registry.reset()
    registry.load(f"{folder}/catalog")
    step("saved", "event")
    return spark.createDataFrame(seen, "step string, name string, state string, loaded int")


@_registered(f"SELECT count(*) AS n, 1 AS loaded FROM events WHERE {_between('value', 50, 150)}")
def cached_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept in memory under a budget that only one index fits in."""
    folder = _folder(spark)
    registry = Registry(spark, policy="1KB")
    for name, frame in (("line", _points(spark, sf_dir, 1)), ("event", R.records_from_points(_table(spark, sf_dir, "events"), "event_id", ["value"]))):
        IndexTable.create(spark, f"{folder}/{name}", 1).append(frame)
        registry.register(name, f"{folder}/{name}")
    registry.get("line")
    found = query.range_query(registry.frame("event"), Box((50,), (150,)))
    return found.agg(F.count("*").alias("n")).select("n", F.lit(len(registry.loaded())).alias("loaded"))
