"""Epoch tables: records in clustered Parquet, published by manifests.

Each commit writes new files and then one manifest, which names every epoch's folder that belongs to
the table, and the columns of all of them.  A reader holds one manifest and so sees one state; what is
staged is invisible.  A commit that loses the race for its number fails and can be tried again.  Rows are
only added; the same id may stand twice.  A later part may have columns that earlier ones lack (they are
null there) and lack some; a column keeps its type.

A writer announces the part that it stages and a reader may pin its epoch, both for a time; ``vacuum``
leaves what is announced or pinned.  A manifest that is torn, or names a part that is gone, is passed
over: the newest complete one is opened, and the next commit takes a number above it.

    table/data/epoch=N-xxxx/*.parquet      records, clustered
    table/manifests/00000000N.json         epochs, rows, bounds, columns, batches
    table/checkpoints/00000000N.json       what read-only readers open
    table/staged/*.json, table/pins/*.json what writers stage and readers hold, with an end
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuboid.functions import geometry as G
from cuboid.functions.geometry import Box
from cuboid.operators.query import range_query
from cuboid.operators.ranking import ranked
from cuboid.plans import layout
from cuboid.settings import log
from cuboid.sources.files import Store, TornFile

#: Batches that a manifest remembers; a stream only ever repeats its last one.
_BATCHES = 64
#: Seconds for which a staged part is safe from ``vacuum``: longer than any write takes.
LEASE = 86_400.0
DURABILITY = ("STRICT", "BALANCED", "EVENTUAL")


@dataclass
class IndexTable:
    """A table of records with ``dims`` dimensions.  precision and durability are kept as notes: every commit is atomic."""

    spark: SparkSession
    path: str
    dims: int
    labels: tuple[str, ...] = ()
    read_only: bool = False
    options: dict = field(default_factory=dict)
    _store: Store | None = None
    _held: dict | None = None
    _closed: bool = False
    #: The highest number of a manifest that can't be used.
    _torn: int = -1
    clock: Callable[[], float] = time.time

    # --- opening -----------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, dims: int, labels: tuple[str, ...] = (), durability: str = "BALANCED", precision: int = 32) -> IndexTable:
        """A new table, or the one that is there if it has as many dimensions."""
        if durability not in DURABILITY:
            raise ValueError(f"unknown durability {durability}")
        if labels and len(labels) != dims:
            raise ValueError("as many labels as dimensions are needed")
        store = Store(spark, path)
        if not store.names("manifests"):
            # Whoever comes second finds the first one's table below.
            store.publish("manifests/000000000.json", {"epoch": 0, "dims": dims, "labels": list(labels), "precision": precision, "durability": durability, "parts": [], "batches": [], "schema": None})
        table = cls.open(spark, path)
        if table.dims != dims:
            raise ValueError(f"the table has {table.dims} dimensions")
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> IndexTable:
        """The newest complete state; for read-only readers that of the newest checkpoint."""
        store = Store(spark, path)
        held, torn = cls._newest(store, read_only)
        return cls(spark, path, held["dims"], tuple(held["labels"]), read_only, {k: held[k] for k in ("precision", "durability")}, store, held, _torn=torn)

    @staticmethod
    def _newest(store: Store, read_only: bool) -> tuple[dict, int]:
        """The newest manifest that is whole and whose parts are there, and the highest number above it that isn't."""
        kind = "checkpoints" if read_only else "manifests"
        names = [n for n in store.names(kind) if n.endswith(".json")]
        if not names:
            raise FileNotFoundError(f"no {kind[:-1]} in {store.root}")
        present, torn = set(store.names("data")), -1
        for name in reversed(names):
            try:
                held = store.read(f"manifests/{name}")
                lost = [p["name"] for p in held["parts"] if p["name"].removeprefix("data/") not in present]
            except TornFile:
                lost = [name]
            if not lost:
                return held, torn
            log.warning("%s: manifest %s can't be used, lost: %s", store.root, name, lost[:3])
            torn = max(torn, int(name[:9]))
        raise TornFile(f"no complete {kind[:-1]} in {store.root}")

    def close(self) -> None:
        self._closed = True

    def _writable(self) -> Store:
        if self.read_only:
            raise PermissionError("the table is open read-only")
        if self._closed:
            raise ValueError("the table is closed")
        return self._store

    @property
    def epoch(self) -> int:
        return self._held["epoch"]

    def dimension(self, label: str) -> int:
        """The ordinal of a dimension's label."""
        if label not in self.labels:
            raise KeyError(label)
        return self.labels.index(label)

    def refresh(self) -> IndexTable:
        """Moves to the newest complete state."""
        self._held, self._torn = self._newest(self._store, self.read_only)
        return self

    # --- writing -----------------------------------------------------------------------------------

    def append(self, records: DataFrame, files: int | None = None, batch: str | None = None, most_rows: int = 0) -> int:
        """Writes and commits records; gives the new epoch.  No rows, or a batch that is there already, commit nothing.

        files: their number, else adaptive execution sizes them; most_rows: a file with more is split.
        """
        store = self._writable()
        self.refresh()
        if batch is not None and batch in self._held["batches"]:
            return self.epoch
        if G.dims_of(records.columns) != self.dims:
            raise ValueError(f"the table has {self.dims} dimensions")
        schema = self._widened(records.schema)
        with _Staged(self) as name:
            part = self._write(records, name, files, most_rows)
            if not part["rows"]:
                store.delete(name)
                return self.epoch
            return self._commit([*self._held["parts"], part], batch, schema)

    def _schema(self, held: dict | None = None) -> StructType | None:
        found = (held or self._held).get("schema")
        return None if found is None else StructType.fromJson(found)

    def _widened(self, new: StructType) -> StructType:
        """The table's columns and those that are new; all may be null, as not every part has them."""
        known = self._schema() or StructType([])
        types = {f.name: f.dataType for f in known}
        for f in new:
            if f.name in types and types[f.name] != f.dataType:
                raise ValueError(f"column {f.name} is {types[f.name].simpleString()} in the table, not {f.dataType.simpleString()}")
        out = StructType(list(known.fields))
        for f in new:
            if f.name not in types:
                out = out.add(f.name, f.dataType, True)
        return out

    def _write(self, records: DataFrame, name: str, files: int | None, most_rows: int = 0) -> dict:
        """A part's entry; rows and bounds are observed while it is written."""
        where, seen = f"{self.path.rstrip('/')}/{name}", Observation()
        # Records may lie outside the extent that the manifest has, which saves a pass over them: the key has room for that.
        laid = layout.clustered(records, files, self.extent())
        laid.observe(seen, F.count(F.lit(1)).alias("n"), *G.union_agg(self.dims)).write.option("maxRecordsPerFile", most_rows).parquet(where)
        row = seen.get
        bounds = [[row[f"min_{i}"], row[f"max_{i}"]] for i in range(self.dims)]
        return {"name": name, "rows": row["n"], "bounds": bounds, "epoch": self._next(), "bytes": self._store.size(name)}

    def _next(self) -> int:
        return max(self.epoch, self._torn) + 1

    def _commit(self, parts: list[dict], batch: str | None = None, schema: StructType | None = None) -> int:
        new = self._held | {"epoch": self._next(), "parts": parts, "batches": [*self._held["batches"], *([batch] if batch is not None else [])][-_BATCHES:], "at": self.clock()}
        if schema is not None:
            new["schema"] = json.loads(schema.json())
        if not self._store.publish(f"manifests/{new['epoch']:09d}.json", new):
            raise RuntimeError(f"another writer has committed epoch {new['epoch']}; refresh and try again")
        self._held = new
        return new["epoch"]

    def checkpoint(self) -> int:
        """Lets read-only readers see the current state."""
        self._writable().publish(f"checkpoints/{self.epoch:09d}.json", {"epoch": self.epoch})
        return self.epoch

    def checkpoints(self) -> list[int]:
        return [int(n[:9]) for n in self._store.names("checkpoints") if n.endswith(".json")]

    def compact(self, files: int | None = None, below: int | None = None) -> int:
        """Rewrites all parts, or those of less than ``below`` bytes, into one clustered part."""
        self._writable()
        self.refresh()
        small = [p for p in self._held["parts"] if below is None or p.get("bytes", 0) < below]
        if len(small) < 2:
            return self.epoch
        with _Staged(self) as name:
            part = self._write(self._frame(small), name, files)
            return self._commit([*(p for p in self._held["parts"] if p not in small), part])

    def pin(self, seconds: float = LEASE) -> Pin:
        """Keeps the held epoch's parts from ``vacuum`` until it is released or its time is over."""
        name = f"pins/{self.epoch:09d}-{uuid.uuid4().hex}.json"
        self._store.publish(name, {"epoch": self.epoch, "until": self.clock() + seconds})
        return Pin(self._store, name)

    def _due(self, folder: str) -> list[dict]:
        """What pins or announcements say that aren't over; those that are go."""
        out = []
        for name in self._store.names(folder):
            if name.endswith(".json"):
                try:
                    said = self._store.read(f"{folder}/{name}")
                except (TornFile, Py4JJavaError):  # its owner may have taken it away
                    continue
                if said["until"] > self.clock():
                    out.append(said)
                else:
                    self._store.delete(f"{folder}/{name}")
        return out

    def min_active_epoch(self) -> int:
        """The oldest epoch that a reader has pinned, else the newest one."""
        return min((p["epoch"] for p in self._due("pins")), default=self.epoch)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last ``keep``, the last checkpoint's and pinned ones, and parts that none of the rest names; gives their number.

        What is listed first is judged by what is read last, so a part that is committed meanwhile stays.
        """
        store = self._writable()
        present = store.names("data")
        staged = {s["part"] for s in self._due("staged")}
        pinned = {f"{p['epoch']:09d}.json" for p in self._due("pins")}
        names = [n for n in store.names("manifests") if n.endswith(".json")]
        held = set(names[-max(1, keep) :]) | set(store.names("checkpoints")[-1:]) | pinned
        used = set(staged)
        for n in sorted(held & set(names)):
            try:
                used |= {p["name"] for p in store.read(f"manifests/{n}")["parts"]}
            except TornFile:  # the one below it is what readers open
                below = [m for m in names if m < n][-1:]
                held |= set(below)
                used |= {p["name"] for m in below for p in store.read(f"manifests/{m}")["parts"]}
        for n in set(names) - held:
            store.delete(f"manifests/{n}")
        stale = [n for n in present if f"data/{n}" not in used]
        for n in stale:
            store.delete(f"data/{n}")
        return len(stale)

    def purge(self) -> None:
        """Drops the table with all its files."""
        self._writable().delete("")
        self._closed = True

    # --- reading -----------------------------------------------------------------------------------

    def _at(self, epoch: int | None) -> dict:
        return self._held if epoch is None else self._store.read(f"manifests/{epoch:09d}.json")

    def _frame(self, parts: list[dict], held: dict | None = None) -> DataFrame:
        schema = self._schema(held)
        if schema is None:
            schema = ", ".join(["row_id string", *(f"{n} float" for n in G.bound_names(self.dims))])
        if parts:
            reader = self.spark.read.schema(schema) if isinstance(schema, StructType) else self.spark.read.option("mergeSchema", "true")
            return reader.parquet(*(f"{self.path.rstrip('/')}/{p['name']}" for p in parts))
        return self.spark.createDataFrame([], schema)

    def read(self, epoch: int | None = None) -> DataFrame:
        """All records of the state that is held, or of an epoch before."""
        held = self._at(epoch)
        return self._frame(held["parts"], held)

    def query(self, box: Box, predicate: str = "intersects", epoch: int | None = None) -> DataFrame:
        """Parts whose bounds can't meet the box aren't opened; the rest is left to files' and row groups' statistics."""
        if box.dims != self.dims:
            raise ValueError(f"the table has {self.dims} dimensions")
        held = self._at(epoch)
        near = [p for p in held["parts"] if all(lo <= b and a <= hi for (lo, hi), a, b in zip(p["bounds"], box.lo, box.hi))]
        return range_query(self._frame(near, held), box, predicate)

    def count(self) -> int:
        return sum(p["rows"] for p in self._held["parts"])

    def extent(self) -> list[tuple[float, float]] | None:
        """(low, high) of each axis, from the manifest."""
        parts = self._held["parts"]
        return [(min(p["bounds"][i][0] for p in parts), max(p["bounds"][i][1] for p in parts)) for i in range(self.dims)] if parts else None

    def zone_map(self) -> DataFrame:
        return layout.zone_map(self.read())

    def nodes(self, order: str = "breadth") -> DataFrame:
        """(place, level, path, n, bounds) of the table, its parts and their files, level by level or each part before the next.

        A file's place within its level is the order of its path; the files are counted in one aggregate.
        """
        if order not in ("breadth", "depth"):
            raise ValueError(f"unknown order {order}")
        files = self.zone_map().select(F.lit(2).alias("level"), F.regexp_extract("path", "(data/epoch=[^/]*/[^/]*)$", 1).alias("path"), "n", *G.bound_names(self.dims))
        sums = [F.sum("n").alias("n"), *G.union_agg(self.dims)]
        parts = files.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("path")).agg(*sums).select(F.lit(1).alias("level"), "path", "n", *G.bound_names(self.dims))
        root = files.agg(*sums).select(F.lit(0).alias("level"), F.lit("").alias("path"), "n", *G.bound_names(self.dims))
        return ranked(root.unionByName(parts).unionByName(files), *(("level", "path") if order == "breadth" else ("path", "level")), name="place")

    def visit(self, fn: Callable, schema: str, box: Box | None = None) -> DataFrame:
        """What ``fn`` makes of the records, in pandas batches beside the data; with a box only parts and records that meet it are visited."""
        return (self.read() if box is None else self.query(box)).mapInPandas(fn, schema)

    def stats(self) -> dict:
        return {"epoch": self.epoch, "rows": self.count(), "parts": len(self._held["parts"]), "bytes": sum(self._store.size(p["name"]) for p in self._held["parts"])}

    def validate(self) -> int:
        """Number of records outside their part's bounds, and of parts whose rows differ from the manifest's: 0 for a sound table."""
        wrong = 0
        for p in self._held["parts"]:
            records = self._frame([p])
            inside = F.lit(True)
            for i, (low, high) in enumerate(p["bounds"]):
                inside = inside & (F.col(f"min_{i}") >= F.lit(low).cast("float")) & (F.col(f"max_{i}") <= F.lit(high).cast("float"))
            row = records.agg(F.count("*").alias("n"), F.sum((~inside).cast("long")).alias("out")).first()
            wrong += (row["out"] or 0) + (row["n"] != p["rows"])
        return wrong


class Pin:
    """An epoch that a reader holds."""

    def __init__(self, store: Store, name: str) -> None:
        self._store, self._name = store, name

    def release(self) -> None:
        self._store.delete(self._name)

    def __enter__(self) -> Pin:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class _Staged:
    """Announces a part for as long as it is written; gives its name."""

    def __init__(self, table: IndexTable) -> None:
        self.table, own = table, uuid.uuid4().hex
        self.name, self.note = f"data/epoch={table._next()}-{own[:8]}", f"staged/{own}.json"

    def __enter__(self) -> str:
        self.table._store.publish(self.note, {"part": self.name, "until": self.table.clock() + LEASE})
        return self.name

    def __exit__(self, *_: object) -> None:
        self.table._store.delete(self.note)


def geo_table(spark: SparkSession, path: str) -> IndexTable:
    return IndexTable.create(spark, path, 2, ("longitude", "latitude"))


def space_table(spark: SparkSession, path: str) -> IndexTable:
    return IndexTable.create(spark, path, 3, ("x", "y", "z"))


def time_table(spark: SparkSession, path: str) -> IndexTable:
    return IndexTable.create(spark, path, 1, ("time",))


def feature_table(spark: SparkSession, path: str, dims: int) -> IndexTable:
    return IndexTable.create(spark, path, dims, tuple(f"f{i}" for i in range(dims)))
