"""A catalog of named indexes, loaded on first use and unloaded by age or to free memory.

A cache policy says where loaded records are kept and how many bytes of tables may be loaded at once; the
least recently used ones make room.  The catalog itself can be saved as a file and loaded again.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from cuboid.metrics import metrics
from cuboid.settings import UNITS, log, setting, size
from cuboid.sources.files import Store
from cuboid.sources.table import IndexTable


class State(Enum):
    REGISTERED = "registered"
    LOADING = "loading"
    LOADED = "loaded"
    UNLOADING = "unloading"
    FAILED = "failed"


@dataclass
class _Entry:
    path: str
    read_only: bool
    dims: int | None
    state: State = State.REGISTERED
    table: IndexTable | None = None
    frame: DataFrame | None = None
    size: int = 0
    used: float = 0.0
    lock: threading.RLock = field(default_factory=threading.RLock)


class CachePolicy:
    """Where loaded records are kept, and the bytes of tables that may be loaded; to be given as it is, or subclassed."""

    def __init__(self, storage: StorageLevel | None = None, most: int | None = None, share: float | None = None) -> None:
        self.storage, self.most, self.share = storage, most, share

    def budget(self, spark: SparkSession) -> int | None:
        """Bytes; None for no limit.  A share is of the memory that the executors have for blocks."""
        if self.share is None:
            return self.most
        status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().toList()
        return int(self.share * sum(status.apply(i)._1() for i in range(status.size())))


class Registry:
    """Field name -> index.  ``storage`` keeps loaded records in memory or on disk; None leaves them to the scans.

    policy: a CachePolicy or its text, which stands before ``storage``.
    """

    def __init__(self, spark: SparkSession, storage: StorageLevel | None = None, on_load: Callable[[str], None] | None = None, on_unload: Callable[[str], None] | None = None, clock: Callable[[], float] = time.monotonic, policy: CachePolicy | str | None = None) -> None:
        if isinstance(policy, str):
            found = cache_policy(policy)
            if found is None:
                raise ValueError(f"unknown cache policy {policy}")
            policy = CachePolicy(*found)
        self._policy = policy or CachePolicy(storage)
        self._spark, self._storage, self._clock = spark, self._policy.storage, clock
        self._on_load, self._on_unload = on_load, on_unload
        self._entries: dict[str, _Entry] = {}
        self._lock = threading.RLock()

    def register(self, name: str, path: str, read_only: bool = False, dims: int | None = None) -> bool:
        """False if the name is taken."""
        with self._lock:
            if name in self._entries:
                return False
            self._entries[name] = _Entry(path, read_only, dims)
            return True

    def register_folder(self, path: str, read_only: bool = False) -> int:
        """Registers each table below a folder by the name of its own; gives their number."""
        found = 0
        for name in Store(self._spark, path).names(""):
            if Store(self._spark, f"{path}/{name}").names("manifests"):
                found += self.register(name, f"{path}/{name}", read_only)
        return found

    def is_registered(self, name: str) -> bool:
        return name in self._entries

    def state(self, name: str) -> State | None:
        return self._entries[name].state if name in self._entries else None

    def metadata(self, name: str) -> dict | None:
        e = self._entries.get(name)
        return None if e is None else {"path": e.path, "read_only": e.read_only, "dims": e.dims, "state": e.state, "bytes": e.size}

    def get(self, name: str) -> IndexTable | None:
        """The index, loaded if need be; the same one to all callers; None if nobody has registered it."""
        e = self._entries.get(name)
        if e is None:
            return None
        with e.lock:
            if e.state is not State.LOADED:
                e.state = State.LOADING
                try:
                    e.table = IndexTable.open(self._spark, e.path, e.read_only)
                    e.dims, e.size = e.table.dims, e.table.stats()["bytes"]
                    e.frame = e.table.read()
                    if self._storage is not None:
                        e.frame.persist(self._storage)
                except Exception:
                    e.state = State.FAILED
                    raise
                e.state = State.LOADED
                metrics.counter("indexes_loaded").add()
                if self._on_load:
                    self._on_load(name)
            e.used = self._clock()
            table = e.table
        self._make_room(name)
        return table

    def _make_room(self, name: str) -> None:
        """Unloads others, the least recently used first, while the loaded ones are beyond the policy's budget."""
        most = self._policy.budget(self._spark)
        for other in sorted(self.loaded(), key=lambda n: self._entries[n].used) if most is not None else ():
            if self.memory() <= most:
                break
            if other != name:
                log.info("unloading %s for %s", other, name)
                self.unload(other)

    def frame(self, name: str) -> DataFrame | None:
        return self._entries[name].frame if self.get(name) is not None else None

    def unload(self, name: str) -> int:
        """Gives the bytes that were freed."""
        e = self._entries.get(name)
        if e is None:
            return 0
        with e.lock:
            if e.state is not State.LOADED:
                return 0
            e.state = State.UNLOADING
            if self._storage is not None:
                e.frame.unpersist()
            freed, e.table, e.frame, e.size, e.state = e.size, None, None, 0, State.REGISTERED
        if self._on_unload:
            self._on_unload(name)
        return freed

    def unload_cold(self, target: int) -> int:
        """Unloads the least recently used ones until so many bytes are free."""
        freed = 0
        for name in sorted(self.loaded(), key=lambda n: self._entries[n].used):
            if freed >= target:
                break
            freed += self.unload(name)
        return freed

    def unload_idle(self, age: float) -> int:
        """Unloads all that nobody has asked for in so many seconds; gives their number."""
        now = self._clock()
        idle = [n for n in self.loaded() if now - self._entries[n].used > age]
        for name in idle:
            self.unload(name)
        return len(idle)

    def remove(self, name: str) -> bool:
        with self._lock:
            self.unload(name)
            return self._entries.pop(name, None) is not None

    def reset(self) -> None:
        for name in list(self._entries):
            self.remove(name)

    def names(self) -> list[str]:
        return sorted(self._entries)

    def loaded(self) -> list[str]:
        return [n for n, e in self._entries.items() if e.state is State.LOADED]

    def memory(self) -> int:
        return sum(e.size for e in self._entries.values())


    def save(self, path: str) -> int:
        """Writes the catalog's roots as the next numbered file of a folder: name, path, dimensions, epoch and extent; gives its number."""
        roots = []
        for name in self.names():
            e = self._entries[name]
            table = IndexTable.open(self._spark, e.path, e.read_only)
            roots.append({"name": name, "path": e.path, "read_only": e.read_only, "dims": table.dims, "epoch": table.epoch, "extent": table.extent()})
        store = Store(self._spark, path)
        number = max((int(n[:9]) for n in store.names("roots")), default=0) + 1
        if not store.publish(f"roots/{number:09d}.json", {"roots": roots}):
            raise RuntimeError("another writer has saved the catalog; try again")
        return number

    def load(self, path: str) -> int:
        """Registers all roots of the newest saved catalog; gives the number of new ones."""
        store = Store(self._spark, path)
        names = store.names("roots")
        if not names:
            raise FileNotFoundError(f"no catalog in {path}")
        return sum(self.register(r["name"], r["path"], r["read_only"], r["dims"]) for r in store.read(f"roots/{names[-1]}")["roots"])


def default_registry(spark: SparkSession) -> Registry:
    """A registry with the policy that the session or the environment sets."""
    return Registry(spark, policy=setting("cache_policy", spark))


#: Named cache policies.
POLICIES = {"unlimited": StorageLevel.MEMORY_AND_DISK, "query": StorageLevel.MEMORY_AND_DISK, "mixed": StorageLevel.MEMORY_AND_DISK, "bulk": StorageLevel.DISK_ONLY, "minimal": None}


def cache_policy(spec: str) -> tuple[StorageLevel | None, int | None, float | None] | None:
    """(storage level, bytes, share of memory) of a policy's text, such as ``bulk``, ``512MB``, ``25%``; None if it isn't known."""
    text = spec.strip().lower()
    if text in POLICIES:
        return POLICIES[text], None, None
    try:
        if text.endswith("%"):
            share = float(text[:-1]) / 100
            return (StorageLevel.MEMORY_AND_DISK, None, share) if 0 < share <= 1 else None
        if text[-2:] in UNITS:
            return StorageLevel.MEMORY_AND_DISK, size(text), None
    except ValueError:
        return None
    return None
