"""Settings from the environment or the Spark session, the log, and the shared folder.

A setting is read from ``spark.cuboid.<name>`` of the session, else from ``CUBOID_<NAME>`` of the
environment, else its default holds.  Sizes may have a unit (``512MB``).
"""

from __future__ import annotations

import logging
import logging.handlers
import os
import tempfile

from pyspark.sql import SparkSession

log = logging.getLogger("cuboid")

UNITS = {"": 1, "b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40}
#: name: (default, what it is read as)
KNOWN = {
    "cache_policy": ("unlimited", str),
    "workload": ("auto", str),
    "ingest_mode": ("BALANCED", str),
    "checkpoint_keep": ("2", int),
    "compact_below": ("128MB", "size"),
    "compact_parts": ("16", int),
    "log_level": ("WARNING", str),
    "log_file": ("", str),
    "log_bytes": ("64MB", "size"),
}
#: Share of Spark's unified memory that cached blocks are safe in, by workload; the rest is for execution first.
STORAGE_SHARE = {"bulk": 0.3, "query": 0.6, "mixed": 0.5, "constrained": 0.25, "auto": 0.4}


def size(text: str) -> int:
    """Bytes of a text such as ``4096``, ``64KB`` or ``1.5 GB``."""
    text = text.strip().lower()
    unit = text.lstrip("0123456789.").strip()
    number = text[: len(text) - len(text.lstrip("0123456789."))]
    if unit not in UNITS or not number:
        raise ValueError(f"not a size: {text}")
    return int(float(number) * UNITS[unit])


def setting(name: str, spark: SparkSession | None = None):
    default, kind = KNOWN[name]
    found = spark.conf.get(f"spark.cuboid.{name}", None) if spark is not None else None
    text = found if found is not None else os.environ.get(f"CUBOID_{name.upper()}", default)
    return size(text) if kind == "size" else kind(text)


def memory_conf(spark: SparkSession | None = None) -> dict[str, str]:
    """The memory settings to start a session with, for the workload that is set."""
    workload = setting("workload", spark)
    if workload not in STORAGE_SHARE:
        raise ValueError(f"unknown workload {workload}; known: {', '.join(STORAGE_SHARE)}")
    return {"spark.memory.storageFraction": str(STORAGE_SHARE[workload])}


def start_log(spark: SparkSession | None = None) -> logging.Logger:
    """Sets the level, and a file that is rotated by size if one is named."""
    log.setLevel(setting("log_level", spark))
    file = setting("log_file", spark)
    if file and not any(getattr(h, "baseFilename", None) == os.path.abspath(file) for h in log.handlers):
        handler = logging.handlers.RotatingFileHandler(file, maxBytes=setting("log_bytes", spark), backupCount=3)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
    return log


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where a local session names none, one of its own.

    On a cluster a folder of this machine would be seen by no executor, so there one must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found
