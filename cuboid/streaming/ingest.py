"""Continuous ingest: each micro-batch of a stream of records becomes one epoch of a table.

The batch's number is noted in the manifest, so a batch that is run again after a failure commits
nothing twice; readers see whole batches only.  Checkpoints and merges of small parts follow a policy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cuboid.settings import setting
from cuboid.sources.table import IndexTable
from cuboid.sources.upkeep import Policy, Upkeep

#: Seconds between batches: often for fresh data, seldom for heavy ingest, as each batch is a commit.
MODES = {"LIGHT": 1, "BALANCED": 10, "HEAVY": 60}


def ingest(stream: DataFrame, table: IndexTable, checkpoint: str, mode: str | None = None, available_now: bool = False, name: str = "ingest", files: int | None = None, policy: Policy | None = None) -> StreamingQuery:
    """Starts the query that appends a stream of records to a table; the mode is the session's ``ingest_mode`` if none is given."""
    mode = mode or setting("ingest_mode", table.spark)
    upkeep = Upkeep(table, policy or Policy.of(table.spark))

    def commit(batch: DataFrame, number: int) -> None:
        before = table.epoch
        if table.append(batch, files=files, batch=f"{name}:{number}") != before:
            upkeep.committed()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{MODES[mode]} seconds")
    return writer.start()
