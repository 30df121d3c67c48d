"""Ships in range from a stream of positions.

The registry is a streaming aggregate: the last report per ship that is not
exactly at the limit.  Partial aggregation runs before the shuffle, so one busy
ship costs one row per task and trigger, and state is one row per ship.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ais import decode_ais, with_geometry
from ..functions.geo import RANGE_LIMIT_M
from ..operators.tracks import in_range
from ..sources.files import file_system

KEPT_SNAPSHOTS = 3


def positions(lines: DataFrame) -> DataFrame:
    """Stateless decode of a sentence stream to positions with geometry."""
    return with_geometry(decode_ais(lines))


def ships_in_range(
    stream: DataFrame, key: str, order: list[Column], distance: str, limit: float = RANGE_LIMIT_M
) -> DataFrame:
    """Registry of a stream (run it in complete mode) or of a batch."""
    return in_range(stream, key, order, distance, limit)


def snapshot(
    registry: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = "60 seconds",
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    keep: int = KEPT_SNAPSHOTS,
) -> StreamingQuery:
    """Overwrite the snapshot at every trigger; skip when no ship is in range.

    Each trigger writes a folder of its own below ``path`` (``batch=<n>``), so a
    repeated trigger replaces its own output and readers never see a half-written
    snapshot.  The ``keep`` newest folders stay, for readers that are not done.
    ``every=None`` processes what is there and stops.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = enrich(batch) if enrich else batch
        target = f"{path}/batch={batch_id}"
        out.write.mode("overwrite").parquet(target)  # the batch is evaluated once
        if batch.sparkSession.read.schema(out.schema).parquet(target).isEmpty():
            system, at = file_system(target)
            system.delete_dir(at)
        else:
            expire(path, keep)

    writer = registry.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def expire(path: str, keep: int) -> None:
    """Deletes all but the newest snapshots, which this module wrote below ``path``."""
    system, root = file_system(path)
    found = [i.path for i in system.get_file_info(fs.FileSelector(root)) if re.search(r"/batch=\d+$", i.path)]
    for old in sorted(found, key=lambda p: int(p.rsplit("=", 1)[1]))[:-keep]:
        system.delete_dir(old)


def latest_snapshot(spark, path: str) -> DataFrame:
    """The last written snapshot."""
    batches = spark.read.parquet(path)
    newest = batches.agg(F.max("batch")).scalar()
    return batches.filter(F.col("batch") == newest).drop("batch")
