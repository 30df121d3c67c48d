"""Session settings shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Chunks that ordered rows are cut into; the session's shuffle partitions where unset.
RANGE_CHUNKS_KEY = "spark.soundkeel.rangeChunks"
# Bytes that a side may have to be hinted for a broadcast.
BROADCAST_BYTES_KEY = "spark.soundkeel.broadcastBytes"
DEFAULT_BROADCAST_BYTES = 8 << 20


def range_chunks(spark: SparkSession) -> int:
    return int(spark.conf.get(RANGE_CHUNKS_KEY, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_KEY, None) or DEFAULT_BROADCAST_BYTES)


def pin_utc(spark: SparkSession) -> SparkSession:
    """All time arithmetic here is in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder, in one folder per application.

    Where ``spark.checkpoint.dir`` is unset, as in tests, a local master takes the session's warehouse; on a cluster that
    would be a disk of the driver's own, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    application = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/soundkeel/{application}/{purpose}-{uuid.uuid4().hex}"
