"""Keyed registry of the ships in range, which forgets them.

A state processor holds four numbers per ship: when it was last heard, whether it is inside, and
when that ends.  A report inside the limit enters or refreshes a ship, one outside removes it, one exactly at the limit
leaves it as it is.  A ship that is not heard for ``silence`` of event time leaves as well: its timer fires when the
watermark gets there.  What leaves is removed from the state, so the state follows the ships in range, not all
ships ever met.

Reports of a ship count in event time; one that comes after a later one of its ship was taken changes nothing,
nor does one behind the watermark.  So that this holds for ships that have left, their last time stays
until the watermark has passed it.

Only changes are written, once per trigger; the registry is the last change of each ship, and every so many triggers
they are folded into a base, at a cost of the registry's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.geo import RANGE_LIMIT_M
from ..functions.times import micros
from ..sources.files import file_system

ENTER, REFRESH, LEAVE, SILENT = "enter", "refresh", "leave", "silent"
SILENCE, DELAY = "30 minutes", "10 minutes"
#: Triggers whose changes are read beside the base.
FOLD_EVERY = 20
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
# Columns handed to the processor have no leading underscore, which Spark would rename.
_STATE = "heard long, seq long, inside boolean, due long"


class Fleet(StatefulProcessor):
    """Changes of one ship.  Rows: key, at_t (microseconds), at_seq, at_distance, at_row (the report as JSON)."""

    def __init__(self, key: str, limit: float, silence_us: int):
        self.key, self.limit, self.silence = key, limit, silence_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ship = handle.getValueState("ship", _STATE)

    def _told(self, key, changes: list[tuple]) -> pd.DataFrame:
        """Rows of (t, seq, change, report)."""
        out = pd.DataFrame(changes, columns=["at_t", "at_seq", "change", "at_row"])
        out.insert(0, self.key, [key[0]] * len(out))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heard, seq, inside, due = self.ship.get() if self.ship.exists() else (None, None, False, None)
        pieces = [p for p in rows if len(p)]
        if not pieces:
            return
        t, s, d = (np.concatenate([p[c].to_numpy() for p in pieces]) for c in ("at_t", "at_seq", "at_distance"))
        told, refreshed = [], None
        for i in np.lexsort((s, t)).tolist():
            now, turn = int(t[i]), int(s[i])
            if heard is not None and (now, turn) <= (heard, seq):
                continue
            if inside and now - heard >= self.silence:
                told.append((heard + self.silence, seq, SILENT, None))
                inside, refreshed = False, None
            if d[i] < self.limit:
                if inside:
                    refreshed = now, turn, REFRESH, i
                else:
                    told.append((now, turn, ENTER, i))
                inside = True
            elif d[i] > self.limit:
                if inside:
                    told.append((now, turn, LEAVE, i))
                inside, refreshed = False, None
            heard, seq = now, turn
        if refreshed:
            told.append(refreshed)
        if heard is not None:
            ends = -(-(heard + (self.silence if inside else 0)) // 1000)
            if due is not None and due != ends:
                self.handle.deleteTimer(due)
            if due != ends:
                self.handle.registerTimer(ends)
            self.ship.update((heard, seq, inside, ends))
        if told:
            texts = np.concatenate([p["at_row"].to_numpy() for p in pieces])
            yield self._told(key, [(*x[:3], None if x[3] is None else texts[x[3]]) for x in told])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ship.exists():
            return
        heard, seq, inside, due = self.ship.get()
        if due > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.ship.clear()
        if inside:
            yield self._told(key, [(heard + self.silence, seq, SILENT, None)])

    def close(self) -> None:
        pass


def changes(
    stream: DataFrame, key: str, time: str, seq: str, distance: str, limit: float = RANGE_LIMIT_M, silence: str = SILENCE, delay: str = DELAY
) -> DataFrame:
    """Every enter, leave and silence of a ship, and per trigger its last refresh: key, time, change, seq and the report's columns.

    ``time`` is a timestamp; ``seq`` orders reports of a ship with equal times.  Reports without key, time or
    distance are passed over.  Silences have no report: they happen ``silence`` after the last one.  Needs the
    RocksDB state store provider.
    """
    rest = [c for c in stream.columns if c not in (key, time, seq)]
    heard = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(distance).isNotNull() & ~F.isnan(F.col(distance).cast("double")))
    rows = heard.withWatermark(time, delay).select(
        key, time, F.unix_micros(time).alias("at_t"), F.coalesce(F.col(seq).cast("long"), F.lit(0)).alias("at_seq"),
        F.col(distance).cast("double").alias("at_distance"), F.to_json(F.struct(*rest), _FORMATS).alias("at_row"),
    )
    schema = T.StructType([
        T.StructField(key, stream.schema[key].dataType), T.StructField("at_t", T.LongType()), T.StructField("at_seq", T.LongType()),
        T.StructField("change", T.StringType()), T.StructField("at_row", T.StringType()),
    ])
    told = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Fleet(key, float(limit), micros(silence)), outputStructType=schema, outputMode="Update", timeMode="EventTime"
    )
    report = F.from_json("at_row", T.StructType([stream.schema[c] for c in rest]), _FORMATS)
    told = told.withColumn("_report", report)
    return told.select(key, F.timestamp_micros("at_t").alias(time), "change", F.col("at_seq").alias(seq), *[F.col(f"_report.{c}").alias(c) for c in rest])


def keep(told: DataFrame, path: str, checkpoint: str, key: str, every: str | None = "60 seconds", fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Writes the changes of every trigger below ``path``; ``every=None`` takes what is there and stops.

    A repeated trigger replaces its own folder.
    """
    order = [c for c in told.columns if c != key][:3]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        if fold_every and batch_id % fold_every == fold_every - 1:
            fold(batch.sparkSession, path, key, order, batch_id)

    writer = told.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def log(spark: SparkSession, path: str) -> DataFrame:
    """The changes that are not folded away, with the trigger that wrote them."""
    return spark.read.parquet(f"{path}/changes")


def _bases(path: str) -> list[int]:
    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(m[1]) for m in (re.search(r"/base=(\d+)$", i.path) for i in found) if m)


def _last(spark: SparkSession, path: str, key: str, order: list[str], upto: int | None = None) -> DataFrame:
    """The last change of every ship, from the newest base and the changes after it."""
    rows, bases = log(spark, path), _bases(path)
    rows = rows.withColumn("batch", F.col("batch").cast("long"))
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    if bases:
        rows = rows.filter(F.col("batch") > bases[-1])
        rows = spark.read.schema(rows.schema).parquet(f"{path}/base={bases[-1]}").unionByName(rows)
    time, change, seq = order
    # at one time a silence comes before the report that ends it
    place = F.struct("batch", time, F.col(change) != SILENT, seq)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), place).alias("_s"))
    return best.select(key, "_s.*").filter(F.col(change).isin(ENTER, REFRESH))


def fold(spark: SparkSession, path: str, key: str, order: list[str], batch_id: int) -> None:
    """Writes the registry as of a trigger; what lies before the previous base is no longer needed.

    The previous base and the changes since stay for readers that are not done.
    """
    _last(spark, path, key, order, batch_id).write.mode("overwrite").parquet(f"{path}/base={batch_id}")
    system, root = file_system(path)
    bases = _bases(path)
    for old in bases[:-2]:
        system.delete_dir(f"{root}/base={old}")
    if len(bases) > 1:
        for i in system.get_file_info(fs.FileSelector(f"{root}/changes")):
            m = re.search(r"/batch=(\d+)$", i.path)
            if m and int(m[1]) <= bases[-2]:
                system.delete_dir(i.path)


def registry(spark: SparkSession, path: str, key: str, time: str, seq: str) -> DataFrame:
    """Ships in range, each with its last report inside."""
    return _last(spark, path, key, [time, "change", seq]).drop("change", "batch")
