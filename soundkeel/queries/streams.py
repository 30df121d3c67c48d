"""Streams over the events, which arrive by and by: every slot of time is landed and run to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import pin_utc, shared_dir
from ..streaming import fleet, traffic
from . import vessels
from .common import DAY0_US, DAY_US, r, table

# Days at which the landed slots end; the last takes the rest.
SLOT_ENDS = (9, 18)
SILENCE, DELAY = "12 hours", "1 hour"
SILENCE_US, DELAY_MS = 12 * 3600 * 1_000_000, 3600 * 1000
GAPS = {"BUILDING": 6 * 3600, "MACHINERY": 24 * 3600}
OTHER_GAP = 12 * 3600
WITHIN = "1 hour"
REPEAT_DAYS = 18  # from the first slot to the last: the sentence is forgotten by then


def _reports(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def _landed(spark, rows, start: Callable[[str], StreamingQuery]) -> None:
    """Lands the rows slot by slot in a folder and runs the stream over it after each; it goes on from its checkpoint."""
    folder = shared_dir(spark, "landing")
    day = (F.unix_micros("ts") - DAY0_US) / DAY_US
    for lo, hi in zip((0, *SLOT_ENDS), (*SLOT_ENDS, None)):
        slot = rows.filter(day >= lo) if hi is None else rows.filter((day >= lo) & (day < hi))
        slot.write.mode("append").parquet(folder)
        start(folder).awaitTermination()


def _rocks(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def _fleet(spark, sf, fold_every: int) -> str:
    """The folder of a registry kept over the events."""
    pin_utc(spark)
    _rocks(spark)
    rows = _reports(spark, sf)
    out, state = shared_dir(spark, "fleet"), shared_dir(spark, "fleet-state")

    def start(folder: str) -> StreamingQuery:
        told = fleet.changes(
            spark.readStream.schema(rows.schema).parquet(folder), "user_id", "ts", "event_id", "value", vessels.LIMIT, SILENCE, DELAY
        )
        return fleet.keep(told, out, state, "user_id", every=None, fold_every=fold_every)

    _landed(spark, rows, start)
    return out


def fleet_registry(spark, sf):
    """Ships in range and heard within the silence, kept by a stream that forgets the others."""
    got = fleet.registry(spark, _fleet(spark, sf, 2), "user_id", "ts", "event_id")
    return got.select("user_id", "event_id", "event_type", "value", F.unix_micros("ts").alias("t"))


def fleet_changes(spark, sf):
    """When ships entered, left and fell silent."""
    got = fleet.log(spark, _fleet(spark, sf, 0)).filter(F.col("change") != fleet.REFRESH)
    return got.select("user_id", "change", F.unix_micros("ts").alias("t"), F.when(F.col("change") != fleet.SILENT, F.col("event_id")).alias("event_id"))


def _classed(spark, sf, rows):
    """Reports with the class of their ship; the classes of all ships are a static table."""
    classes = vessels._specs(spark, sf).select(F.col("mmsi").alias("user_id"), "shiptype")
    return rows.join(classes, "user_id", "left").withColumn("shiptype", F.coalesce("shiptype", F.lit("unknown")))


def _passages(rows):
    got = traffic.passages(rows, ["user_id", "shiptype"], "ts", traffic.gap_of(F.col("shiptype"), GAPS, OTHER_GAP), "value")
    return got.select("user_id", "shiptype", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "reports", "nearest")


def vessel_passages(spark, sf):
    """Passages of ships, with a gap that depends on the ship's class."""
    return _passages(_classed(spark, sf, _reports(spark, sf)))


def _appended(spark, rows, purpose: str, query: Callable):
    """What ``query`` of a stream of the landed rows has appended in the end."""
    pin_utc(spark)
    out, state = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-state")
    schema = []

    def start(folder: str) -> StreamingQuery:
        found = query(spark.readStream.schema(rows.schema).parquet(folder))
        schema.append(found.schema)
        return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()

    _landed(spark, rows, start)
    return spark.read.schema(schema[-1]).parquet(out)


def stream_passages(spark, sf):
    """Passages that are over by the watermark, appended by a stream."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return _appended(spark, _reports(spark, sf), "passages", lambda s: _passages(_classed(spark, sf, s.withWatermark("ts", DELAY))))


def _traffic(rows):
    got = traffic.traffic_counts(rows, ["event_type"], "ts", "value", vessels.LIMIT, "6 hours", "2 hours")
    return got.select("event_type", F.unix_micros("from_ts").alias("from_us"), "reports", "inside", "nearest")


def traffic_counts(spark, sf):
    """Traffic in sliding windows of six hours."""
    return _traffic(_reports(spark, sf))


def stream_traffic(spark, sf):
    """The closed windows of the traffic, appended by a stream."""
    return _appended(spark, _reports(spark, sf), "traffic", lambda s: _traffic(s.withWatermark("ts", DELAY)))


def stream_repeats(spark, sf):
    """Sentences that are heard again a minute later, by a second receiver, and two slots later, as new ones."""
    first = vessels.sentences(spark, sf).select("event_id", "line", F.timestamp_micros("t").alias("ts"), F.lit(0).alias("receiver"))
    again = first.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 MINUTE"), "receiver": F.lit(1)})
    early = F.unix_micros("ts") < DAY0_US + SLOT_ENDS[0] * DAY_US
    later = first.filter(early & (F.col("event_id") % 3 == 0)).withColumns({"ts": F.col("ts") + F.expr(f"INTERVAL {REPEAT_DAYS} DAYS"), "receiver": F.lit(2)})
    heard = first.unionByName(again).unionByName(later)
    got = _appended(spark, heard, "repeats", lambda s: traffic.without_repeats(s, "ts", ["event_id", "line"], WITHIN))
    return got.groupBy("event_id", "line").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("receiver") == 2).alias("late")).drop("line")


# the watermark after the last trigger, in milliseconds
_MARK = f"(SELECT epoch_ms(max(ts)) - {DELAY_MS} FROM events)"
_STATES = f"""ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t FROM events),
g AS (SELECT *, coalesce(t - lag(t) OVER u >= {SILENCE_US}, true)::INT AS cut, lead(t) OVER u AS next FROM ev WINDOW u AS (PARTITION BY user_id ORDER BY t, event_id)),
seg AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t, event_id) AS seg FROM g),
st AS (SELECT *, coalesce(last_value(CASE WHEN value <> {vessels.LIMIT} THEN value < {vessels.LIMIT} END IGNORE NULLS) OVER s, false) AS inside,
         last_value(CASE WHEN value <> {vessels.LIMIT} THEN event_id END IGNORE NULLS) OVER s AS decided
  FROM seg WINDOW s AS (PARTITION BY user_id, seg ORDER BY t, event_id)),
was AS (SELECT *, coalesce(lag(inside) OVER (PARTITION BY user_id, seg ORDER BY t, event_id), false) AS before,
          t + {SILENCE_US} <= CASE WHEN next IS NULL THEN {_MARK} * 1000 ELSE next END AS ends FROM st)"""
_CHANGES = f"""WITH {_STATES}
SELECT user_id, 'enter' AS change, t, event_id FROM was WHERE inside AND NOT before
UNION ALL SELECT user_id, 'leave', t, event_id FROM was WHERE NOT inside AND before
UNION ALL SELECT user_id, 'silent', t + {SILENCE_US}, NULL FROM was WHERE inside AND ends"""
_REGISTRY = f"""WITH {_STATES}
SELECT e.* FROM was w JOIN ev e ON e.user_id = w.user_id AND e.event_id = w.decided WHERE w.next IS NULL AND w.inside AND NOT w.ends"""
_GAP_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in GAPS.items()) + f" ELSE {OTHER_GAP} END::BIGINT * 1000000"
_PASSAGES = f"""p AS (SELECT user_id, coalesce(c_mktsegment, 'unknown') AS shiptype, epoch_us(ts) AS t, value, {_GAP_SQL} AS gap
  FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0),
q AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS no
  FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > gap, true)::INT AS cut FROM p)),
ps AS (SELECT user_id, shiptype, min(t) AS started, max(t) AS ended, count(*) AS reports, min(value) AS nearest, max(gap) AS gap
  FROM q GROUP BY user_id, shiptype, no)"""
_TRAFFIC = f"""t AS (SELECT event_type, from_us, count(*) AS reports, count(*) FILTER (value < {vessels.LIMIT}) AS inside, min(value) AS nearest
  FROM (SELECT event_type, value, (epoch_us(ts) // 7200000000 - k) * 7200000000 AS from_us FROM events, range(3) r(k)) GROUP BY 1, 2)"""

QUERIES = {
    "fleet_registry": (fleet_registry, _REGISTRY),
    "fleet_changes": (fleet_changes, _CHANGES),
    "vessel_passages": (vessel_passages, f"WITH {_PASSAGES} SELECT user_id, shiptype, started, ended, reports, nearest FROM ps"),
    "stream_passages": (stream_passages, f"WITH {_PASSAGES} SELECT user_id, shiptype, started, ended, reports, nearest FROM ps WHERE ended + gap <= {_MARK} * 1000"),
    "traffic_counts": (traffic_counts, f"WITH {_TRAFFIC} SELECT * FROM t"),
    "stream_traffic": (stream_traffic, f"WITH {_TRAFFIC} SELECT * FROM t WHERE from_us + 21600000000 <= {_MARK} * 1000"),
    "stream_repeats": (stream_repeats, f"""SELECT event_id, 1 + late AS n, late
FROM (SELECT event_id, (event_id % 3 = 0 AND epoch_us(ts) < {DAY0_US + SLOT_ENDS[0] * DAY_US})::INT AS late FROM events)"""),
}
