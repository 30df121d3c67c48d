"""Vessel sentences, positions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ais, geo
from ..operators import tracks as T
from .common import levels, r, table

LIMIT = 50.0


def sentences(spark, sf):
    """Events as position sentences: raw fields from the event, then armoured."""
    e, v = F.col("event_id"), F.col("value")
    ev = levels(spark, sf)
    line = ais.encode_position(
        msg_type=e % 3 + 1,
        mmsi=200_000_000 + F.col("user_id"),
        nav_code=e % 16,
        sog=F.least((v * 2).cast("long"), F.lit(1022)),
        lon=-123 * 600_000 - (e * 7919) % 300_000,
        lat=48 * 600_000 + (e * 104_729) % 600_000,
        cog=(e * 37) % 3_700,
        heading=(e * 13) % 512,
    )
    return ev.select("event_id", "t", F.inline(F.array(F.struct(line.alias("line")))))


RAW_SQL = """raw AS (
  SELECT event_id, epoch_us(ts) AS t, 200000000 + user_id AS mmsi, event_id % 3 + 1 AS msg_type, event_id % 16 AS nav,
         least(trunc(value * 2)::BIGINT, 1022) / 10.0::DOUBLE AS sog, (-123 * 600000 - (event_id * 7919) % 300000) / 600000.0::DOUBLE AS lon,
         (48 * 600000 + (event_id * 104729) % 600000) / 600000.0::DOUBLE AS lat,
         CASE WHEN (event_id * 37) % 3700 < 3600 THEN (event_id * 37) % 3700 / 10.0::DOUBLE END AS cog,
         CASE WHEN (event_id * 13) % 512 < 360 THEN ((event_id * 13) % 512)::DOUBLE END AS heading
  FROM events)"""
NAV_SQL = "list_extract([" + ", ".join("'" + t + "'" for t in ais.NAV_STATUS) + "], (nav + 1)::INT)"
GEO_SQL = f"""geo AS (
  SELECT *, {geo.EARTH_M} * radians(lat - {geo.HYDRO_LAT!r}::DOUBLE) AS n1,
         {geo.EARTH_M} * radians(lon - ({geo.HYDRO_LON!r})::DOUBLE) * cos(radians(lat)) AS e1,
         {geo.EARTH_M} * radians(lat - {geo.LANE_LAT!r}::DOUBLE) AS n2,
         {geo.EARTH_M} * radians(lon - ({geo.LANE_LON!r})::DOUBLE) * cos(radians(lat)) AS e2 FROM raw),
pos AS (
  SELECT *, sqrt(n1 * n1 + e1 * e1) AS range_m, CASE WHEN atan2(e1, n1) < 0 THEN degrees(atan2(e1, n1)) + 360 ELSE degrees(atan2(e1, n1)) END AS bearing_deg,
         sqrt(n2 * n2 + e2 * e2) AS lane_range_m,
         sqrt(n2 * n2 + e2 * e2) / (greatest(sog, 0.01::DOUBLE) * 0.514::DOUBLE * 60) *
           CASE WHEN coalesce((lat < {geo.LANE_LAT!r}::DOUBLE AND cog > 90 AND cog < 270)
                  OR (lat > {geo.LANE_LAT!r}::DOUBLE AND (cog > 270 OR cog < 90)), false) THEN -1 ELSE 1 END AS lane_minutes
  FROM geo)"""


def feed(spark, sf):
    """The sentences as a receiver hears them: some foreign, cut off, damaged or of another type."""
    e, line = F.col("event_id"), F.col("line")
    heard = F.when(e % 11 == 3, F.regexp_replace(line, "^!AIVDM", "!BSVDM")).when(e % 13 == 5, F.substring(line, 1, 30))
    heard = heard.when(e % 17 == 7, F.concat(F.substring(line, 1, 20), F.lit("X"), F.substring(line, 22, 100)))
    heard = heard.when(e % 19 == 2, F.regexp_replace(line, "A,[0-3]", "A,5")).when(e % 23 == 1, F.lit("")).otherwise(line)
    return sentences(spark, sf).withColumn("line", heard)


HEARD_SQL = "NOT (event_id % 11 = 3 OR event_id % 13 = 5 OR event_id % 17 = 7 OR event_id % 19 = 2 OR event_id % 23 = 1)"


def ais_decode(spark, sf):
    out = ais.decode_ais(feed(spark, sf).select("event_id", "line"))
    return out.withColumns({c: r(c) for c in ("lon", "lat")})


def ais_wrapped(spark, sf):
    """Courses and headings as sent, wrapped above a full turn."""
    out = ais.decode_ais(feed(spark, sf).select("event_id", "line"), wrap=True)
    return out.select("event_id", r("cog", 1).alias("cog"), "heading")


def ship_geometry(spark, sf):
    pos = ais.with_geometry(ais.decode_ais(sentences(spark, sf).select("event_id", "line")))
    return pos.select("event_id", *[r(c, 4).alias(c) for c in ("range_m", "bearing_deg", "lane_range_m", "lane_minutes")])


def ships_in_range(spark, sf):
    """Registry from decoded sentences, 20 km around the lane point."""
    pos = ais.with_geometry(ais.decode_ais(sentences(spark, sf)))
    out = T.in_range(pos, "mmsi", [F.col("t"), F.col("event_id")], "lane_range_m", 20_000.0)
    return out.select("mmsi", "event_id", "nav_status", r("range_m", 4).alias("range_m"), r("lane_minutes", 4).alias("lane_minutes"))


def latest_state(spark, sf):
    return T.latest(levels(spark, sf), "user_id", [F.col("t"), F.col("event_id")])


def in_range_registry(spark, sf):
    out = T.in_range(levels(spark, sf), "user_id", [F.col("t"), F.col("event_id")], "value", LIMIT)
    return out.select("user_id", "event_id", "event_type", "value", "t")


def _ships(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("mmsi")).distinct()


def _specs(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0")
    return c.select(
        F.col("c_custkey").alias("mmsi"), F.col("c_name").alias("shipname"), F.col("c_mktsegment").alias("shiptype"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("avespeed"),
    )


def _full_specs(spark, sf):
    """Customers as specification rows of 16 fields, some incomplete, some twice."""
    key = F.col("c_custkey")
    flags = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("flag"))
    c = table(spark, sf, "customer").filter("c_acctbal > 0").join(F.broadcast(flags), "c_nationkey", "left")  # 25 nations
    rows = c.select(
        key.alias("id"), key.alias("mmsi"), F.col("c_name").alias("shipname"), F.col("c_mktsegment").alias("shiptype"),
        F.when(key % 7 != 0, 1950 + key % 70).alias("yearbuild"), (key % 300).alias("shiplength"), (key % 40).alias("shipwidth"),
        (key * 10).alias("deadweight"), (F.col("c_acctbal") / 100).alias("maxspeed"), F.col("c_acctbal").alias("avespeed"), "flag",
        F.concat(F.lit("C"), key).alias("callsign"), F.when(key % 13 != 0, key + 9_000_000).alias("imo"), (key % 12).alias("draught"),
        (key % 20).alias("draughtmax"), F.concat(F.lit("ship_"), key, F.lit(".jpg")).alias("photo"),
    )
    again = rows.filter("mmsi % 5 = 0").withColumns({"id": F.col("id") + 1_000_000, "shiptype": F.lit("REFIT")})
    return rows.unionByName(again)


def ship_lookup(spark, sf):
    """Ships in the feed with specification and flag; missing and incomplete ones stay NULL."""
    specs = _full_specs(spark, sf)
    specs = T.valid_specs(specs, specs.columns)
    return T.with_specs(_ships(spark, sf), T.round_specs(specs, ["maxspeed", "avespeed"])).select(
        "mmsi", "id", "shipname", "shiptype", "yearbuild", "maxspeed", "flag", "avespeed", "imo"
    )


def ship_missing(spark, sf):
    return T.missing_specs(_ships(spark, sf), _specs(spark, sf))


def ship_counts(spark, sf):
    """Reports of ships with and without a specification."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("mmsi"))
    j = T.with_specs(ev, _specs(spark, sf).select("mmsi", "shiptype"))
    return j.groupBy("shiptype").agg(
        F.count(F.lit(1)).alias("reports"), F.countDistinct("mmsi").alias("ships")
    )


def photo_contains(spark, sf):
    ships = table(spark, sf, "customer").select(F.col("c_custkey").alias("mmsi"))
    album = F.concat(F.lit("album_"), F.col("page_id") % 50, F.lit("/"), F.col("url"))
    return T.photo_for(ships, table(spark, sf, "pages").select(album.alias("key")))


QUERIES = {
    "ais_decode": (ais_decode, f"""WITH {RAW_SQL}
SELECT event_id, mmsi, msg_type, {NAV_SQL} AS nav_status, sog, round(lon, 6) AS lon, round(lat, 6) AS lat, cog, heading FROM raw
WHERE {HEARD_SQL}"""),
    "ais_wrapped": (ais_wrapped, f"""WITH w AS (SELECT event_id, (event_id * 37) % 3700 / 10.0::DOUBLE AS c, ((event_id * 13) % 512)::DOUBLE AS h FROM events WHERE {HEARD_SQL})
SELECT event_id, round(CASE WHEN c > 360 THEN c - 360 ELSE c END, 1) AS cog, CASE WHEN h > 360 THEN h - 360 ELSE h END AS heading FROM w"""),
    "ship_geometry": (ship_geometry, f"""WITH {RAW_SQL}, {GEO_SQL}
SELECT event_id, round(range_m, 4) AS range_m, round(bearing_deg, 4) AS bearing_deg, round(lane_range_m, 4) AS lane_range_m,
       round(lane_minutes, 4) AS lane_minutes FROM pos"""),
    "ships_in_range": (ships_in_range, f"""WITH {RAW_SQL}, {GEO_SQL},
q AS (SELECT * FROM pos WHERE lane_range_m <> 20000 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, event_id DESC) = 1)
SELECT mmsi, event_id, {NAV_SQL} AS nav_status, round(range_m, 4) AS range_m, round(lane_minutes, 4) AS lane_minutes FROM q
WHERE lane_range_m < 20000"""),
    "latest_state": (latest_state, """SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""),
    "in_range_registry": (in_range_registry, f"""WITH q AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t FROM events WHERE value <> {LIMIT}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT * FROM q WHERE value < {LIMIT}"""),
    "ship_lookup": (ship_lookup, """SELECT s.mmsi, c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1000000 ELSE 0 END AS id, c_name AS shipname,
  CASE WHEN c_custkey % 5 = 0 THEN 'REFIT' ELSE c_mktsegment END AS shiptype, 1950 + c_custkey % 70 AS yearbuild, round(c_acctbal / 100, 2) AS maxspeed,
  n_name AS flag, round(c_acctbal, 2) AS avespeed, c_custkey + 9000000 AS imo
FROM (SELECT DISTINCT user_id AS mmsi FROM events) s
LEFT JOIN (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey
           WHERE c_acctbal > 0 AND c_custkey % 7 <> 0 AND c_custkey % 13 <> 0) c ON c.c_custkey = s.mmsi"""),
    "ship_missing": (ship_missing, """SELECT DISTINCT user_id AS mmsi FROM events
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""),
    "ship_counts": (ship_counts, """SELECT c_mktsegment AS shiptype, count(*) AS reports, count(DISTINCT user_id) AS ships
FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0 GROUP BY 1"""),
    "photo_contains": (photo_contains, """WITH k AS (SELECT 'album_' || (page_id % 50) || '/' || url AS key FROM pages),
p AS (SELECT id, max(key) AS photo FROM (SELECT key, unnest(regexp_extract_all(key, '\\d+')) AS id FROM k) GROUP BY 1)
SELECT c_custkey AS mmsi, photo FROM customer LEFT JOIN p ON p.id = c_custkey::VARCHAR"""),
}
