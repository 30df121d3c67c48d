"""Vessel positions: latest state, in-range registry and specification lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RANGE_LIMIT_M


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Last row per key.  ``max_by`` combines in the map tasks, so a ship with
    most of the rows still sends one row per task."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return best.select(key, "_s.*")


def in_range(df: DataFrame, key: str, order: list[Column], distance: str, limit: float = RANGE_LIMIT_M) -> DataFrame:
    """Ships whose last report off the limit lies inside it.

    Inside inserts or refreshes, outside removes, exactly at the limit changes
    nothing: so the last report that is not at the limit decides.
    """
    return latest(df.filter(F.col(distance) != limit), key, order).filter(F.col(distance) < limit)


def with_specs(ships: DataFrame, specs: DataFrame, key: str = "mmsi") -> DataFrame:
    return ships.join(specs, key, "left")


def missing_specs(ships: DataFrame, specs: DataFrame, key: str = "mmsi") -> DataFrame:
    return ships.join(specs, key, "left_anti")


def photo_for(ships: DataFrame, photos: DataFrame, key: str = "mmsi", photo: str = "key", pattern: str = r"(\d+)") -> DataFrame:
    """Ship to its last photo key that holds its id anywhere, as a whole run of digits.

    Every run of digits of a key is one row, so this is an equi-join of one row per id."""
    last = (
        photos.withColumn("_id", F.explode(F.array_distinct(F.regexp_extract_all(photo, F.lit(pattern), F.lit(1)))))
        .groupBy("_id")
        .agg(F.max(photo).alias("photo"))
    )
    return ships.join(last, F.col(key).cast("string") == F.col("_id"), "left").drop("_id")


def valid_specs(specs: DataFrame, required: list[str]) -> DataFrame:
    """Specification rows with every required field; one row per ship: of several the
    greatest by all other columns, so that reruns agree."""
    ok = specs.dropna(subset=required)
    if "mmsi" not in specs.columns:
        return ok
    rest = F.struct(*[c for c in specs.columns if c != "mmsi"])
    return ok.groupBy("mmsi").agg(F.max(rest).alias("_s")).select("mmsi", "_s.*").select(*specs.columns)


def round_specs(specs: DataFrame, columns: list[str]) -> DataFrame:
    return specs.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in columns})
