"""AIS sentences: armour, bit fields and position reports."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geo


# Navigation status texts, code 0 to 15.
NAV_STATUS = (
    "Under way using engine",
    "At anchor",
    "Not under command",
    "Restricted manoeuverability",
    "Constrained by her draught",
    "Moored",
    "Aground",
    "Engaged in fishing",
    "Under way sailing",
    "Reserved for HSC",
    "Reserved for WIG",
    "Reserved",
    "Reserved",
    "Reserved",
    "Reserved",
    "Not defined",
)

# Bit ranges [from, to) of a position report (message types 1-3).
FIELDS = {
    "msg_type": (0, 6),
    "mmsi": (8, 38),
    "nav_code": (38, 42),
    "sog": (50, 60),
    "lon": (61, 89),
    "lat": (89, 116),
    "cog": (116, 128),
    "heading": (128, 137),
}


# The armour is a 6-bit code like base64 with another alphabet.
_ARMOUR = "".join(map(chr, [*range(48, 88), *range(96, 120)]))
_BASE64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"

# Characters and bytes that hold every field of a position report.
_CHARS = -(-max(j for _, j in FIELDS.values()) // 6)
_PADDED = -(-_CHARS // 4) * 4


def payload_bytes(payload: Column) -> Column:
    """Leading payload characters as bytes; NULL when the report is too short."""
    head = F.translate(F.rpad(F.substring(payload, 1, _PADDED), _PADDED, "0"), _ARMOUR, _BASE64)
    return F.when(F.length(payload) >= _CHARS, F.unbase64(head))


def byte_ubits(data: Column, i: int, j: int) -> Column:
    """Unsigned value of bits [i, j) of a byte string (at most 56 bits)."""
    first, last = i // 8, (j - 1) // 8
    value = F.conv(F.hex(F.substring(data, first + 1, last - first + 1)), 16, 10).cast("long")
    return F.shiftright(value, 8 * (last + 1) - j).bitwiseAND(F.lit((1 << (j - i)) - 1).cast("long"))


def byte_sbits(data: Column, i: int, j: int) -> Column:
    """Two's complement value: the top bit is flipped, then its weight removed."""
    top = 1 << (j - i - 1)
    return byte_ubits(data, i, j).bitwiseXOR(F.lit(top).cast("long")) - top


def nav_status(code: Column) -> Column:
    table = F.array(*[F.lit(t) for t in NAV_STATUS])
    return F.try_element_at(table, (code + 1).cast("int"))


def is_position(line: Column) -> Column:
    """Sentence with a position report: AIVDM and message type 1, 2 or 3.

    The first payload character carries the type, so most sentences are dropped
    before any bit is unpacked.  Truncated payloads and payloads with characters
    outside the armour are no positions.
    """
    part = F.split(line, ",")
    payload = F.try_element_at(part, F.lit(6))
    whole = payload.rlike(f"^[0-3][0-W`-w]{{{_CHARS - 1},}}$")
    return (F.try_element_at(part, F.lit(1)) == "!AIVDM") & F.coalesce(whole, F.lit(False))


def decode_ais(df: DataFrame, line: str = "line", wrap: bool = False) -> DataFrame:
    """Sentences to positions; batch or streaming, no shuffle.

    Courses and headings that are not available are NULL; with ``wrap`` they are
    kept as sent, those above 360 less a full turn.
    """
    payload = F.try_element_at(F.split(F.col(line), ","), F.lit(6))
    keep = [c for c in df.columns if c != line]
    # ``inline`` makes a computed value a plain column: later filters and
    # expressions read it instead of computing it again.
    cut = df.filter(is_position(F.col(line))).select(*keep, F.inline(F.array(F.struct(payload_bytes(payload).alias("_data")))))
    fields = {
        n: (byte_sbits if n in ("lon", "lat") else byte_ubits)(F.col("_data"), *at) for n, at in FIELDS.items()
    }
    raw = cut.select(*keep, F.inline(F.array(F.struct(*[v.alias(n) for n, v in fields.items()]))))
    return raw.select(
        *keep,
        "mmsi",
        F.col("msg_type").cast("int").alias("msg_type"),
        nav_status(F.col("nav_code")).alias("nav_status"),
        (F.col("sog") / 10).alias("sog"),
        (F.col("lon") / 600000).alias("lon"),
        (F.col("lat") / 600000).alias("lat"),
        F.when(F.lit(wrap), geo.wrap360(F.col("cog") / 10)).when(F.col("cog") < 3600, F.col("cog") / 10).alias("cog"),
        F.when(F.lit(wrap), geo.wrap360(F.col("heading").cast("double")))
        .when(F.col("heading") < 360, F.col("heading").cast("double")).alias("heading"),
    )


def with_geometry(positions: DataFrame) -> DataFrame:
    """Add range, bearing, lane range and signed lane minutes."""
    lat, lon = F.col("lat"), F.col("lon")
    return positions.withColumns(
        {
            "range_m": geo.range_m(lat, lon),
            "bearing_deg": geo.bearing_deg(lat, lon),
            "lane_range_m": geo.range_m(lat, lon, geo.LANE_LAT, geo.LANE_LON),
            "lane_minutes": geo.lane_minutes(lat, lon, F.col("sog"), F.col("cog")),
        }
    )


def encode_position(**raw: Column) -> Column:
    """A type 1-3 sentence from raw integer fields, named as in ``FIELDS`` (used to
    test the decoder).  Three 48-bit words are put together from the parts of the
    fields they overlap."""
    words = []
    for at in range(0, 6 * _PADDED, 48):
        word = F.lit(0).cast("long")
        for name, (i, j) in FIELDS.items():
            lo, hi = max(i, at), min(j, at + 48)
            if lo < hi:
                part = F.shiftright(raw[name].cast("long"), j - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
                word = word + part * (1 << (at + 48 - hi))
        words.append(F.lpad(F.hex(word), 12, "0"))
    payload = F.translate(F.base64(F.unhex(F.concat(*words))), _BASE64, _ARMOUR)
    return F.concat(F.lit("!AIVDM,1,1,,A,"), payload, F.lit("0000,0*00"))
