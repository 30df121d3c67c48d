"""Secret scans with ownership counted over the corpus.

Every whole text is scanned once for base patterns and for candidates: long tokens of
mixed letters and digits with a high entropy.  Values leave the scan as 128-bit hashes.  Over
the whole corpus the distinct owners and repositories of each hash are counted: a
value that many owners or many repositories have is a copied example, one that few of both have is
live-looking.  Equal texts count as one repository.  Live-looking candidates become spans beside the base ones, which always stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UID, content_keys, stored

#: Kinds in the order of equal starts; the last one is the method's.
KINDS = ("assign", "access", "hex", "owned")
#: A value with more owners than this is a copied example.
MAX_OWNERS = 2
#: And so is one that is in more repositories, however few their owners are.
MAX_REPOS = 10
MIN_LENGTH, MIN_ENTROPY = 20, 3.5

_NAMES = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word)


_ASSIGN = re.compile(
    "(?:" + "|".join(map(_either_case, _NAMES)) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
_HEX = re.compile("[0-9a-f]{32,}")
_TOKEN = re.compile(f"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, per kind leftmost and not overlapping."""
    out = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return out


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens that look like credentials and touch no base span: one walk along the tokens and the spans by start."""
    out, spans, at, reach = [], sorted(taken), 0, 0
    for m in _TOKEN.finditer(text):
        # reach: the furthest end of the spans that start before the token ends
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        v = m[0]
        if reach <= m.start() and _DIGIT.search(v) and _LETTER.search(v) and entropy(v) >= MIN_ENTROPY:
            out.append((m.start(), 3, m.end(), v))
    return out


_SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()),
    T.StructField("value", T.BinaryType()),
]))


@F.arrow_udf(_SPANS)
def _scan(column: pa.Array) -> pa.Array:
    sizes, rows = [0], []
    for text in column.to_pylist():
        if text:
            base = base_spans(text)
            rows += sorted(base + candidates(text, base))
        sizes.append(len(rows))
    cols = list(zip(*rows)) if rows else [[]] * 4
    flat = pa.StructArray.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
         pa.array([xxhash.xxh3_128_digest(v.encode()) for v in cols[3]], pa.binary())],
        names=["start", "kind", "end", "value"],
    )
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos) of every value; distinct owners and repositories are combined in the map tasks.

    Equal texts (128 bits of them, _k1 and _k2) are in one repository, the least of theirs.
    """
    flat = found.select("_owner", "_repo", "_k1", "_k2", F.explode("_found.value").alias("value"))
    owners = flat.groupBy("value", "_owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.sum("one").alias("n_owners"))
    texts = flat.groupBy("value", "_k1", "_k2").agg(F.min("_repo").alias("_repo"))
    repos = texts.groupBy("value", "_repo").agg(F.lit(1).alias("one")).groupBy("value").agg(F.sum("one").alias("n_repos"))
    return owners.join(repos, "value")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])

    def line(x: Column) -> Column:
        return F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))

    return F.array_join(F.transform(spans, line), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, ownership).  Rows, stored: _uid, _id, _owner, _repo, _k1, _k2 and _found, the spans sorted by start and kind."""
    docs = df.select(
        F.monotonically_increasing_id().alias(UID), F.col(id_col).alias("_id"), F.col(owner).cast("string").alias("_owner"),
        F.col(repo).cast("string").alias("_repo"), *content_keys([text]), _scan(F.col(text)).alias("_found"),
    )
    found = stored(docs, "secrets-found")
    return found, stored(ownership(found), "secrets-owners")


def find_secrets(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
    max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS,
) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_owned and n_live of every row.

    spans: kind:start:end in code points.  n_owned: spans that the method adds;
    n_live: base spans whose value no more than ``max_owners`` owners and ``max_repos``
    repositories have.  Null and empty
    texts have none; a null owner or repository is one of its own; repeated rows are reported each.
    """
    found, owners = scan(df, id_col, text, owner, repo)
    flat = found.filter(F.size("_found") > 0).select(UID, F.explode("_found").alias("x")).select(UID, "x.*")
    few = flat.join(owners.filter((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)), "value")
    few = few.groupBy(UID).agg(  # as many as the text has spans
        F.collect_list(F.when(F.col("kind") == len(KINDS) - 1, F.struct("start", "kind", "end"))).alias("owned"),
        F.sum((F.col("kind") < len(KINDS) - 1).cast("long")).alias("n_live"),
    )
    base = F.transform(F.filter("_found", lambda x: x["kind"] < len(KINDS) - 1), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    out = found.select(UID, "_id", base.alias("base")).join(few.withColumnRenamed(UID, "_u"), F.col(UID) == F.col("_u"), "left")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    owned = F.coalesce("owned", empty)

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return out.withColumn("base", F.coalesce("base", empty)).select(
        F.col("_id").alias(id_col), *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:-1])],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", owned))).alias("spans"),
        F.size(owned).cast("long").alias("n_owned"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )
