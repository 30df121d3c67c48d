"""Benchmark decontamination by winnowing.

Texts are word sequences.  A fingerprint is the least hash of the ``W`` consecutive
``K``-word grams of a window of ``WINDOW = K + W - 1`` words, so two texts that share a window
share its fingerprint: every shared span of WINDOW words or more is found.

1. Benchmark windows are listed with their fingerprints.
2. A Bloom filter of the benchmark's fingerprints, of bounded size, is sent to the tasks
   that scan the documents.  A document's windows whose fingerprint it may hold leave the
   scan with their text; all other words stay there.
3. Fingerprints are joined exactly; the hit is extended to the window, word by word, by equality
   of the window text.  Neighbouring windows extend it further, and their union is the span.

Equal benchmark windows are one row, and items with the same windows are one class, so a
passage that many items and many documents share never becomes pairs of documents and items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UID, bloom, content_keys, may_hold, mixed, raw, split_by, stored

K, W = 5, 6
WINDOW = K + W - 1
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_CACHE = 500_000  # distinct words whose hashes a task remembers
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    return _WORDS.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words; it tells lengths apart."""
    n = len(hashes) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = total * _STEP + hashes[i : i + n]
    return mixed(total)


def window_prints(hashes: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of every window of ``length`` words.

    Windows of WINDOW words have their least K-gram; shorter ones, for items of fewer
    words, their own hash.
    """
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    if length < WINDOW:
        return grams(hashes, length)
    g = grams(hashes, K)
    n = len(g) - W + 1
    least = g[:n]
    for i in range(1, W):
        least = np.minimum(least, g[i : i + n])
    return least


_WINDOW_ROW = T.ArrayType(T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("len", T.IntegerType()),
    T.StructField("gram", T.LongType()), T.StructField("words", T.StringType()),
]))


def _windows(lengths: Sequence[int], held: np.ndarray | None):
    """UDF: number of words, and the windows (those that the filter may hold, if there is one)."""

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("windows", _WINDOW_ROW)]))
    def udf(column: pa.Array) -> pa.Array:
        known = _Hashes()
        counts, sizes, rows = [], [0], []
        for text in raw(column):
            words = words_of(text) if text else []
            counts.append(len(words))
            found = 0
            if words:
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                for length in [min(WINDOW, len(words))] if held is None else lengths:
                    p = window_prints(h, length)
                    at = np.arange(len(p))
                    if held is not None:
                        at = may_hold(held, p)
                        p = p[at]
                    for a, g in zip(at.tolist(), p.view(np.int64).tolist()):
                        rows.append((a, length, g, b" ".join(words[a : a + length])))
                    found += len(at)
            sizes.append(sizes[-1] + found)
        cols = list(zip(*rows)) if rows else [[]] * 4
        flat = pa.StructArray.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.binary()).cast(pa.string())],
            names=["at", "len", "gram", "words"],
        )
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists], names=["n_words", "windows"])

    return udf


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (gram, words, len, class_id), and classes (class_id, items sorted as strings)."""
    made = items.select(F.col(id_col).cast("string").alias("item"), _windows((), None)(F.col(text)).alias("w"))
    flat = made.select("item", F.explode("w.windows").alias("x")).select("item", "x.gram", "x.words", "x.len")
    by = flat.groupBy("gram", "words", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by = stored(by.withColumn("class_id", F.xxhash64("items")), "winnow-benchmark")
    classes = stored(by.groupBy("class_id").agg(F.first("items").alias("items")), "winnow-classes")
    return by.drop("items"), classes


def scanned(df: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """Adds _w: the number of words of ``text`` and its candidate windows."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most WINDOW rows
    held = bloom(windows.select("gram").distinct())
    return df.withColumn("_w", _windows(lengths, held)(F.col(text)))


def matched(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(_uid, at, len, class_id) of the candidate windows of ``found`` that are benchmark windows."""
    flat = found.filter(F.size("_w.windows") > 0).select(UID, F.explode("_w.windows").alias("x"))
    flat = flat.select(UID, "x.at", "x.len", "x.gram", "x.words")
    return flat.join(windows, ["gram", "words", "len"]).select(UID, "at", "len", "class_id")


def decontaminate(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """id, n_words, n_hit, spans, n_items, items_sha256 and contaminated of every row.

    spans: word positions [start, end) of the hits, joined where they touch.  Null and
    empty texts have no words and no hits.  Null item ids mark words but count as no
    item; items without words occur nowhere; repeated items count once.  Repeated rows
    are reported each.
    """
    windows, classes = benchmark_windows(items, item_id, item_text)
    docs = df.select(F.monotonically_increasing_id().alias(UID), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    found = stored(scanned(docs, windows, "_text").drop("_text"), "winnow-found")
    per = matched(found, windows).groupBy(UID).agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("len")).alias("e")))).alias("all"),
        F.array_sort(F.collect_set("class_id")).alias("set"),
    )
    per = stored(per.select(UID, _joined(F.col("all")).alias("spans"), "set"), "winnow-hits")
    listed = per.select("set").distinct().select("set", F.explode("set").alias("class_id"))
    listed = listed.join(classes, "class_id").select("set", F.explode_outer("items").alias("item"))
    listed = listed.groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("sha"))
    per = per.join(listed, "set").select(F.col(UID).alias("_u"), "spans", "n_items", "sha")
    out = found.select(UID, "_id", F.col("_w.n_words").alias("n_words")).join(per, F.col(UID) == F.col("_u"), "left")
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce(length, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"), "spans",
    )


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
def _joined(column: pa.Array) -> pa.Array:
    """Sorted intervals, joined where they overlap or touch."""
    out = []
    for spans in column.to_pylist():
        done: list[dict] = []
        for x in spans:
            if done and x["s"] <= done[-1]["e"]:
                done[-1]["e"] = max(done[-1]["e"], x["e"])
            else:
                done.append(dict(x))
        out.append(done)
    return pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))


def clean_rows(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` without any benchmark window, with its columns.

    Whether a text is contaminated depends on the text alone, so rows are removed by
    128 bits of the text's hash; only rows that a Bloom filter of those takes for
    contaminated are shuffled.  Null texts stay.
    """
    windows, _ = benchmark_windows(items, item_id, item_text)
    keep = df.columns
    named = df.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(text).alias("_text"))
    found = scanned(named.drop("_row"), windows, "_text").filter(F.size("_w.windows") > 0)
    found = stored(found.select(F.monotonically_increasing_id().alias(UID), *content_keys(["_text"]), "_w"), "winnow-found")
    bad = found.join(matched(found, windows).select(UID).distinct(), UID, "left_semi").select("_k1", "_k2").distinct()
    bad = stored(bad, "winnow-bad")
    some, none = split_by(named.select("_row", *content_keys(["_text"])), "_k1", bad.select("_k1"))
    return none.select("_row.*").unionByName(some.join(bad, ["_k1", "_k2"], "left_anti").select("_row.*"))
