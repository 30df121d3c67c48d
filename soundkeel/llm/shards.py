"""Shards of nearly equal bytes by k-d tree partitioning, in DataFrame operations.

The rows' metadata (no text) spans a space of a few dimensions.  A node that has to
become k shards is split along the dimension in which its rows spread widest, where the
weighted quantile k_left / k of its bytes lies: the weighted median for even k.  All nodes
of a level are split in the same passes over the metadata:

* one aggregate finds every node's extent in each dimension;
* histograms of bytes over cells of that extent, refined inside the cell that holds the
  quantile until that cell is lighter than the tolerance, find the split value.

Cells combine in the map tasks, so a pass shuffles at most nodes x CELLS rows from a task.
A coordinate is a 32-bit value followed by 31 bits of a hash of the row, so equal
values (a source with a third of all rows) can be split anywhere.  The tree has one row per
split; the number of shards, a parameter, bounds it, and so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import UID, stored

SHARDS = 24
CELLS = 256
#: A split is accepted when at most this share of a shard's target bytes lies in its cell.
TOLERANCE = 0.001
_ROW_BITS = 31
#: Rows of a shard that are numbered together.
SLOT_BLOCK = 14


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def category(c: Column) -> Column:
    """A 32-bit value of a name; null is 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)).cast("long")


def magnitude(c: Column) -> Column:
    """A 32-bit value that grows with the logarithm of a number; null and negative numbers are 0."""
    return F.coalesce(F.floor(F.log1p(F.greatest(c.cast("double"), F.lit(0.0))) * 4e7), F.lit(0)).cast("long")


def _coordinates(values: Sequence[Column]) -> Column:
    tie = F.shiftrightunsigned(F.xxhash64(F.col(UID)), 64 - _ROW_BITS)
    return F.array(*[F.shiftleft(F.least(v, F.lit((1 << 32) - 1)), _ROW_BITS).bitwiseOR(tie) for v in values])


def _with_nodes(df: DataFrame, rows: Sequence[tuple], names: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` joined by node with a small table of numbers (at, ...); its rows are bounded by the number of shards."""
    if len(rows) == 1:  # the root: its values are constants
        here = F.col("node") == rows[0][0]
        out = df.filter(here) if how == "inner" else df
        return out.withColumns({n: F.when(here, F.lit(v if isinstance(v, float) else int(v)).cast(
            "double" if isinstance(v, float) else "long")) for n, v in zip(names, rows[0])})
    values = ", ".join("(" + ", ".join(repr(x) if isinstance(x, float) else f"{x}L" for x in r) + ")" for r in rows)
    table = df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return df.join(F.broadcast(table), F.col("node") == F.col("at"), how)


def _at(dim: Column) -> Column:
    return F.element_at("p", (dim + 1).cast("int"))


def _placed(rows: DataFrame, splits: list[tuple]) -> DataFrame:
    """Adds node: where the splits so far lead a row, level by level."""
    out = rows.withColumn("node", F.lit(1).cast("long"))
    for level in sorted({t[0] for t in splits}):
        out = _with_nodes(out, [t[1:] for t in splits if t[0] == level], ("at", "dim", "cut"), "left")
        right = (_at(F.col("dim")) > F.col("cut")).cast("long")
        out = out.withColumn("node", F.when(F.col("at").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right))
        out = out.drop("at", "dim", "cut")
    return out


def _extents(placed: DataFrame, dims: int) -> dict[int, tuple[int, list[int], list[int]]]:
    """node -> bytes, lowest and highest coordinates; one row for each node."""
    ends = [f(F.element_at("p", d + 1)) for f in (F.min, F.max) for d in range(dims)]
    rows = placed.groupBy("node").agg(F.sum("size"), *ends).collect()
    return {r[0]: (r[1], list(r[2 : 2 + dims]), list(r[2 + dims :])) for r in rows}


def _cut(placed: DataFrame, state: dict[int, list], tolerance: float) -> dict[int, tuple[int, int]]:
    """node -> (dimension, cut): rows at or below the cut go left.

    state: node -> [dimension, lowest, highest, bytes wanted left, bytes per shard].
    Each pass looks at cells of the nodes' present ranges and moves into the cell that
    holds the wanted quantile, down to the values that occur in it.
    """
    out = {}
    while state:
        cells = [(n, d, lo, -(-(hi - lo + 1) // CELLS), float(goal)) for n, (d, lo, hi, goal, _) in state.items()]
        live = _with_nodes(placed, cells, ("at", "dim", "lo", "width", "goal"))
        live = live.withColumn("x", _at(F.col("dim")))
        cell = F.when(F.col("x") < F.col("lo"), -1).otherwise(F.least(F.expr("(x - lo) div width"), F.lit(CELLS)))
        sums = live.groupBy("node", "goal", cell.alias("cell")).agg(
            F.sum("size").alias("w"), F.min("x").alias("first"), F.max("x").alias("last")
        )
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("cell"))
        hit = sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("goal"))
        found = hit.groupBy("node").agg(F.min(F.struct("cell", "w", "upto", "first", "last")).alias("f")).collect()
        for n, f in found:
            d, _, _, goal, share = state.pop(n)
            if f["w"] <= share * tolerance or f["first"] == f["last"]:
                # the cell goes to the side that comes nearer
                more, less = f["upto"] - goal, goal - (f["upto"] - f["w"])
                out[n] = (d, f["last"] if more <= less else f["first"] - 1)
            else:
                state[n] = [d, f["first"], f["last"], goal, share]
    return out


def tree(rows: DataFrame, dims: int, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[list[tuple], dict[int, int]]:
    """Splits (level, node, dimension, cut), and the shard of each leaf.

    ``rows``: p (coordinates) and size, stored.  The spread of a dimension counts
    in relation to its spread in the whole table.
    """
    splits: list[tuple] = []
    leaf: dict[int, int] = {}
    level, todo, whole = 0, {1: (0, shards)}, None
    while todo:
        for n in [n for n, (_, k) in todo.items() if k == 1]:
            leaf[n] = todo.pop(n)[0]
        placed, state, after = _placed(rows, splits), {}, {}
        extents = _extents(placed, dims) if todo else {}
        for n, (first, k) in todo.items():
            if n in extents:
                total, lo, hi = extents[n]
                spans = [h - x for x, h in zip(lo, hi)]
                whole = whole or [max(x, 1) for x in spans]
                d = max(range(dims), key=lambda i: (spans[i] / whole[i], -i))
                state[n] = [d, lo[d], hi[d], total * (k // 2) / k, total / k]
            after[2 * n], after[2 * n + 1] = (first, k // 2), (first + k // 2, k - k // 2)
        cuts = _cut(placed, state, tolerance)
        splits += [(level, n, *cuts.get(n, (0, 0))) for n in todo]
        level, todo = level + 1, after
    return splits, leaf


def sharded(rows: DataFrame, dims: int, shards: int = SHARDS) -> DataFrame:
    """Adds shard to stored rows with p, size and the row id."""
    splits, leaf = tree(rows.select("p", "size"), dims, shards)
    out = _with_nodes(_placed(rows, splits), list(leaf.items()), ("at", "_shard"))
    return out.withColumn("shard", F.col("_shard").cast("int")).drop("node", "at", "p", "_shard")


def with_slots(out: DataFrame) -> DataFrame:
    """Adds slot: rows of a shard numbered from 0 without gaps, in the order of the row ids.

    Numbers are given within blocks of row ids; a sum over the blocks gives what lies before.
    """
    block = F.shiftright(F.col(UID), SLOT_BLOCK)
    out = out.withColumn("_block", block)
    sizes = out.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("shard", "_block", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(UID)) - 1
    out = out.withColumn("_inside", inside).join(sizes, ["shard", "_block"])
    return out.withColumn("slot", (F.col("_ahead") + F.col("_inside")).cast("long")).drop("_block", "_ahead", "_inside")


def shard_documents(df: DataFrame, shards: int = SHARDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row; law ``bytes``.

    size is the text's UTF-8 bytes plus 8 (null: 8).  The dimensions are language,
    source, the magnitude of the size and the id where ``df`` has them; nulls count
    as 0.  Repeated rows are placed each.  An empty table gives no rows.
    """
    size = text_bytes(F.col(text)) + 8
    dims = [magnitude(size), *[category(F.col(c)) for c in ("lang", "source") if c in df.columns], category(F.col(id_col))]
    rows = df.select(
        F.monotonically_increasing_id().alias(UID), F.col(id_col).alias("_id"), size.alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), *[d.alias(f"_d{i}") for i, d in enumerate(dims)],
    )
    rows = rows.withColumn("p", _coordinates([F.col(f"_d{i}") for i in range(len(dims))])).drop(*[f"_d{i}" for i in range(len(dims))])
    out = with_slots(sharded(stored(rows, "shards-rows"), len(dims), shards))
    return out.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


def shard_rows(df: DataFrame, shards: int = SHARDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with a column shard (an existing one is replaced).

    Null and empty texts have size 8; null languages, sources and ids count as 0; repeated rows are placed each, not
    always together; a text longer than a shard's share is in one shard; an empty table gives no rows.
    """
    keep = [c for c in df.columns if c != "shard"]
    size = text_bytes(F.col(text)) + 8
    dims = [magnitude(size), *[category(F.col(c)) for c in ("lang", "source") if c in df.columns], category(F.col(id_col))]
    rows = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"), F.monotonically_increasing_id().alias(UID), size.alias("size"),
        *[d.alias(f"_d{i}") for i, d in enumerate(dims)],
    )
    rows = rows.withColumn("p", _coordinates([F.col(f"_d{i}") for i in range(len(dims))])).drop(*[f"_d{i}" for i in range(len(dims))])
    out = sharded(stored(rows, "shards-rows"), len(dims), shards)
    return out.select("_row.*", "shard")
