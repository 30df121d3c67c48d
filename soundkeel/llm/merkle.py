"""A Merkle manifest of a table: a tree of SHA-256 digests per group, and one tree over the groups.

Leaves of a group are numbered in order without gaps.  Range partitions of the (group, order) sequence are sorted;
one small row per partition and group gives every partition the numbers before it, so no task
sees a whole group.

Every three consecutive nodes (the last run: fewer) have the digest of their concatenation as parent.
Positions are hashed in blocks of 3**LEVELS, which no run crosses.  In the window over a block the node of a level
stands on the row of its first leaf, so its neighbours lie a fixed offset of 3**level rows away: lag and lead
columns, masked by the node's slot and the length of its run, are the siblings, and rows of first children hash
the parent.  All levels of a block share one shuffle and one sort.  Block roots are the next
round's leaves: a round has 3**LEVELS times fewer rows.  Paths are then handed down, round by round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.sizes import join_small
from .common import stored

FAN = 3
#: Levels hashed inside one window.
LEVELS = 6
BLOCK = FAN**LEVELS
#: About the rows of a range partition.
RANGE_ROWS = 20_000
#: Length of a digest as text.
_HEX = 64
_ROW_BITS = 33  # of monotonically_increasing_id


def digest(*texts: Column) -> Column:
    """SHA-256 of the concatenated texts, in lowercase hexadecimal."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 length and itself, or ``-`` for null; no two lists of fields look alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(node: Column, step: Column) -> Column:
        left = step["slot"] * _HEX
        return digest(F.substring(step["siblings"], F.lit(1), left), node, F.substring(step["siblings"], left + 1, F.lit(2 * _HEX)))

    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, from the leaf's to the root's children."""
    return digest(F.array_join(F.transform(path, lambda s: s["siblings"]), ""))


def _ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds _pos, the place of a row in its _key by ``order``, and _n, the rows of the _key; stored.

    Nulls come first; rows equal in ``order`` keep an arbitrary order.
    """
    rows = stored(rows, f"{name}-rows")
    by = ["_key", *order]
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    cut = rows.repartitionByRange(parts, *by, F.monotonically_increasing_id()).sortWithinPartitions(*by)
    cut = cut.withColumn("_at", F.monotonically_increasing_id())
    cut = cut.withColumn("_part", F.shiftright("_at", _ROW_BITS)).withColumn("_at", F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1))
    cut = stored(cut, f"{name}-cut")
    stats = cut.groupBy("_key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    so_far = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select(
        "_key", "_part", (F.coalesce(F.sum("_rows").over(so_far), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("_key")).alias("_n"),
    )
    out = join_small(cut, stats, ["_key", "_part"], spread=["_at"])
    return out.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _hashed(nodes: DataFrame) -> DataFrame:
    """Adds _block, _top (on a block's first row its root) and _steps (the path inside the block).

    ``nodes``: _key, _pos, _n and _node.
    """
    pos, n = F.col("_pos"), F.col("_n")
    rows = nodes.withColumn("_block", F.floor(pos / BLOCK).cast("long")).withColumn("_h0", F.col("_node"))
    w = Window.partitionBy("_key", "_block").orderBy("_pos")

    def slot(level: int) -> Column:
        return F.pmod(F.floor(pos / FAN**level), F.lit(FAN)).cast("int")

    for level in range(LEVELS):
        width = FAN**level
        node, own = F.col(f"_h{level}"), pos % width == 0
        rows = rows.withColumns(
            {"_prev2": F.lag(node, 2 * width).over(w), "_prev1": F.lag(node, width).over(w),
             "_next1": F.lead(node, width).over(w), "_next2": F.lead(node, 2 * width).over(w)}
        )
        count, at = F.ceil(n / width), slot(level)
        run = F.least(F.lit(FAN), count - (F.floor(pos / width) - at))
        one, two = F.when(run >= 2, F.col("_next1")).otherwise(""), F.when(run >= 3, F.col("_next2")).otherwise("")
        last = F.when(run >= 3, F.col("_next1")).otherwise("")
        siblings = F.when(at == 0, F.concat(one, two)).when(at == 1, F.concat(F.col("_prev1"), last)).otherwise(F.concat("_prev2", "_prev1"))
        rows = rows.withColumn(f"_s{level}", F.when(own & (count > 1), siblings))
        parent = F.when(count > 1, digest(node, F.col(f"_s{level}"))).otherwise(node)
        rows = rows.withColumn(f"_h{level + 1}", F.when(own & (at == 0), parent))
    # the row of an ancestor's first leaf is the last before one that holds siblings of its level
    ancestors = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_s{k}": F.last(f"_s{k}", ignorenulls=True).over(ancestors) for k in range(1, LEVELS)})
    steps = F.array(*[F.struct(slot(k).alias("slot"), F.col(f"_s{k}").alias("siblings")) for k in range(LEVELS)])
    rows = rows.withColumn("_steps", F.filter(steps, lambda s: s["siblings"].isNotNull())).withColumnRenamed(f"_h{LEVELS}", "_top")
    return rows.drop("_prev1", "_prev2", "_next1", "_next2", *[f"_h{k}" for k in range(LEVELS)], *[f"_s{k}" for k in range(LEVELS)])


def _climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, and the root (_key, _node) of every key."""
    rounds = []
    while True:
        rounds.append(nodes)
        first = _hashed(nodes).filter(F.col("_pos") % BLOCK == 0)
        tops = first.select("_key", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / BLOCK).alias("_n"), F.col("_top").alias("_node"))
        nodes = stored(tops, f"{name}-{len(rounds)}")
        if nodes.filter("_n > 1").isEmpty():
            return rounds, nodes.select("_key", "_node")


def _descend(rounds: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The first round's rows with _path and the columns of ``above``, one row per key with its own _path."""
    carried = [c for c in above.columns if c not in ("_key", "_path")]
    above = above.withColumn("_up", F.lit(0).cast("long"))
    for i in reversed(range(len(rounds))):
        up = above.select(F.col("_key").alias("_k"), "_up", F.col("_path").alias("_higher"), *carried)
        rows = _hashed(rounds[i]).drop("_top")
        rows = rows.join(up, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_up")))
        rows = rows.withColumn("_path", F.concat("_steps", "_higher")).drop("_k", "_up", "_higher", "_steps", "_block")
        if i:
            above = stored(rows.select("_key", F.col("_pos").alias("_up"), "_path", *carried), f"{name}-paths-{i}")
    return rows


def manifest(leaves: DataFrame, group: str, order: str, leaf: str) -> DataFrame:
    """Adds subroot, root and path to rows with a digest in ``leaf``.

    path is an array of (slot, siblings) from the leaf up to the root: the slot of the node among its run, and
    the digests of the others, left to right.  Groups are ordered by their text, null first, which is a group of its
    own; in a group null comes first, and of equal values the smaller leaf.  A group of one row
    is its own subroot; without rows there is nothing.  Other columns are carried along and should be small.
    """
    # a prefix keeps the order of the bytes and puts null before the empty text
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = leaves.select(F.struct(*[F.col(c) for c in leaves.columns]).alias("_row"), key.alias("_key"), F.col(order).alias("_o"), F.col(leaf).alias("_node"))
    rounds, subroots = _climb(_ranked(rows, ["_o", "_node"], "merkle-leaves"), "merkle")
    tree = subroots.select(F.lit("").alias("_key"), F.col("_key").alias("_group"), "_node")
    top, root = _climb(_ranked(tree, ["_group"], "merkle-groups"), "merkle-top")
    none = F.expr("CAST(array() AS array<struct<slot: int, siblings: string>>)")
    groups = _descend(top, root.select("_key", F.col("_node").alias("_root"), none.alias("_path")), "merkle-top")
    groups = groups.select(F.col("_group").alias("_key"), F.col("_node").alias("_subroot"), "_root", "_path")
    out = _descend(rounds, stored(groups, "merkle-subroots"), "merkle")
    return out.select("_row.*", F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))


def verify_documents(
    df: DataFrame, id_col: str = "doc_id", group: str = "source", others: Sequence[str] = ("lang", "n_chars"), text: str = "text"
) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Leaves hash id, group, the first of ``others``, the rest of them and the text.  A tampered copy of the
    rows, whose texts lose their line feeds where the CRC-32 of the decimal id is even, is then checked against the
    untampered tree: folded_root is what its leaf and the original siblings lead to, verified whether
    that is the root.  Null ids are not tampered with.  Null, empty and very long texts are hashed like any other;
    repeated rows are leaves of their own; other columns are left out; an empty table gives none.
    The texts are only scanned: digests are shuffled.
    """
    values = [F.col(id_col), F.col(group), *[F.col(c) for c in others]]
    hit = (F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0) & F.contains(F.col(text), F.lit("\n"))
    changed = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("_id"), F.col(group).alias("_group"), leaf_digest(*values, F.col(text)).alias("_leaf"),
        F.when(hit, leaf_digest(*values, changed)).alias("_tampered"),
    )
    out = manifest(rows, "_group", "_id", "_leaf").withColumn("_folded", fold(F.coalesce("_tampered", "_leaf"), F.col("path")))
    return out.select(
        F.col("_id").alias(id_col), F.col("_leaf").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        F.col("_folded").alias("folded_root"), (F.col("_folded") == F.col("root")).alias("verified"),
    )
