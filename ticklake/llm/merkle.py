"""A Merkle manifest of a table: a tree of 16 children per group, and a tree over the groups' roots.

Levels are strings. A node is 64 hex digits, so a level of a block of consecutive nodes is one string (kept as
its ASCII bytes, where a substring costs its own length only), and everything is a substring of fixed width:
a parent is the hash of 1,024 digits, the siblings of a node are what flanks it in these digits.

1. *Leaves*: a hash per row, rows numbered without gaps inside their group by key. Rows are dealt to ranges of
   (group, key, leaf) and numbered inside their range; ranges carry on from each other's totals, so a group
   of any size is never in one task.
2. *Blocks* of ``16 ** LEVELS`` consecutive nodes become one row with a string per level; the last is its top.
3. *Recursion*: the tops of a group are nodes of the same kind and form blocks in turn, until each group has one
   node, its root. The roots, in order of their groups, are the nodes of a last tree.

A proof is the list of pairs (digits left of the node, digits right of it) from the leaf to the root, put together
from the block's levels and the proof of its top. ``proofs`` gives them with every leaf; ``fold`` hashes a leaf up.

A level has a node per run of 16 nodes of the level below as long as that has several; a last run of one node is
hashed too. A block that is not a group's only one is always hashed through all its levels.

Edge cases: null columns hash as ``-``; texts by their bytes, so empty ones as ``0:``. A null key comes first; rows
of equal keys follow in order of their leaves, equal rows in any order. A null group is a group and comes
first. A group of one row has its leaf as root; with one group the group's root is the root; an empty
table gives no rows. Further columns are ignored, and inner names start with an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import join_same, numbered
from ticklake.session import cut

#: Levels of a block: 256 nodes, 16 kB of digits.
LEVELS = 2
FAN, DIGITS = 16, 64
RUN = FAN * DIGITS

PATH = "array<struct<left:binary,right:binary>>"


def digest(column: Column) -> Column:
    """Lowercase hex sha256 of bytes or text."""
    return F.sha2(column.cast("binary"), 256)


def item(column: Column | str) -> Column:
    """A value as leaves hash it: its length in bytes, a colon, its text; a dash for null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column | str]) -> Column:
    return digest(F.concat(*[item(c) for c in columns]))


def ordered_leaves(df: DataFrame, group: str, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """(group, key, _leaf, ...) -> the same with ``_pos``, the row's number in its group from 0, and ``_count``."""
    ranged = df.repartitionByRange(F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), "_leaf")
    # The range a row fell into is written with it, so a task that runs again numbers the same rows.
    held = cut(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_copy", F.monotonically_increasing_id()), "leaves")
    held = numbered(held, [group], [key, "_leaf", "_copy"], "_pos", chunk=F.col("_range"))
    counts = held.groupBy(group).agg(F.count("*").alias("_count"))
    return join_same(held.select(group, key, "_leaf", "_pos", *keep), counts, [group])


def _levels_needed(count: Column, levels: int) -> Column:
    """Levels that a block of a group with so many nodes is hashed through."""
    out = F.lit(levels)
    for k in range(levels - 1, -1, -1):
        out = F.when(count <= FAN**k, k).otherwise(out)
    return out


def _parents(level: Column) -> Column:
    """The next level of a block: the hash of each run of 16 nodes."""
    runs = F.ceil(F.octet_length(level) / F.lit(RUN)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), runs - 1), lambda r: F.sha2(F.substring(level, r * RUN + 1, F.lit(RUN)), 256))
    return F.array_join(hashes, "").cast("binary")


def _flanks(level: Column, i: Column) -> Column:
    """(left, right) of node i inside its run."""
    start = (i - i % FAN) * DIGITS
    right = (i + 1) * DIGITS
    return F.struct(
        F.substring(level, start + 1, i * DIGITS - start).alias("left"),
        F.substring(level, right + 1, start + RUN - right).alias("right"),
    )


def blocks(nodes: DataFrame, group: str, payload: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Nodes (group, _pos, _leaf, _count) -> a row per block: (group, _block, _count, _items, _n, _level0 ..., _top).

    ``_items`` holds the payload of each node in order.
    """
    size = FAN**levels
    held = F.struct(F.col("_pos"), F.col("_leaf"), (F.lit(None).cast("int") if payload is None else payload).alias("item"))
    rows = nodes.groupBy(group, F.expr(f"_pos DIV {size}").alias("_block")).agg(
        F.sort_array(F.collect_list(held)).alias("_nodes"), F.min("_count").alias("_count")
    )
    rows = rows.select(
        group,
        "_block",
        "_count",
        F.col("_nodes.item").alias("_items"),
        _levels_needed(F.col("_count"), levels).alias("_n"),
        F.array_join("_nodes._leaf", "").cast("binary").alias("_level0"),
    )
    for k in range(levels):
        rows = rows.withColumn(f"_level{k + 1}", F.when(F.col("_n") > k, _parents(F.col(f"_level{k}"))))
    top = F.element_at(F.array(*[F.col(f"_level{k}") for k in range(levels + 1)]), F.col("_n") + 1)
    return rows.withColumn("_top", top.cast("string"))


def _inner_path(i: Column, levels: int) -> Column:
    """The proof of node i of a block inside the block."""
    pairs = [_flanks(F.col(f"_level{k}"), F.floor(i / F.lit(FAN**k)).cast("int")) for k in range(levels)]
    return F.slice(F.array(*pairs), F.lit(1), F.col("_n"))


def _paths(nodes: DataFrame, group: str, levels: int) -> DataFrame:
    """(group, _pos, _leaf, _count) -> (group, _pos, _path, _root): the proof of each node, and its group's root."""
    tiers, most = [], nodes.agg(F.max("_count")).first()[0]
    size = FAN**levels
    while most is not None:
        tiers.append(cut(blocks(nodes, group, levels=levels), "tier"))
        if most <= size:
            break
        nodes = tiers[-1].where(F.col("_count") > size).select(
            group, F.col("_block").alias("_pos"), F.col("_top").alias("_leaf"), F.ceil(F.col("_count") / size).alias("_count")
        )
        most = -(-most // size)
    if not tiers:
        return nodes.select(group, "_pos", F.lit(None).cast(PATH).alias("_path"), F.col("_leaf").alias("_root"))

    above = None
    for tier in reversed(tiers):
        tier = _with_above(tier, above, group)
        each = F.transform(
            F.sequence(F.lit(0), (F.octet_length("_level0") / DIGITS).cast("int") - 1),
            lambda i: F.struct((F.col("_block") * size + i).alias("_pos"), F.concat(_inner_path(i, levels), F.col("_above")).alias("_path")),
        )
        above = tier.select(group, "_root", F.explode(each).alias("_e")).select(group, "_e._pos", "_e._path", "_root")
    return above


def _with_above(tier: DataFrame, above: DataFrame | None, group: str) -> DataFrame:
    """Blocks with the proof of their top and their group's root; a group's only block is its root."""
    none = F.array().cast(PATH)
    if above is None:
        return tier.withColumn("_above", none).withColumn("_root", F.col("_top"))
    found = above.select(group, F.col("_pos").alias("_block"), F.col("_path").alias("_above"), F.col("_root").alias("_r"))
    joined = join_same(tier, found, [group, "_block"], "left")
    return joined.withColumn("_above", F.coalesce("_above", none)).withColumn("_root", F.coalesce("_r", "_top")).drop("_r")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(
        path, start.cast("string"), lambda node, p: F.sha2(F.concat(p["left"], node.cast("binary"), p["right"]), 256)
    )


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a proof, level by level, left to right."""
    return digest(F.aggregate(path, F.lit("").cast("binary"), lambda held, p: F.concat(held, p["left"], p["right"])))


def subroots(leaf_blocks: DataFrame, group: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(blocks with ``_above`` up to their group's root and ``_root``, groups with their root)."""
    size = FAN**levels
    tops = leaf_blocks.where(F.col("_count") > size).select(
        group, F.col("_block").alias("_pos"), F.col("_top").alias("_leaf"), F.ceil(F.col("_count") / size).alias("_count")
    )
    joined = cut(_with_above(leaf_blocks, _paths(cut(tops, "tops"), group, levels), group), "rooted")
    return joined, joined.groupBy(group).agg(F.min("_root").alias("_leaf"))


def proofs(
    leaves: DataFrame, group: str, key: str, keep: Sequence[str] = (), levels: int = LEVELS, each=None
) -> DataFrame:
    """Leaves (group, key, _leaf, and the columns to keep) with their proofs.

    Returns group, key, the kept columns, leaf, subroot, root and path. With ``each`` (a function of the columns
    key and kept by name, leaf and path, all inside the block, to named columns) its columns stand in for the path: proofs are long, and
    what is computed from them where they are made need not carry them.
    """
    payload = F.struct(F.col(key).alias("_key"), *[F.col(c) for c in keep])
    leaf_blocks = cut(blocks(ordered_leaves(leaves, group, key, keep), group, payload, levels), "blocks")
    rooted, roots = subroots(leaf_blocks, group, levels)

    # The tree over the groups' roots: one group of its own, whose members are the groups in order.
    one = F.lit(0).alias("_all")
    top_leaves = roots.select(one, F.col(group).alias("_group"), "_leaf")
    top_nodes = cut(ordered_leaves(top_leaves, "_all", "_group"), "subroots")
    last = _paths(top_nodes.select("_all", "_pos", "_leaf", "_count"), "_all", levels)
    named = top_nodes.select("_pos", F.col("_group").alias(group)).join(last, "_pos")
    named = named.select(group, F.col("_path").alias("_last"), F.col("_root").alias("_whole"))
    rooted = join_same(rooted, named, [group])

    def row(entry: Column, i: Column) -> Column:
        node = F.substring(F.col("_level0"), i * DIGITS + 1, F.lit(DIGITS)).cast("string")
        path = F.concat(_inner_path(i, levels), F.col("_above"), F.col("_last"))
        made = [path.alias("path")] if each is None else each(entry, node, path)
        return F.struct(
            entry["_key"].alias("_key"), *[entry[c].alias(c) for c in keep], node.alias("leaf"), *made
        )

    out = rooted.select(
        group, F.col("_root").alias("subroot"), F.col("_whole").alias("root"), F.explode(F.transform("_items", row)).alias("_e")
    )
    return out.select(group, "subroot", "root", "_e.*").withColumnRenamed("_key", key)


def manifest(leaves: DataFrame, group: str, key: str, levels: int = LEVELS) -> DataFrame:
    """The stored form: a row per block of every group with its level strings, its top, and its group's root."""
    held = cut(blocks(ordered_leaves(leaves, group, key), group, F.col(key), levels), "blocks")
    rooted, _ = subroots(held, group, levels)
    strings = [F.col(f"_level{k}").cast("string").alias(f"level{k}") for k in range(levels + 1)]
    return rooted.select(
        group, F.col("_block").alias("block"), F.col("_items").alias("keys"), *strings, F.col("_top").alias("top"), F.col("_root").alias("subroot")
    )
