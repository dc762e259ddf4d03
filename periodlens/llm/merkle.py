"""Merkle manifest of a table, with a proof for every row (operator 12).

Each row is a leaf, the SHA-256 of its fields.  The leaves of a group ascend by
a key and form a tree of three children a node; the groups' roots (subroots),
ordered by group, form one more tree of the same kind, whose root names the
whole table.

Checkpoint and recompute: of a tree only every ``every``-th level is stored, as
one row per aligned subtree (at most ``3 ** every`` nodes, in order).  The next
stored level is a function of such a row.  A proof needs the levels between
too: they are made anew from the stored nodes of the one subtree, the siblings
are taken, and the rest is discarded.  Proofs go from the top stored level
down, each subtree joined with the path of the node above it, so a long path is
never shuffled: at the leaves it is appended within the row of the subtree.

All of it is DataFrame expressions.  A position within a group comes from one
range-partitioned sort of the hashes (texts are not moved) plus the number of
rows that earlier partitions hold of the group, so a group of any size is
spread over tasks; a subtree is the largest thing a task holds at once.

Nulls: a null field counts as ``-``; a null group is a group of its own, first
in order; rows with a null key come first in their group.  Rows equal in group
and key are ordered by their leaf, so equal rows are interchangeable and each
has its own proof.  Empty texts are fields of length 0; a text of any length is
hashed within Spark, row by row.  An empty table gives no rows and has no root.
Columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

ARITY = 3
#: Rows of a table that is broadcast (about 100 bytes each); a larger one is shuffled.
SHARED = 1 << 16
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' text end to end, lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The leaf of a row: each field as byte length, ``:`` and value, or ``-``."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _nodes_at(levels: int) -> Column:
    """Nodes of a tree ``levels`` above a level of ``total`` nodes."""
    return F.expr(f"(total + {ARITY**levels - 1}L) div {ARITY**levels}L")


def numbered(stages: Stages, rows: DataFrame, group: str, order: Sequence[str], shared: int = SHARED) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... within ``group`` by ``order``, nulls first) and
    ``total`` (rows of the group).  Order is total up to equal rows."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = stages.put(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    runs = placed.groupBy("part", group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy(group)
    before = F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stages.put(runs.select(F.col("part").alias("_part"), F.col(group).alias("_group"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"),
                                  F.sum("n").over(of_group).alias("total")))
    small = runs.count() <= shared
    side = F.broadcast(runs) if small else runs.hint("shuffle_hash")
    out = placed.join(side, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn("pos", F.col("at") + F.col("_shift")).drop("part", "at", "_part", "_group", "_shift")


def subtrees(nodes: DataFrame, group: str, item: Sequence[str], every: int) -> DataFrame:
    """One row per aligned subtree: its group, number, the group's number of nodes at this
    level and its own nodes in order (``items``)."""
    one = F.struct("pos", *item)
    return (nodes.groupBy(group, F.expr(f"pos div {ARITY**every}L").alias("subtree"))
            .agg(F.first("total").alias("total"), F.sort_array(F.collect_list(one)).alias("items")))


def _run(level: str):
    """The node over run ``i`` of a level."""
    return lambda i: digest(F.array_join(F.slice(level, (i * ARITY + 1).cast("int"), ARITY), ""))


def with_levels(rows: DataFrame, every: int) -> DataFrame:
    """Adds ``l0`` .. ``l<every>``: the hashes of the subtree's nodes at its levels.  A
    level of the tree that has one node is its last; above it nothing changes."""
    rows = rows.withColumn("l0", F.transform("items", lambda x: x["leaf"]))
    for k in range(every):
        below = f"l{k}"
        up = F.transform(F.sequence(F.lit(0), F.expr(f"(size({below}) - 1) div {ARITY}").cast("int")), _run(below))
        rows = rows.withColumn(f"l{k + 1}", F.when(_nodes_at(k) > 1, up).otherwise(F.col(below)))
    return rows


@dataclass
class Tree:
    """The stored levels of the trees of all groups, and their roots."""
    group: str
    item: tuple[str, ...]
    every: int
    levels: list[DataFrame]
    roots: DataFrame


def build(stages: Stages, leaves: DataFrame, group: str, order: Sequence[str], carry: Sequence[str] = (),
          every: int = 4, shared: int = SHARED) -> Tree:
    """Trees over ``leaves`` (``group``, ``order``, ``leaf`` and what else is carried to the proofs)."""
    item = tuple(dict.fromkeys(["leaf", *order, *carry]))
    levels = [stages.put(subtrees(numbered(stages, leaves.select(group, *item), group, [*order, "leaf"], shared), group, item, every))]
    while True:
        top = with_levels(levels[-1], every).select(group, F.col("subtree").alias("pos"), _nodes_at(every).alias("total"),
                                                    F.element_at(f"l{every}", 1).alias("leaf"))
        most = levels[-1].agg(F.max("total")).first()[0] or 0
        if most <= ARITY**every:  # one subtree is the whole tree of every group
            return Tree(group, item, every, levels, stages.put(top.select(group, "leaf")))
        levels.append(stages.put(subtrees(top, group, ["leaf"], every)))


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """Every leaf with its carried columns and ``path``: the siblings left and right of
    it and of each node above, level by level.  ``tops`` gives per group the path of
    its root (``path``) and columns to hand down."""
    width, every, group = ARITY**tree.every, tree.every, tree.group
    handed = [c for c in tops.columns if c not in (group, "path")]
    above = tops.withColumn("pos", F.lit(0).cast("long"))

    def steps(j: Column) -> Column:
        """The path of node ``j`` of a subtree, within the subtree."""
        out = []
        for k in range(every):
            i = F.floor(j / F.lit(ARITY**k)).cast("int")
            start = F.floor(i / F.lit(ARITY)).cast("int") * ARITY
            step = F.struct(F.array_join(F.slice(f"l{k}", start + 1, i - start), "").alias("left"),
                            F.array_join(F.slice(f"l{k}", i + 2, start + (ARITY - 1) - i), "").alias("right"))
            out.append(F.when(_nodes_at(k) > 1, step))
        return F.array_compact(F.array(*out)).cast(PATH)

    for depth, level in reversed(list(enumerate(tree.levels))):
        parents = above.select(F.col(group).alias("_group"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *handed)
        on = F.col(group).eqNullSafe(F.col("_group")) & (F.col("subtree") == F.col("_pos"))
        joined = with_levels(level.join(parents.hint("shuffle_merge"), on), every)
        each = F.transform("items", lambda x, j: F.struct(
            *[x[c].alias(c) for c in (tree.item if depth == 0 else ("leaf",))], x["pos"].alias("pos"), F.concat(steps(j), F.col("_path")).alias("path")))
        above = joined.select(group, *handed, F.explode(each).alias("x")).select(group, *handed, "x.*")
    return above


def folded(start: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, F.col(start) if isinstance(start, str) else start, lambda h, s: digest(s["left"], h, s["right"]))


def path_digest(path: Column | str = "path") -> Column:
    """Digest of a path: its siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, group: str = "source", key: str = "doc_id",
             fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             altered: Mapping[str, Column] | None = None, every: int = 4, shared: int = SHARED) -> DataFrame:
    """Per row of ``docs``: ``group``, ``key``, ``leaf``, ``altered`` (the leaf of the row
    with the columns that ``altered`` replaces), ``subroot``, ``root`` and ``path``.

    ``folded(leaf, path)`` gives ``root`` for every untouched row and another value for a changed one."""
    stages = Stages(docs.sparkSession, "merkle")
    other = [(altered or {}).get(f, F.col(f)) for f in fields]
    leaves = stages.put(docs.select(F.col(group).alias("grp"), F.col(key).alias("id"), leaf(*map(F.col, fields)).alias("leaf"), leaf(*other).alias("altered")))
    groups = build(stages, leaves, "grp", ["id"], ["altered"], every, shared)
    stages.drop(leaves)
    whole = build(stages, groups.roots.select(F.lit(0).alias("tree"), F.col("grp").alias("name"), "leaf"), "tree", ["name"], (), every, shared)
    roots = whole.roots.select("tree", F.col("leaf").alias("root"), F.array().cast(PATH).alias("path"))
    tops = stages.put(proofs(whole, roots).select(F.col("name").alias("grp"), "path", F.col("leaf").alias("subroot"), "root"))
    return proofs(groups, tops).select(F.col("grp").alias(group), F.col("id").alias(key), "leaf", "altered", "subroot", "root", "path")
