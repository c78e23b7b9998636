"""Differences of node tables, pruned by fingerprints, and folds of many differences.

A subtree's fingerprint is its number of nodes and two exclusive-ors of hashes
over all of its paths and values, so each node adds to its ancestors in one sum
that is made before it is shuffled. Comparison starts at the roots and opens only
nodes whose fingerprints differ: what is equal is never looked into, and a subtree
that is on one side only is one entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settled
from .tree import COLUMNS, remove


def fingerprints(nodes: DataFrame) -> DataFrame:
    """Node table with fp, the fingerprint of each node's subtree. Keep it: a later comparison reads only what differs."""
    h = [F.xxhash64("node_id", "kind", "canon", F.lit(i)) for i in (1, 2)]
    each = nodes.select("tree_id", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("node_id"), h[0].alias("_a"), h[1].alias("_b"))
    summed = each.groupBy("tree_id", "node_id").agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor("_a").alias("a"), F.bit_xor("_b").alias("b")).alias("fp"))
    return settled(nodes.join(summed, ["tree_id", "node_id"]))


def diff_trees(first: DataFrame, second: DataFrame, observe: list | None = None) -> DataFrame:
    """(tree_id, node_id, op, canon, orig_canon, level) of two tables with fingerprints: create and delete stand for whole
    subtrees, replace for a node's own value. ``observe`` gets the number of nodes compared at each level."""
    a = first.select("tree_id", "node_id", "parent_id", "canon", "kind", "fp")
    b = second.select(F.col("tree_id").alias("t"), F.col("node_id").alias("i"), F.col("parent_id").alias("p"), F.col("canon").alias("c"), F.col("kind").alias("k"), F.col("fp").alias("f"))
    out, level = None, 0
    left, right = a.where("parent_id IS NULL"), b.where("p IS NULL")
    while True:
        both = settled(left.join(right, (F.col("tree_id") == F.col("t")) & (F.col("node_id") == F.col("i")), "full_outer").where("NOT fp <=> f"))
        op = F.when(F.col("t").isNull(), "delete").when(F.col("tree_id").isNull(), "create").when(~F.col("canon").eqNullSafe(F.col("c")) | (F.col("kind") != F.col("k")), "replace")
        found = both.select(F.coalesce("tree_id", "t").alias("tree_id"), F.coalesce("node_id", "i").alias("node_id"), op.alias("op"), F.col("c").alias("canon"), F.col("canon").alias("orig_canon"), F.lit(level).alias("level"))
        found = found.where("op IS NOT NULL")
        out = found if out is None else out.unionByName(found)
        if observe is not None:
            observe.append(both.count())
        opened = both.where("fp IS NOT NULL AND f IS NOT NULL").select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_i"))
        if opened.isEmpty():
            return out
        left = a.join(opened, (F.col("tree_id") == F.col("_t")) & (F.col("parent_id") == F.col("_i")), "left_semi")
        right = b.join(opened, (F.col("t") == F.col("_t")) & (F.col("p") == F.col("_i")), "left_semi")
        level += 1


def apply_tree_diff(nodes: DataFrame, changes: DataFrame, source: DataFrame) -> DataFrame:
    """Nodes after the changes; the nodes of created subtrees come from ``source``, the table that has them."""
    gone = changes.where("op = 'delete'").select("tree_id", "node_id")
    left = remove(nodes.select(*COLUMNS), gone)
    new = changes.where("op = 'replace'").select("tree_id", "node_id", F.col("canon").alias("_canon"), F.lit(True).alias("_new"))
    left = left.join(new, ["tree_id", "node_id"], "left").withColumn("canon", F.when(F.col("_new"), F.col("_canon")).otherwise(F.col("canon"))).select(*COLUMNS)
    roots = changes.where("op = 'create'").select("tree_id", F.col("node_id").alias("_id"))
    inside = source.select("tree_id", "node_id", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("_id")).join(roots, ["tree_id", "_id"], "left_semi")
    made = source.select(*COLUMNS).join(inside.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi")
    return left.unionByName(made.select(*COLUMNS))


def fold_diffs(log: DataFrame, keys: list[str], leaves: list[str], seq: str = "seq") -> DataFrame:
    """One difference with the effect of all in a log (keys, op, leaves, orig_ leaves, seq), in the order of seq.

    Whether an entry was there before all and after all follows from its first and its last operation, its old values
    from the first, its new ones from the last that gave any; so a key's log is one aggregate. Steps that cannot follow
    each other (create of what is there, anything else of what is not) give the op 'error'. What ends where it began is
    left out. The log is dealt out once, by key.
    """
    before = F.lag("op").over(Window.partitionBy(*keys).orderBy(seq))
    wrong = F.when(before.isNull(), False).otherwise((before == "delete") != (F.col("op") == "create"))
    gives = F.when(F.col("op").isin("create", "replace"), F.struct(F.col(seq).alias("s"), *leaves))
    old, new = [F.col(f"orig_{c}") for c in leaves], F.struct(*leaves)
    out = log.withColumn("_wrong", wrong).groupBy(*keys).agg(
        F.max("_wrong").alias("_wrong"), F.min_by("op", seq).alias("_first"), F.max_by("op", seq).alias("_last"), F.max(seq).alias("_end"),
        F.min_by(F.struct(*old), seq).alias("_old"), F.max_by(new, F.when(gives.isNotNull(), F.col(seq))).alias("_new"), F.max(gives.isNotNull()).alias("_gives"),
    )
    was, is_ = F.col("_first") != "create", F.col("_last") != "delete"
    back = F.lit(True)
    for c in leaves:
        back &= F.col(f"_new.{c}").eqNullSafe(F.col(f"_old.orig_{c}"))
    kept = ~F.col("_gives") | back
    op = F.when(F.col("_wrong"), "error").when(~was & is_, "create").when(was & ~is_, "delete").when(was & is_ & ~kept, "replace")
    out = out.withColumn("op", op).where("op IS NOT NULL")
    alive = F.col("op").isin("create", "replace")
    return out.select(*keys, "op", *[F.when(alive, F.col(f"_new.{c}")).alias(c) for c in leaves], *[F.when(F.col("op") != "create", F.col(f"_old.orig_{c}")).alias(f"orig_{c}") for c in leaves])
