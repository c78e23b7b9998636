"""Pre-order intervals: each node knows its place in document order and the last place in its subtree.

With (start, end) the axes are comparisons of numbers: a node's descendants
start after it and no later than its end, what follows it starts after its end,
what precedes it (its ancestors too, as the language has it) starts before it.
Counts over an axis are differences of running counts, so that counting for all
nodes of a table costs one sort in ranges, whatever the number of pairs.

Trees may be large: nodes are ranked in ranges of (tree, document order), and
subtree sizes are sums that are made before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import running, settled


def label(nodes: DataFrame) -> DataFrame:
    """Node table with ``start``, ``end`` and ``level``. Places count through all trees, so no two nodes share one."""
    placed = running(nodes, ["tree_id", "doc_key"], start=F.lit(1).cast("long"))
    below = placed.select("tree_id", F.explode("anc_ids").alias("node_id")).groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("_below"))
    out = placed.join(below, ["tree_id", "node_id"], "left")
    return settled(out.withColumn("end", F.col("start") + F.coalesce("_below", F.lit(0))).withColumn("level", F.size("anc_ids")).drop("_below"))


def axis_counts(contexts: DataFrame, labelled: DataFrame, name: str | None = None) -> DataFrame:
    """(tree_id, node_id, descendants, following, preceding) of each labelled context: how many nodes of the name.

    Contexts ask at two places each, nodes answer by running counts; both are dealt out in ranges of the place. No
    context meets a node.
    """
    hits = labelled if name in (None, "*") else labelled.where(F.col("name") == name)
    none = F.lit(None).cast("string")
    # At one place the node itself counts before questions about "up to here", and after those about "before here".
    asks = contexts.select("tree_id", "node_id", F.explode(F.array(F.struct(F.lit("before").alias("ask"), F.col("start").alias("at")), F.struct(F.lit("upto").alias("ask"), F.col("start").alias("at")), F.struct(F.lit("inside").alias("ask"), F.col("end").alias("at")))).alias("_a"))
    asks = asks.select("tree_id", "node_id", "_a.ask", "_a.at", F.when(F.col("_a.ask") == "before", 0).otherwise(2).alias("_turn"), F.lit(0).cast("long").alias("_hit"))
    events = asks.unionByName(hits.select("tree_id", none.alias("node_id"), none.alias("ask"), F.col("start").alias("at"), F.lit(1).alias("_turn"), F.lit(1).cast("long").alias("_hit")))
    counted = running(events, ["at", "_turn"], upto=F.col("_hit")).where("ask IS NOT NULL")
    # Places run through all trees: what stood before a tree began does not count for it.
    trees = labelled.groupBy("tree_id").agg(F.min("start").alias("_first"), F.count(F.lit(1)).alias("_all"), F.sum((F.lit(True) if name in (None, "*") else F.col("name") == name).cast("long")).alias("_hits"))
    ahead = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    trees = trees.withColumn("_ahead", F.coalesce(F.sum("_hits").over(ahead), F.lit(0)))
    each = counted.groupBy("tree_id", "node_id").agg(*[F.max(F.when(F.col("ask") == a, F.col("upto"))).alias(a) for a in ("before", "upto", "inside")])
    out = each.join(trees, "tree_id")
    return out.select("tree_id", "node_id", (F.col("inside") - F.col("upto")).alias("descendants"), (F.col("_ahead") + F.col("_hits") - F.col("inside")).alias("following"), (F.col("before") - F.col("_ahead")).alias("preceding"))


def nearest(contexts: DataFrame, labelled: DataFrame, name: str, after: bool = True) -> DataFrame:
    """(tree_id, node_id, found) of each labelled context: the first node of the name that follows it, or the last that
    ends before it begins; contexts without one are left out. The answer is a lookup: the k-th hit of the order, where k
    comes from a running count."""
    hits = labelled.where(F.col("name") == name)
    place = "start" if after else "end"
    ranked = running(hits.select("tree_id", F.col("node_id").alias("found"), F.col(place).alias("_place")), ["_place", "found"], k=F.lit(1).cast("long"))
    none = F.lit(None).cast("string")
    asks = contexts.select("tree_id", "node_id", F.col("end" if after else "start").alias("at"), F.lit(1 if after else 0).alias("_turn"), F.lit(0).cast("long").alias("_hit"))
    events = asks.unionByName(hits.select("tree_id", none.alias("node_id"), F.col(place).alias("at"), F.lit(0 if after else 1).alias("_turn"), F.lit(1).cast("long").alias("_hit")))
    counted = running(events, ["at", "_turn"], upto=F.col("_hit")).where("node_id IS NOT NULL")
    want = counted.select("tree_id", "node_id", (F.col("upto") + (1 if after else 0)).alias("k"))
    return want.join(ranked.select("tree_id", "k", "found"), ["tree_id", "k"]).select("tree_id", "node_id", "found")


def within(contexts: DataFrame, labelled: DataFrame) -> DataFrame:
    """Nodes of contexts' subtrees, each once: those whose place a context's interval covers. Contexts and nodes are met in
    one running maximum of ends, not in pairs; of nested contexts the outer one serves."""
    none = F.lit(None).cast("long")
    marks = contexts.select("tree_id", F.col("start").alias("at"), F.lit(0).alias("_turn"), F.col("end").alias("_end"), F.lit(None).cast("string").alias("node_id"))
    nodes = labelled.select("tree_id", F.col("start").alias("at"), F.lit(1).alias("_turn"), none.alias("_end"), "node_id")
    # The open intervals at a place are those begun minus those ended before it.
    begun = marks.withColumn("_open", F.lit(1).cast("long"))
    ended = marks.select("tree_id", (F.col("_end") + 1).alias("at"), F.lit(0).alias("_turn"), "_end", "node_id", F.lit(-1).cast("long").alias("_open"))
    events = begun.unionByName(ended).unionByName(nodes.withColumn("_open", F.lit(0).cast("long")))
    covered = running(events, ["at", "_turn"], open=F.col("_open")).where("node_id IS NOT NULL AND open > 0")
    return labelled.join(covered.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi")
