"""Edits, copies and comparisons of node tables.

Each takes node tables in the columns of ``tree.COLUMNS`` and returns a new
one; nodes are told apart by tree_id and node_id. Subtrees are found by
exploding the ancestors of each node, so work grows with nodes times depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.types import ranked, sort_key
from sylva.operators.tree import COLUMNS

_ID = ["tree_id", "node_id"]


def term(parents: DataFrame, name: str, canon: Column, place: int = 0) -> DataFrame:
    """A leaf under each parent; ``place`` is its rank among the parent's leaves."""
    return parents.select(
        "tree_id", F.concat("node_id", F.lit(f"/{name}")).alias("node_id"), F.col("node_id").alias("parent_id"), F.concat("anc_ids", F.array("node_id")).alias("anc_ids"),
        F.concat("doc_key", F.array(F.lit(f"0{place:06d}"))).alias("doc_key"), F.lit(name).alias("name"), F.lit("leaf").alias("kind"), canon.cast("string").alias("canon"),
    )


def add(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """The table with made nodes that it lacks; nodes that are there stay as they are."""
    new = made.select(*COLUMNS).dropDuplicates(_ID).join(nodes.select(*_ID), _ID, "left_anti")
    return nodes.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def set_value(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """New texts (tree_id, node_id, canon) for leaves, and whether each node's text changed. Values for absent nodes and
    for inner nodes do nothing; of several for one leaf the greatest holds."""
    v = values.groupBy(*_ID).agg(F.max("canon").alias("_new"), F.lit(True).alias("_given"))
    both = nodes.join(v, _ID, "left")
    here = F.col("_given").isNotNull() & (F.col("kind") == "leaf")
    changed = here & ~F.col("canon").eqNullSafe(F.col("_new"))
    return both.withColumn("changed", changed).withColumn("canon", F.when(here, F.col("_new")).otherwise(F.col("canon"))).select(*COLUMNS, "changed")


def duplicate(nodes: DataFrame, selected: DataFrame, tree_id: Column, with_parents: bool = False) -> DataFrame:
    """Copies of the selected subtrees as trees of their own, ``tree_id`` being an expression over the nodes and root_id.
    Roots have no parent, unless the path above them is kept. A node below two selected ones is copied with either."""
    roots = selected.select("tree_id", F.col("node_id").alias("root_id")).distinct()
    below = nodes.withColumn("root_id", F.explode(F.concat("anc_ids", F.array("node_id")))).join(roots, ["tree_id", "root_id"], "left_semi")
    if not with_parents:
        at = F.array_position("anc_ids", F.col("root_id")).cast("int")
        depth = F.size("anc_ids")
        kept = F.when(at > 0, F.slice("anc_ids", F.greatest(at, F.lit(1)), depth)).otherwise(F.slice("anc_ids", 1, 0))
        root = F.col("node_id") == F.col("root_id")
        below = below.withColumn("anc_ids", kept).withColumn("parent_id", F.when(~root, F.col("parent_id")))
    return below.withColumn("tree_id", tree_id).select("root_id", *COLUMNS)


def fingerprints(nodes: DataFrame) -> DataFrame:
    """Two sums of hashes of each node's subtree: its paths below the node, kinds and texts. Equal subtrees have equal
    sums wherever they stand; the two hash each node with a different text before it."""
    tagged = nodes.select("tree_id", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("at"), "node_id", "kind", "canon")
    rest = F.substring(F.col("node_id"), F.length("at") + 1, F.length("node_id"))
    part = [F.xxhash64(F.lit(seed), rest, "kind", F.col("canon").isNull(), F.coalesce("canon", F.lit(""))).cast("decimal(20,0)") for seed in ("a", "b")]
    sums = tagged.groupBy("tree_id", F.col("at").alias("node_id")).agg(F.sum(part[0]).alias("f1"), F.sum(part[1]).alias("f2"), F.count(F.lit(1)).alias("n_nodes"))
    return sums.join(nodes.select(*_ID), _ID, "left_semi")


def equal_subtrees(first: DataFrame, second: DataFrame) -> DataFrame:
    """Nodes of both tables (by tree_id and node_id) with whether all below and including them is equal."""
    a, b = fingerprints(first), fingerprints(second)
    b = b.select(*_ID, F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n_nodes").alias("m_nodes"))
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_nodes") == F.col("m_nodes"))
    return a.join(b, _ID).select(*_ID, same.alias("equal"))


def preorder(nodes: DataFrame, out: str = "pos") -> DataFrame:
    """All nodes numbered from 1, trees in turn and each in document order, by ranges of the key."""
    return ranked(nodes, F.struct("tree_id", "doc_key"), out)


def children_no_keys(children: DataFrame, keys: list[str]) -> DataFrame:
    """Children less the leaves that are keys of their list."""
    return children.where(~(F.col("name").isin(*keys) & (F.col("kind") == "leaf"))) if keys else children


def sorted_runs(nodes: DataFrame, name: str, kind: str, out: str = "pos") -> DataFrame:
    """Entries of a system-ordered leaf-list numbered from 1 within their parent in the order of their type. One sort by
    ranges for all parents, so that a parent with very many entries is no single task."""
    order = F.struct(F.col("tree_id"), F.col("parent_id"), sort_key(F.col("canon"), kind), F.col("node_id"))
    rows = ranked(nodes.where(F.col("name") == name), order, "_all")
    first = rows.groupBy("tree_id", "parent_id").agg(F.min("_all").alias("_first"))
    return rows.join(first, ["tree_id", "parent_id"]).withColumn(out, F.col("_all") - F.col("_first") + 1).select(*nodes.columns, out)


def annotate(meta: DataFrame, given: DataFrame) -> DataFrame:
    """Annotations (tree_id, node_id, annotation, value) with the given ones set: those of the same name are replaced."""
    key = [*_ID, "annotation"]
    new = given.groupBy(*key).agg(F.max("value").alias("value"))
    return meta.select(*key, "value").join(new.select(*key), key, "left_anti").unionByName(new)


def drop_annotations(meta: DataFrame, nodes: DataFrame, annotation: str | None = None) -> DataFrame:
    """Annotations less those, of one name or of all, that sit on the given nodes."""
    gone = meta.join(nodes.select(*_ID).distinct(), _ID, "left_semi")
    gone = gone if annotation is None else gone.where(F.col("annotation") == annotation)
    return meta.join(gone.select(*_ID, "annotation").distinct(), [*_ID, "annotation"], "left_anti").select(*meta.columns)
