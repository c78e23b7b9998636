"""Predicates with two contexts: the node that an expression starts from, and the one that a predicate looks at.

Inside a predicate the context is the candidate, while current() stays the node
that the whole expression belongs to. Every candidate carries both: ctx_id is the
outer node and node_id the inner one. Equalities between leaves of the two are
one equi-join on all of them, so no candidate meets an outer node that it does
not match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree as R
from .validate import _diagnostics


def with_leaves(nodes: DataFrame, entries: DataFrame, leaves: list[str]) -> DataFrame:
    """Entries with the text of some of their leaves as columns; of leaves that occur more often, a row for each. A name
    ``../x`` is a leaf of the parent."""
    out = entries
    for i, leaf in enumerate(leaves):
        up, name = leaf.startswith("../"), leaf.removeprefix("../")
        values = nodes.where((F.col("name") == name) & (F.col("kind") == "leaf")).select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p"), F.col("canon").alias(f"_v{i}"))
        home = F.col("parent_id") if up else F.col("node_id")
        out = out.join(values, (F.col("tree_id") == F.col("_t")) & (home == F.col("_p")), "left").drop("_t", "_p")
    return out


def matching(outer: DataFrame, nodes: DataFrame, name: str, equal: list[tuple[str, str]], also: Column | None = None) -> DataFrame:
    """//name[inner = current()/outer]...: nodes of the name for each outer context, where all pairs (inner leaf, outer
    leaf) have equal text; an outer leaf "." is the outer node's own value. ``also`` is a further condition on the columns
    inner_<leaf> and outer_<leaf>, with other signs as X.g. "/" as "_"."""
    inner_leaves, outer_leaves = [i for i, _ in equal], [o for _, o in equal]
    flat = lambda x: x.replace("../", "up_").replace(".", "self")
    a = with_leaves(nodes, outer, [o for o in outer_leaves if o != "."])
    at = iter(range(len(outer_leaves)))
    a = a.select("ctx_id", "tree_id", *[(F.col("canon") if o == "." else F.col(f"_v{next(at)}")).alias(f"outer_{flat(o)}") for o in outer_leaves])
    b = with_leaves(nodes, nodes.where(F.col("name") == name), inner_leaves)
    b = b.select(*R.COLUMNS, *[F.col(f"_v{i}").alias(f"inner_{flat(x)}") for i, x in enumerate(inner_leaves)])
    match = reduce(lambda x, y: x & y, [F.col(f"inner_{flat(i)}") == F.col(f"outer_{flat(o)}") for i, o in equal], a["tree_id"] == b["tree_id"])
    out = a.join(b, match).drop(a["tree_id"])
    out = out if also is None else out.where(also)
    return out.select("ctx_id", *R.COLUMNS).dropDuplicates(["ctx_id", "tree_id", "node_id"])


def current(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """current(): for every inner node, the outer node of its context."""
    rows = found.select("ctx_id", "tree_id").distinct().alias("f")
    there = nodes.alias("n")
    return rows.join(there, (F.col("f.tree_id") == F.col("n.tree_id")) & (F.col("f.ctx_id") == F.col("n.node_id"))).select("f.ctx_id", *[f"n.{c}" for c in R.COLUMNS])


def keyed_leafref(refs: DataFrame, nodes: DataFrame, target: str, equal: list[tuple[str, str]], leaf: str) -> DataFrame:
    """Diagnostics of references without an instance: the reference's value must be a ``leaf`` of a ``target`` entry whose
    keys match leaves around the reference, as in /t[k = current()/../k]/leaf. References without a key have no instance."""
    pairs = [*equal, (leaf, ".")]
    found = matching(refs, nodes, target, pairs).select(F.col("ctx_id").alias("_c"), F.col("tree_id").alias("_t")).distinct()
    bad = refs.join(found, (refs["ctx_id"] == found["_c"]) & (refs["tree_id"] == found["_t"]), "left_anti")
    return _diagnostics(bad, "instance-required", F.col("node_id"), F.concat(F.col("name"), F.lit(" refers to "), F.coalesce("canon", F.lit(""))))


def deref(refs: DataFrame, nodes: DataFrame, target: str, equal: list[tuple[str, str]], leaf: str) -> DataFrame:
    """deref(): the target leaves that references of such a path stand for."""
    entries = matching(refs, nodes, target, [*equal, (leaf, ".")])
    return R.child(entries, nodes, leaf)
