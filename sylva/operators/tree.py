"""Trees as node tables, and the axes of the path language as equi-joins.

A node table has one row per node: tree_id, node_id (the path of keys),
parent_id, anc_ids (paths of its ancestors, root first), doc_key (compares as
document order; leaves of an entry come before its child entries), name, kind and canon (text of leaves). Ancestors are kept as
an array, so ancestor and descendant steps explode it and join on equality.
Every step keeps ctx_id, the context that it belongs to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["tree_id", "node_id", "parent_id", "anc_ids", "doc_key", "name", "kind", "canon"]


def _ordered(df: DataFrame, key: str) -> Column:
    """A key as text whose order is the key's: whole numbers by value, all else as it is."""
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.lpad((F.col(key).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.col(key).cast("string")


def key_text(key: Column) -> Column:
    """A key inside a path: as it is if it is plain, else in quotes, with quotes doubled, so that no two paths are alike."""
    plain = F.rlike(key, F.lit(r"^[\p{L}\p{N}_.:#+ -]*$"))
    return F.when(plain, key).otherwise(F.concat(F.lit("'"), F.replace(key, F.lit("'"), F.lit("''")), F.lit("'")))


def shred(df: DataFrame, tree_id: Column, path: list[tuple[str, str]], leaves: list[str]) -> DataFrame:
    """Nodes of a list table: ``path`` names the list and its key column at each level, ``leaves`` the leaf columns.

    The rows of the last level become list entries, each with its leaves; the
    levels above are named, not created.
    """
    names = []
    for name, key in path:
        number = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
        step = F.concat(F.lit(f"/{name}["), F.col(key).cast("string") if number else key_text(F.col(key).cast("string")), F.lit("]"))
        names.append(F.concat(names[-1], step) if names else step)
    order = F.array(*[F.concat(F.lit("1"), _ordered(df, k)) for _, k in path])
    here, above = names[-1], F.array(*names[:-1]) if names[:-1] else F.array().cast("array<string>")
    parent = names[-2] if names[:-1] else F.lit(None).cast("string")
    tree = tree_id.alias("tree_id")
    entry = (here.alias("node_id"), parent.alias("parent_id"), above.alias("anc_ids"), order.alias("doc_key"),
                     F.lit(path[-1][0]).alias("name"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("canon"))
    # One branch a name, so that a filter on names leaves out whole branches and their columns.
    parts = [df.select(tree, *entry)] + [
        df.where(F.col(c).isNotNull()).select(tree, F.concat(here, F.lit(f"/{c}")).alias("node_id"), here.alias("parent_id"), F.concat(above, F.array(here)).alias("anc_ids"),
                 F.concat(order, F.array(F.lit(f"0{i:06d}"))).alias("doc_key"), F.lit(c).alias("name"), F.lit("leaf").alias("kind"),
                 F.col(c).cast("string").alias("canon"))
        for i, c in enumerate(leaves)
    ]
    return reduce(DataFrame.unionByName, parts)


def context(nodes: DataFrame, condition: Column | None = None) -> DataFrame:
    """Selected nodes as contexts, each its own."""
    rows = nodes if condition is None else nodes.where(condition)
    return rows.select(F.col("node_id").alias("ctx_id"), *COLUMNS)


def _named(nodes: DataFrame, name: str | None) -> DataFrame:
    return nodes if name in (None, "*") else nodes.where(F.col("name") == name)


def _step(here: DataFrame, nodes: DataFrame, how: Column, distinct: bool) -> DataFrame:
    out = here.alias("h").join(nodes.alias("n"), (F.col("h.tree_id") == F.col("n.tree_id")) & how)
    out = out.select("h.ctx_id", *[f"n.{c}" for c in COLUMNS])
    return out.dropDuplicates(["ctx_id", "tree_id", "node_id"]) if distinct else out


def child(here: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    return _step(here, _named(nodes, name), F.col("n.parent_id") == F.col("h.node_id"), False)


def parent(here: DataFrame, nodes: DataFrame, name: str | None = None, single: bool = False) -> DataFrame:
    """``single`` says that each context holds one node, so that no result comes twice; so for the other axes."""
    return _step(here, _named(nodes, name), F.col("n.node_id") == F.col("h.parent_id"), not single)


def ancestor(here: DataFrame, nodes: DataFrame, name: str | None = None, or_self: bool = False, single: bool = False) -> DataFrame:
    up = F.concat("anc_ids", F.array("node_id")) if or_self else F.col("anc_ids")
    return _step(here.withColumn("_up", F.explode(up)), _named(nodes, name), F.col("n.node_id") == F.col("h._up"), not single)


def descendant(here: DataFrame, nodes: DataFrame, name: str | None = None, or_self: bool = False, single: bool = False) -> DataFrame:
    up = F.concat("anc_ids", F.array("node_id")) if or_self else F.col("anc_ids")
    below = _named(nodes, name).withColumn("_up", F.explode(up))
    return _step(here, below, F.col("n._up") == F.col("h.node_id"), not single)


def _side(here: DataFrame, nodes: DataFrame, name: str | None, after: bool) -> DataFrame:
    order = F.col("n.doc_key") > F.col("h.doc_key") if after else F.col("n.doc_key") < F.col("h.doc_key")
    same = F.col("n.parent_id").eqNullSafe(F.col("h.parent_id"))
    return _step(here, _named(nodes, name), same & order, True)


def following_sibling(here: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    return _side(here, nodes, name, True)


def preceding_sibling(here: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    return _side(here, nodes, name, False)


def sibling_counts(nodes: DataFrame, name: str) -> DataFrame:
    """How many siblings of one name come before and after each, without pairs of them: one sort of each parent's entries."""
    w = Window.partitionBy("tree_id", "parent_id")
    rows = _named(nodes, name).withColumn("before", F.row_number().over(w.orderBy("doc_key")) - 1)
    return rows.withColumn("after", F.count(F.lit(1)).over(w) - F.col("before") - 1)


def self_(here: DataFrame, name: str | None = None) -> DataFrame:
    return _named(here, name)


def text(here: DataFrame) -> DataFrame:
    """text(): nodes that hold a value."""
    return here.where("kind = 'leaf'")


def find(nodes: DataFrame, path: str, tree: str | None = None) -> DataFrame:
    """The node of a data path in one tree, or in each if none is named."""
    return nodes.where((F.col("node_id") == path) & (F.lit(True) if tree is None else F.col("tree_id") == tree))


def any_depth(nodes: DataFrame, name: str) -> DataFrame:
    """//name from the root: every node of the name, each its own context."""
    return context(_named(nodes, name))


def following(here: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    """Subtrees of the later siblings of the node and of its ancestors."""
    return descendant(following_sibling(ancestor(here, nodes, or_self=True), nodes), nodes, name, or_self=True)


def preceding(here: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    """Subtrees of the earlier siblings of the node and of its ancestors, and the ancestors, as the language has it."""
    before = descendant(preceding_sibling(ancestor(here, nodes, or_self=True), nodes), nodes, name, or_self=True)
    return union(before, ancestor(here, nodes, name))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["ctx_id", "tree_id", "node_id"])


def at_position(here: DataFrame, low: int = 1, high: int | None = None, reverse: bool = False, per: str = "ctx_id") -> DataFrame:
    """Positions ``low`` to ``high`` of the whole step in its context; reverse axes count backwards."""
    order = F.col("doc_key").desc() if reverse else F.col("doc_key").asc()
    ranked = here.withColumn("_p", F.row_number().over(Window.partitionBy(per, "tree_id").orderBy(order)))
    return ranked.where(F.col("_p").between(low, high or low)).drop("_p")


def last(here: DataFrame) -> DataFrame:
    return here.groupBy("ctx_id", "tree_id").agg(F.max_by(F.struct(*COLUMNS[1:]), "doc_key").alias("_last")).select("ctx_id", "tree_id", "_last.*")


def where_exists(here: DataFrame, found: DataFrame, absent: bool = False) -> DataFrame:
    """Existential predicate: nodes that are a context of ``found``, or with ``absent`` are none."""
    keys = found.select(F.col("ctx_id").alias("_c"), F.col("tree_id").alias("_t")).distinct()
    match = (here["node_id"] == keys["_c"]) & (here["tree_id"] == keys["_t"])
    return here.join(keys, match, "left_anti" if absent else "left_semi")


def count(contexts: DataFrame, found: DataFrame) -> DataFrame:
    """count(): zero for contexts without nodes."""
    n = found.groupBy("tree_id", "ctx_id").agg(F.count(F.lit(1)).alias("n"))
    return contexts.select("tree_id", "ctx_id").join(n, ["tree_id", "ctx_id"], "left").select("tree_id", "ctx_id", F.coalesce("n", F.lit(0)).alias("n"))


def total(contexts: DataFrame, found: DataFrame) -> DataFrame:
    """sum(): NaN if any node is no number."""
    from sylva.functions.xpath import number

    n = found.groupBy("tree_id", "ctx_id").agg(F.sum(number(F.col("canon"))).alias("total"))
    return contexts.select("tree_id", "ctx_id").join(n, ["tree_id", "ctx_id"], "left").select("tree_id", "ctx_id", F.coalesce("total", F.lit(0.0)).alias("total"))


def string_value(nodes: DataFrame) -> DataFrame:
    """Text of each inner node: its leaves in document order, one a line, indented by depth. A subtree's text is one value."""
    lines = nodes.where("kind = 'leaf'").select("tree_id", F.explode("anc_ids").alias("node_id"), "doc_key", F.size("anc_ids").alias("d"), "canon")
    lines = lines.groupBy("tree_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("doc_key", "d", "canon"))).alias("l"))
    return lines.select("tree_id", "node_id", F.array_join(F.transform("l", lambda x: F.concat(F.repeat(F.lit("  "), x["d"]), x["canon"])), "\n").alias("value"))


def trim(nodes: DataFrame, selected: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Selected subtrees, their ancestors, and the keys of those."""
    chosen = selected.select("tree_id", F.col("node_id").alias("_id"), "anc_ids")
    up = chosen.select("tree_id", F.explode("anc_ids").alias("_id")).distinct()
    roots = chosen.select("tree_id", "_id").distinct()
    tagged = nodes.withColumn("_self", F.explode(F.concat("anc_ids", F.array("node_id"))))
    inside = tagged.join(roots, (tagged["tree_id"] == roots["tree_id"]) & (tagged["_self"] == roots["_id"]), "left_semi").drop("_self")
    above = nodes.join(up, (nodes["tree_id"] == up["tree_id"]) & (nodes["node_id"] == up["_id"]), "left_semi")
    leaf = nodes.where(F.col("name").isin(*keys)) if keys else nodes.limit(0)
    named = leaf.join(up, (leaf["tree_id"] == up["tree_id"]) & (leaf["parent_id"] == up["_id"]), "left_semi")
    return inside.unionByName(above).unionByName(named).dropDuplicates(["tree_id", "node_id"])


def remove(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """The table less the selected subtrees."""
    roots = selected.select("tree_id", F.col("node_id").alias("_id")).distinct()
    gone = nodes.select("tree_id", "node_id", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("_id")).join(roots, ["tree_id", "_id"], "left_semi")
    return nodes.join(gone.select("tree_id", "node_id").distinct(), ["tree_id", "node_id"], "left_anti").select(*nodes.columns)


def attribute(here: DataFrame, meta: DataFrame, name: str | None = None) -> DataFrame:
    """The attribute axis: annotations (tree_id, node_id, annotation, value) of each context's nodes."""
    items = meta if name in (None, "*") else meta.where(F.col("annotation") == name)
    return here.select("ctx_id", "tree_id", "node_id").join(items, ["tree_id", "node_id"]).select("ctx_id", "tree_id", "node_id", "annotation", "value")


def accessible(nodes: DataFrame, state: list[str] = (), operations: list[str] = (), within: str | None = None, when_false: DataFrame | None = None) -> DataFrame:
    """What an expression may see: no subtree of a ``state`` name (for expressions on configuration), of an operation
    other than the one it stands ``within``, or of a node whose condition is false (tree_id, node_id)."""
    names = [*state, *[o for o in operations if o != within]]
    hidden = nodes.where(F.col("name").isin(*names)).select("tree_id", "node_id")
    hidden = hidden if when_false is None else hidden.unionByName(when_false.select("tree_id", "node_id"))
    return remove(nodes, hidden)


def deref(here: DataFrame, targets: DataFrame) -> DataFrame:
    """Follows leaf references: nodes of ``targets`` in the same tree with the same canonical text."""
    out = here.alias("h").join(targets.alias("n"), (F.col("h.tree_id") == F.col("n.tree_id")) & (F.col("h.canon") == F.col("n.canon")))
    return out.select("h.ctx_id", *[f"n.{c}" for c in COLUMNS])
