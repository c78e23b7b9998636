"""Comparisons of node sets, and languages that nodes inherit.

A comparison with a set holds if it holds for some node of it. No pairs are
formed: equality is an equi-join on the text, difference asks whether all texts
are one, and the orders need the least and the greatest number of either side, so
each side is aggregated by context before they meet. Nodes that have the same
context node in the same tree belong together; a context without nodes on
either side is in no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import xpath as X

KEYS = ["ctx_id", "tree_id"]
#: Which ends of both sides decide an order.
_ENDS = {"<": ("least", "most"), "<=": ("least", "most"), ">": ("most", "least"), ">=": ("most", "least")}


def _sides(here: DataFrame, op: str, mark: str) -> DataFrame:
    """One row a context: the least and the greatest text, or number if ``op`` is an order. NaN is in no order."""
    value = F.coalesce("canon", F.lit(""))
    if op in _ENDS:
        value = X.number(value)
        value = F.when(~F.isnan(value), value)
    rows = here.select(*KEYS, value.alias("_v"))
    return rows.groupBy(*KEYS).agg(F.min("_v").alias(f"least{mark}"), F.max("_v").alias(f"most{mark}"))


def compare_sets(left: DataFrame, op: str, right: DataFrame) -> DataFrame:
    """(ctx_id, tree_id) of the contexts where some node on the left compares with some node on the right."""
    if op == "=":
        a, b = (x.select(*KEYS, F.coalesce("canon", F.lit("")).alias("_v")).distinct() for x in (left, right))
        return a.join(b, [*KEYS, "_v"], "left_semi").select(*KEYS).distinct()
    both = _sides(left, op, "_a").join(_sides(right, op, "_b"), KEYS)
    if op == "!=":
        holds = (F.col("least_a") != F.col("most_a")) | (F.col("least_b") != F.col("most_b")) | (F.col("least_a") != F.col("least_b"))
    else:
        a, b = _ENDS[op]
        holds = X.compare(F.col(f"{a}_a"), op, F.col(f"{b}_b"))
    return both.where(holds).select(*KEYS)


def compare_value(here: DataFrame, op: str, value: str | float | bool) -> DataFrame:
    """(ctx_id, tree_id) of the contexts where some node compares with a constant. A node is true against a truth value, and a
    number against a number; an order compares numbers."""
    text = F.coalesce("canon", F.lit(""))
    if isinstance(value, bool):
        holds = X.compare(F.lit(1.0), op, F.lit(float(value)))
    elif isinstance(value, str) and op in ("=", "!="):
        holds = (text == value) if op == "=" else (text != value)
    else:
        holds = X.compare(X.number(text), op, X.number(F.lit(value)) if isinstance(value, str) else F.lit(float(value)))
    return here.where(holds).select(*KEYS).distinct()


def lang(here: DataFrame, nodes: DataFrame, wanted: str, name: str = "@lang") -> DataFrame:
    """The contexts of ``here`` whose own annotation ``name``, or else that of their nearest ancestor which has one, is the
    language ``wanted`` or a variety of it."""
    up = here.select(*KEYS, "node_id", F.posexplode(F.concat("anc_ids", F.array("node_id"))).alias("_d", "_up"))
    notes = nodes.where((F.col("name") == name) & (F.col("kind") == "annotation")).select("tree_id", F.col("parent_id").alias("_up"), "canon")
    nearest = up.join(notes, ["tree_id", "_up"]).groupBy(*KEYS, "node_id").agg(F.max_by("canon", "_d").alias("_lang"))
    return here.join(nearest.where(X.lang_matches(F.col("_lang"), wanted)), [*KEYS, "node_id"], "left_semi")
