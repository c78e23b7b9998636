"""Differences of keyed tables: made, applied, merged, reversed.

A diff has the key columns, op (create, delete, replace or none) and for each
leaf its new value ``<leaf>`` and old value ``orig_<leaf>``. Keys are unique in
a table; for bags, number equal instances first with ``with_occurrence``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_occurrence(df: DataFrame, columns: list[str], out: str = "occ") -> DataFrame:
    """Numbers equal instances, so that bags match by occurrence. Any order will do among equals."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0))))


def diff(first: DataFrame, second: DataFrame, keys: list[str], leaves: list[str], keep_equal: bool = False) -> DataFrame:
    """What turns first into second, as one full outer join."""
    a = first.select(*keys, *leaves).withColumn("_in", F.lit(True))
    b = second.select(*[F.col(c).alias(f"n_{c}") for c in [*keys, *leaves]]).withColumn("_new", F.lit(True))
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"n_{k}"))
    both = a.join(b, match, "full_outer")
    same = F.lit(True)
    for c in leaves:
        same &= F.col(c).eqNullSafe(F.col(f"n_{c}"))
    op = F.when(F.col("_in").isNull(), "create").when(F.col("_new").isNull(), "delete").when(same, "none").otherwise("replace")
    both = both.withColumn("op", op)
    both = both if keep_equal else both.where("op <> 'none'")
    return both.select(
        *[F.when(F.col("op") == "create", F.col(f"n_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        "op",
        *[F.col(f"n_{c}").alias(c) for c in leaves],
        *[F.col(c).alias(f"orig_{c}") for c in leaves],
    )


def conflicts(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes that cannot be applied: create of what exists, anything else of what does not."""
    return changes.where("op = 'create'").join(base.select(*keys), keys, "left_semi").unionByName(
        changes.where("op <> 'create'").join(base.select(*keys), keys, "left_anti")
    )


def apply_diff(base: DataFrame, changes: DataFrame, keys: list[str], leaves: list[str], strict: bool = True) -> DataFrame:
    """Base after the changes. A change that cannot be applied (see ``conflicts``), and the op 'error' of a merge, fail
    the job; without ``strict`` such changes do nothing."""
    c = changes.select(*[F.col(k).alias(f"c_{k}") for k in keys], "op", *[F.col(x).alias(f"c_{x}") for x in leaves])
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"c_{k}"))
    both = base.select(*keys, *leaves, F.lit(True).alias("_in")).join(c, match, "full_outer")
    wrong = F.when(F.col("op") == "create", F.col("_in").isNotNull()).otherwise(F.col("op").isNotNull() & F.col("_in").isNull()) | (F.col("op") == "error")
    wrong = F.coalesce(wrong, F.lit(False))
    if strict:
        text = F.concat(F.lit("cannot "), F.col("op"), F.lit(" "), F.concat_ws(", ", *[F.coalesce(f"c_{k}", k).cast("string") for k in keys]))
        both = both.where(F.when(wrong, F.raise_error(text).cast("boolean")).otherwise(True))
    else:
        both = both.withColumn("op", F.when(~wrong, F.col("op"))).where("_in OR op = 'create'")
    both = both.where("op IS NULL OR op <> 'delete'")
    made = F.col("op").isin("create", "replace")
    return both.select(
        *[F.when(F.col("_in").isNull(), F.col(f"c_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        *[F.when(F.coalesce(made, F.lit(False)), F.col(f"c_{x}")).otherwise(F.col(x)).alias(x) for x in leaves],
    )


def reverse(changes: DataFrame, keys: list[str], leaves: list[str]) -> DataFrame:
    op = F.when(F.col("op") == "create", "delete").when(F.col("op") == "delete", "create").otherwise(F.col("op"))
    return changes.select(*keys, op.alias("op"), *[F.col(f"orig_{c}").alias(c) for c in leaves], *[F.col(c).alias(f"orig_{c}") for c in leaves])


# The operation that two in a row come to; "same" asks whether the value is back where it began.
ALGEBRA = {
    ("create", "replace"): "create", ("create", "delete"): "drop", ("create", "none"): "create",
    ("replace", "replace"): "same", ("replace", "delete"): "delete", ("replace", "none"): "replace",
    ("delete", "create"): "same", ("none", "replace"): "replace", ("none", "delete"): "delete", ("none", "none"): "drop",
}


def merge_diffs(first: DataFrame, second: DataFrame, keys: list[str], leaves: list[str]) -> DataFrame:
    """One diff with the effect of both in turn; impossible pairs get the op 'error'."""
    cells = F.create_map(*[F.lit(x) for (a, b), c in ALGEBRA.items() for x in (f"{a} {b}", c)])
    a = first.select(*keys, F.col("op").alias("op1"), *[F.col(f"orig_{c}").alias(f"o_{c}") for c in leaves], *[F.col(c).alias(f"a_{c}") for c in leaves])
    b = second.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("op").alias("op2"), *[F.col(f"orig_{c}").alias(f"p_{c}") for c in leaves], *[F.col(c).alias(f"b_{c}") for c in leaves])
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
    both = a.join(b, match, "full_outer")
    one = F.col("op2").isNull()
    two = F.col("op1").isNull()
    back = F.lit(True)
    for c in leaves:
        back &= F.col(f"b_{c}").eqNullSafe(F.col(f"o_{c}"))
    cell = F.coalesce(cells[F.concat_ws(" ", "op1", "op2")], F.lit("error"))
    op = F.when(one, F.col("op1")).when(two, F.col("op2")).when(cell == "same", F.when(back, "drop").otherwise("replace")).otherwise(cell)
    out = both.withColumn("op", op).where("op <> 'drop'")
    return out.select(
        *[F.when(two, F.col(f"k_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        "op",
        *[F.when(one | (F.col("op2") == "none"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in leaves],
        *[F.when(two, F.col(f"p_{c}")).otherwise(F.col(f"o_{c}")).alias(f"orig_{c}") for c in leaves],
    )


def merge_trees(target: DataFrame, source: DataFrame, keys: list[str], leaves: list[str]) -> DataFrame:
    """Source's leaves override, missing entries are copied, absent source leaves change nothing."""
    s = source.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[F.col(c).alias(f"s_{c}") for c in leaves])
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"s_{k}"))
    both = target.select(*keys, *leaves).join(s, match, "full_outer")
    return both.select(*[F.coalesce(f"s_{c}", c).alias(c) for c in [*keys, *leaves]])


def move_anchors(rows: DataFrame, group: list[str], key: str, position: str) -> DataFrame:
    """User-ordered entries with the key of the entry before each, null for the first."""
    w = Window.partitionBy(*group).orderBy(position)
    return rows.withColumn("anchor", F.lag(key).over(w))


def move(rows: DataFrame, group: list[str], key: str, position: str, moves: DataFrame) -> DataFrame:
    """User-ordered entries after moves (group, key, anchor): each entry goes behind its anchor, or to the front if that
    is null. All moves see the old order; of several behind one anchor the earlier entry comes first. Positions are
    numbered anew from 1. Moves of absent entries, or behind absent ones, do nothing."""
    old = rows.select(*[F.col(c).alias(f"_{c}") for c in group], F.col(key).alias("_anchor"), F.col(position).alias("_place"))
    m = moves.select(*[F.col(c).alias(f"m_{c}") for c in group], F.col(key).alias("m_key"), F.col("anchor").alias("m_anchor"))
    same = [F.col(f"m_{c}") == F.col(f"_{c}") for c in group]
    placed = m.join(old, [*same, F.col("m_anchor") == F.col("_anchor")], "left").where("m_anchor IS NULL OR _place IS NOT NULL")
    placed = placed.select(*[f"m_{c}" for c in group], "m_key", F.coalesce(F.col("_place"), F.lit(0)).alias("_behind"))
    out = rows.join(placed, [*[F.col(c) == F.col(f"m_{c}") for c in group], F.col(key) == F.col("m_key")], "left")
    stays = F.col("m_key").isNull()
    order = [F.when(stays, F.col(position)).otherwise(F.col("_behind")), stays.desc(), F.col(position)]
    now = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return out.select(*[now.alias(c) if c == position else F.col(c) for c in rows.columns])


def moves_between(first: DataFrame, second: DataFrame, group: list[str], key: str, position: str) -> DataFrame:
    """(group, key, anchor, orig_anchor) of entries of both whose entry before them changed."""
    a = move_anchors(first, group, key, position).select(*group, key, F.col("anchor").alias("orig_anchor"))
    b = move_anchors(second, group, key, position).select(*group, key, "anchor")
    return b.join(a, [*group, key]).where(~F.col("anchor").eqNullSafe(F.col("orig_anchor")))


def upsert(base: DataFrame, edits: DataFrame, keys: list[str], leaves: list[str]) -> DataFrame:
    """Base with the entries of ``edits`` made or changed, and what each came to: created, changed, same or kept."""
    e = edits.select(*[F.col(k).alias(f"e_{k}") for k in keys], *[F.col(c).alias(f"e_{c}") for c in leaves], F.lit(True).alias("_edit"))
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"e_{k}"))
    both = base.select(*keys, *leaves, F.lit(True).alias("_in")).join(e, match, "full_outer")
    equal = F.lit(True)
    for c in leaves:
        equal &= F.col(f"e_{c}").isNull() | F.col(c).eqNullSafe(F.col(f"e_{c}"))
    done = F.when(F.col("_edit").isNull(), "kept").when(F.col("_in").isNull(), "created").when(equal, "same").otherwise("changed")
    return both.select(*[F.coalesce(f"e_{c}", c).alias(c) for c in [*keys, *leaves]], done.alias("done"))
