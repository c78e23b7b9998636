"""Constraints as queries for what violates them.

Each check returns diagnostics: rule, path and message. ``report`` unites them
in the order of rules. Absent leaves are nulls and satisfy what does not ask
for presence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_of(name: str, keys: list[str]) -> Column:
    parts: list[Column] = [F.lit(f"/{name}")]
    for k in keys:
        parts += [F.lit(f"[{k}='"), F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit("']")]
    return F.concat(*parts)


def _diagnostics(df: DataFrame, rule: str, path: Column, message: Column | str) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(rule).alias("rule"), path.alias("path"), text.alias("message"))


def duplicate_keys(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _diagnostics(twice, "duplicate", path_of(name, keys), F.concat(F.col("n").cast("string"), F.lit(" instances")))


def missing_keys(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    lacking = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return _diagnostics(df.where(lacking), "missing-key", path_of(name, keys), "list instance lacks its key")


def unique(df: DataFrame, name: str, leaves: list[str], within: list[str] = ()) -> DataFrame:
    """Entries without one of the leaves are left out."""
    full = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in leaves]))
    twice = full.groupBy(*within, *leaves).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _diagnostics(twice, "data-not-unique", path_of(name, [*within, *leaves]), F.concat(F.col("n").cast("string"), F.lit(" entries")))


def leafref(df: DataFrame, name: str, keys: list[str], leaf: str, target: DataFrame, target_leaf: str, within: list[str] = ()) -> DataFrame:
    """References without an instance: an anti join, so a missing target costs no more than a hit. Columns ``within``, such
    as a tree's id, must agree too."""
    there = target.select(F.col(target_leaf).alias("_t"), *[F.col(c).alias(f"_w_{c}") for c in within]).where("_t IS NOT NULL").distinct()
    same = F.col(leaf) == F.col("_t")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    bad = df.where(F.col(leaf).isNotNull()).join(there, same, "left_anti")
    return _diagnostics(bad, "instance-required", path_of(name, keys), F.concat(F.lit(f"{leaf} refers to "), F.col(leaf).cast("string")))


def leafref_links(df: DataFrame, keys: list[str], leaf: str, target: DataFrame, target_key: str) -> DataFrame:
    return df.join(target.select(F.col(target_key).alias("_t")), F.col(leaf) == F.col("_t")).select(*keys, F.col("_t").alias("target"))


def must(df: DataFrame, name: str, keys: list[str], condition: Column, message: str = "must condition is false") -> DataFrame:
    return _diagnostics(df.where(~F.coalesce(condition, F.lit(False))), "must-violation", path_of(name, keys), message)


def when(df: DataFrame, name: str, keys: list[str], leaf: str, condition: Column) -> DataFrame:
    bad = df.where(F.col(leaf).isNotNull() & ~F.coalesce(condition, F.lit(False)))
    return _diagnostics(bad, "when-violation", path_of(name, keys), f"{leaf} is present though its when is false")


def drop_when_false(df: DataFrame, leaf: str, condition: Column) -> DataFrame:
    """Auto-deletes the leaf where its condition is false."""
    return df.withColumn(leaf, F.when(F.coalesce(condition, F.lit(False)), F.col(leaf)))


def mandatory(df: DataFrame, name: str, keys: list[str], leaf: str, unless: Column | None = None) -> DataFrame:
    bad = F.col(leaf).isNull() & (~F.coalesce(unless, F.lit(False)) if unless is not None else F.lit(True))
    return _diagnostics(df.where(bad), "missing-leaf", path_of(name, keys), f"mandatory {leaf} is absent")


def choice(df: DataFrame, name: str, keys: list[str], cases: dict[str, list[str]], required: bool = False) -> DataFrame:
    """More than one case present, or none of a mandatory choice."""
    on = [reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in leaves]).cast("int") for leaves in cases.values()]
    n = reduce(lambda a, b: a + b, on)
    bad = (n > 1) | (n == 0) if required else n > 1
    return _diagnostics(df.where(bad), "choice", path_of(name, keys), F.concat(n.cast("string"), F.lit(" cases present")))


def element_counts(parents: DataFrame, name: str, keys: list[str], children: DataFrame, child_keys: list[str], low: int = 0, high: int | None = None) -> DataFrame:
    """Parents with too few or too many entries, those without any included."""
    n = children.groupBy(*[F.col(c).alias(k) for c, k in zip(child_keys, keys)]).agg(F.count(F.lit(1)).alias("_n"))
    both = parents.select(*keys).join(n, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    bad = F.col("_n") < low
    rule = F.lit("too-few-elements")
    if high is not None:
        rule = F.when(F.col("_n") > high, "too-many-elements").otherwise(rule)
        bad |= F.col("_n") > high
    return both.where(bad).select(rule.alias("rule"), path_of(name, keys).alias("path"), F.concat(F.col("_n").cast("string"), F.lit(" entries")).alias("message"))


def bad_values(df: DataFrame, name: str, keys: list[str], stored: Column) -> DataFrame:
    """Values that their type does not store."""
    bad = df.withColumn("_s", stored).where("NOT _s.ok")
    return _diagnostics(bad, "invalid-value", path_of(name, keys), F.col("_s.error"))


def defaults(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Absent leaves take their defaults; <leaf>_default tells which did."""
    for leaf, value in values.items():
        df = df.withColumn(f"{leaf}_default", F.col(leaf).isNull()).withColumn(leaf, F.coalesce(F.col(leaf), F.lit(value)))
    return df


def with_defaults(df: DataFrame, values: dict[str, object], mode: str) -> DataFrame:
    """What a printer shows: report-all, explicit (set leaves), trim (leaves that differ from their default), or
    report-all-tagged, where <leaf>_tagged says which values equal their defaults."""
    for leaf, value in values.items():
        if mode == "trim":
            df = df.withColumn(leaf, F.when(F.col(leaf) != F.lit(value), F.col(leaf)))
        elif mode == "report-all-tagged":
            df = df.withColumn(f"{leaf}_tagged", F.coalesce(F.col(leaf) == F.lit(value), F.lit(False)))
        elif mode == "explicit":
            df = df.withColumn(leaf, F.when(~F.col(f"{leaf}_default"), F.col(leaf)))
    return df


def identity_closure(bases: DataFrame) -> DataFrame:
    """(base, derived) for every chain of (derived, base) rows, by joins that double the length of chains."""
    pairs = bases.select("base", "derived").distinct().persist()
    known = pairs.count()
    while True:
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.derived") == F.col("b.base")).select("a.base", "b.derived")
        before, pairs = pairs, pairs.unionByName(longer).distinct().persist()
        now = pairs.count()
        before.unpersist()
        if now == known:
            return pairs
        known = now


def derived_from(df: DataFrame, leaf: str, closure: DataFrame, base: str, or_self: bool = False) -> DataFrame:
    """Rows whose identity is derived from ``base``, or with ``or_self`` is it."""
    below = closure.where(F.col("base") == base).select(F.col("derived").alias("_i"))
    if or_self:
        below = below.unionByName(below.sparkSession.createDataFrame([(base,)], "_i string"))
    return df.join(below.distinct(), F.col(leaf) == F.col("_i"), "left_semi")


def instance_required(df: DataFrame, name: str, keys: list[str], leaf: str, nodes: DataFrame) -> DataFrame:
    """Instance identifiers without a node: the leaf holds a data path. Entries that name their tree_id need it in that tree."""
    there = nodes.select(F.col("node_id").alias("_n"), F.col("tree_id").alias("_t"))
    same = F.col("tree_id") == F.col("_t") if "tree_id" in df.columns else F.lit(True)
    bad = df.where(F.col(leaf).isNotNull()).join(there, (F.col(leaf) == F.col("_n")) & same, "left_anti")
    return _diagnostics(bad, "instance-required", path_of(name, keys), F.concat(F.lit(f"{leaf} names no node: "), F.col(leaf)))


def resolve_union(df: DataFrame, leaf: str, targets: dict[str, tuple[DataFrame, str]], otherwise: str) -> DataFrame:
    """``<leaf>_member``: the first member type, a reference into its target, that the data hold an instance for."""
    member = F.lit(None).cast("string")
    for i, (kind, (target, column)) in enumerate(targets.items()):
        there = target.select(F.col(column).cast("string").alias(f"_r{i}")).distinct()
        df = df.join(there, F.col(leaf) == F.col(f"_r{i}"), "left")
        member = F.coalesce(member, F.when(F.col(f"_r{i}").isNotNull(), kind))
    found = F.when(F.col(leaf).isNotNull(), F.coalesce(member, F.lit(otherwise)))
    return df.withColumn(f"{leaf}_member", found).drop(*[f"_r{i}" for i in range(len(targets))])


def drop_superseded(df: DataFrame, keys: list[str], is_default: str) -> DataFrame:
    """Entries of leaf-lists less the defaults of those that hold a value that was set."""
    given = df.where(~F.col(is_default)).select(*keys).distinct()
    return df.where(~F.col(is_default)).unionByName(df.where(is_default).join(given, keys, "left_anti").select(*df.columns))


def unexpected(df: DataFrame, name: str, keys: list[str], leaves: dict[str, str]) -> DataFrame:
    """Present leaves of a kind (state, input, output) that the tree may not hold."""
    return report(*[_diagnostics(df.where(F.col(c).isNotNull()), f"unexpected-{kind}", path_of(name, keys), f"{kind} node {c} is present") for c, kind in leaves.items()])


def obsolete(df: DataFrame, name: str, keys: list[str], leaves: list[str]) -> DataFrame:
    """Warnings for present leaves that the schema calls obsolete."""
    return report(*[_diagnostics(df.where(F.col(c).isNotNull()), "obsolete", path_of(name, keys), f"{c} is obsolete") for c in leaves])


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
