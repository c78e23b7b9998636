"""Conditions on presence, evaluated until nothing changes.

A rule names the nodes that it governs and a condition; where the condition is
false the nodes go, with their subtrees, and that may change what other
conditions see. Rules say which names they read. They are ordered by that: a rule
is evaluated when all rules that decide on what it reads are at rest. Rules that
read each other, in a circle, are evaluated together in rounds and are reported;
since nodes only go, the rounds end. Every round handles all nodes of all trees
at once. What is kept of a round is the ids of what went; the nodes themselves are
read again, as far as a rule needs their columns, so give a table that is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree as R
from .rounds import stored


@dataclass(frozen=True)
class When:
    """``holds`` gets the governed nodes as contexts and all nodes that are left, and returns the contexts for which the
    condition is true."""

    name: str
    holds: Callable[[DataFrame, DataFrame], DataFrame]
    reads: tuple[str, ...] = ()


def layers(rules: list[When]) -> list[list[When]]:
    """Rules in the order of what they read; those of a circle stand together. A rule also waits for rules on names that
    hold what it reads, if these are among its ``reads``."""
    on = {r: {s for s in rules if s.name in r.reads and s is not r} for r in rules}
    reach = {r: set(on[r]) for r in rules}
    while True:
        more = {r: reach[r] | {y for x in reach[r] for y in reach[x]} for r in rules}
        if more == reach:
            break
        reach = more
    out: list[list[When]] = []
    left = list(rules)
    while left:
        ready = [r for r in left if all(x not in left or r in reach[x] for x in reach[r])]
        circle = next((([x for x in ready if x in reach[r] and r in reach[x]] or [r]) for r in ready))
        out.append(circle if circle[0] in ready else [ready[0]])
        left = [r for r in left if r not in out[-1]]
    return out


def settle_whens(nodes: DataFrame, rules: list[When]) -> tuple[DataFrame, DataFrame, list[list[str]]]:
    """(nodes that stay, what went, circles): what went has round, name, tree_id and node_id of the governed nodes whose
    condition was false; circles are the names of rules that read each other."""
    now, rounds, gone, circles, lost = nodes, 0, None, [], None
    for layer in layers(rules):
        if len(layer) > 1 or layer[0].name in layer[0].reads:
            circles.append(sorted(r.name for r in layer))
        while True:
            rounds += 1
            false = None
            for r in layer:
                governed = R.context(now, F.col("name") == r.name)
                true = r.holds(governed, now).select("tree_id", "node_id").distinct()
                bad = governed.join(true, ["tree_id", "node_id"], "left_anti").select(F.lit(rounds).alias("round"), F.lit(r.name).alias("name"), "tree_id", "node_id", "kind")
                false = bad if false is None else false.unionByName(bad)
            false = stored(false)
            if false.isEmpty():
                break
            inner = false.where("kind <> 'leaf'").select("tree_id", F.col("node_id").alias("_up"))
            false = false.drop("kind")
            gone = false if gone is None else gone.unionByName(false)
            ids = false.select("tree_id", "node_id")
            if not inner.isEmpty():
                below = now.select("tree_id", "node_id", F.explode("anc_ids").alias("_up")).join(inner, ["tree_id", "_up"], "left_semi")
                ids = ids.unionByName(stored(below.select("tree_id", "node_id").distinct()))
            lost = ids if lost is None else lost.unionByName(ids)
            now = nodes.join(lost, ["tree_id", "node_id"], "left_anti").select(*nodes.columns)
            if len(layer) == 1 and layer[0].name not in layer[0].reads:
                break
    if gone is None:
        gone = nodes.select(F.lit(0).alias("round"), "name", "tree_id", "node_id").limit(0)
    return now, gone, circles
