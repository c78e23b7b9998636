"""What a schema implies: containers and default leaves that are not in the data, and which containers hold nothing else.

The schema's part is two small lists, by the paths of parents; everything else is
by joins over all trees at once. Node tables need the column path (names without
keys), as documents have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import settled

_COLUMNS = ["tree_id", "node_id", "parent_id", "anc_ids", "doc_key", "name", "kind", "canon", "path"]


def _missing(nodes: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """Children (up, name, value) that parents of the path lack, as nodes that are marked implicit. The list of wanted ones
    is the schema's, whatever the data; children named last in document order come after those that were given."""
    homes = nodes.where(F.col("kind").isin("container", "list")).join(wanted, F.col("path") == F.col("_up"))
    there = nodes.select("tree_id", F.col("parent_id").alias("_p"), F.col("name").alias("_n"))
    new = homes.alias("h").join(there.alias("t"), (F.col("h.tree_id") == F.col("t.tree_id")) & (F.col("h.node_id") == F.col("_p")) & (F.col("_name") == F.col("_n")), "left_anti")
    return new.select(
        "tree_id", F.concat("node_id", F.lit("/"), "_name").alias("node_id"), F.col("node_id").alias("parent_id"), F.concat("anc_ids", F.array("node_id")).alias("anc_ids"),
        F.concat("doc_key", F.array(F.concat(F.lit("~"), F.col("_name")))).alias("doc_key"), F.col("_name").alias("name"), F.lit(kind).alias("kind"), F.col("_value").alias("canon"),
        F.concat("path", F.lit("/"), "_name").alias("path"), F.lit(True).alias("implicit"),
    )


def implied(nodes: DataFrame, containers: list[str], leaves: dict[str, str]) -> DataFrame:
    """The table with what the schema implies: ``containers`` without presence, by path, and ``leaves`` with their default
    values, by path, wherever their parent is; column implicit tells the new ones. Top-level containers come into every
    tree. Containers go in from the top down, so that what they hold in turn is implied too."""
    spark = nodes.sparkSession
    out = nodes.select(*_COLUMNS, F.lit(False).alias("implicit"))
    trees = nodes.select("tree_id").distinct()
    depth = lambda p: p.count("/")
    split = lambda p: tuple(p.rsplit("/", 1))
    for path in [p for p in containers if depth(p) == 1]:
        lacking = trees.join(out.where(F.col("path") == path).select("tree_id"), "tree_id", "left_anti")
        none = F.array().cast("array<string>")
        out = out.unionByName(lacking.select("tree_id", F.lit(path).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), none.alias("anc_ids"), F.array(F.lit(f"~{path[1:]}")).alias("doc_key"), F.lit(path[1:]).alias("name"), F.lit("container").alias("kind"), F.lit(None).cast("string").alias("canon"), F.lit(path).alias("path"), F.lit(True).alias("implicit")))
    for level in sorted({depth(p) for p in containers if depth(p) > 1}):
        wanted = spark.createDataFrame([(*split(p), None) for p in containers if depth(p) == level], "_up string, _name string, _value string")
        out = settled(out)
        out = out.unionByName(_missing(out, wanted, "container"))
    if leaves:
        wanted = spark.createDataFrame([(*split(p), v) for p, v in leaves.items()], "_up string, _name string, _value string")
        out = settled(out)
        out = out.unionByName(_missing(out, wanted, "leaf"))
    return out


def container_flags(nodes: DataFrame, presence: list[str] = ()) -> DataFrame:
    """The table with default: a leaf is one if it is implicit; a container is one if everything below it is, and neither it
    nor anything below it is a list entry or a container with ``presence`` (paths). One pass marks the ancestors of all
    that is not a default, each once."""
    firm = F.when(F.col("kind") == "container", F.col("path").isin(*presence) if presence else F.lit(False)).when(F.col("kind") == "leaf", ~F.col("implicit")).otherwise(True)
    marks = nodes.where(firm).select("tree_id", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("node_id")).distinct().withColumn("_firm", F.lit(True))
    return nodes.join(marks, ["tree_id", "node_id"], "left").withColumn("default", F.col("_firm").isNull()).drop("_firm")
