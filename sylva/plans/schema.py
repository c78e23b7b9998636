"""Schema models: declared node by node, kept as a small table, turned into Spark types and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sylva.operators import validate as V

# The Spark type of each leaf type.
SPARK_TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int",
    "uint32": "bigint", "uint64": "decimal(20,0)", "decimal64": "decimal(19,2)", "string": "string", "boolean": "boolean",
    "double": "double", "timestamp": "timestamp_ntz",
}


@dataclass
class Leaf:
    name: str
    type: str = "string"
    mandatory: bool = False
    default: object = None
    leafref: tuple[str, str] | None = None  # list and leaf
    must: str | None = None  # a Spark condition on the entry
    when: str | None = None


@dataclass
class ListNode:
    name: str
    keys: list[str]
    leaves: list[Leaf]
    parent: tuple[str, list[str]] | None = None  # parent list and the leaves that hold its keys
    unique: list[list[str]] = field(default_factory=list)
    min_elements: int = 0
    max_elements: int | None = None

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(x.name, T._parse_datatype_string(SPARK_TYPES[x.type]), not x.mandatory, {"default": x.default}) for x in self.leaves])


class Model:
    """The lists of a model by name. Model text is not parsed here: a model is declared in Python."""

    def __init__(self, *lists: ListNode):
        self.lists = {x.name: x for x in lists}

    def nodes(self, spark: SparkSession) -> DataFrame:
        """schema_nodes: one row per list and leaf."""
        rows = []
        for x in self.lists.values():
            rows.append((f"/{x.name}", None, x.name, "list", None, False, None, None))
            for leaf in x.leaves:
                ref = "/".join(["", *leaf.leafref]) if leaf.leafref else None
                default = None if leaf.default is None else str(leaf.default)
                rows.append((f"/{x.name}/{leaf.name}", f"/{x.name}", leaf.name, "leaf", leaf.type, leaf.mandatory, default, ref))
        return spark.createDataFrame(rows, "path string, parent string, name string, kind string, type string, mandatory boolean, default string, leafref string")

    def validate(self, tables: dict[str, DataFrame]) -> DataFrame:
        """All diagnostics of the tables, in the order of rules."""
        from pyspark.sql import functions as F

        checks = []
        for name, node in self.lists.items():
            df = tables[name]
            checks += [V.missing_keys(df, name, node.keys), V.duplicate_keys(df, name, node.keys)]
            checks += [V.unique(df, name, leaves) for leaves in node.unique]
            for leaf in node.leaves:
                if leaf.mandatory:
                    checks.append(V.mandatory(df, name, node.keys, leaf.name, F.expr(f"NOT ({leaf.when})") if leaf.when else None))
                if leaf.leafref:
                    checks.append(V.leafref(df, name, node.keys, leaf.name, tables[leaf.leafref[0]], leaf.leafref[1]))
                if leaf.must:
                    checks.append(V.must(df, name, node.keys, F.expr(leaf.must)))
                if leaf.when:
                    checks.append(V.when(df, name, node.keys, leaf.name, F.expr(leaf.when)))
            if node.parent and (node.min_elements or node.max_elements is not None):
                up, keys = node.parent
                checks.append(V.element_counts(tables[up], up, self.lists[up].keys, df, keys, node.min_elements, node.max_elements))
        return V.report(*checks)
