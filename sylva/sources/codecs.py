"""Reading and printing trees as JSON or XML with Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What may become of input that the schema does not know.
POLICIES = ("reject", "skip", "opaque")


def parse_json(df: DataFrame, column: str, schema: T.StructType | str, policy: str = "skip") -> DataFrame:
    """A struct column ``data`` from JSON texts; leaves are read as text where the schema says so, so that number
    tokens keep their form. Top-level members that the schema lacks fail the job (reject), are left out (skip) or stay
    in a map column ``opaque``."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    out = df.withColumn("data", F.from_json(column, kind, {"mode": "PERMISSIVE"}))
    known = F.array(*[F.lit(f.name) for f in kind.fields])
    if policy == "opaque":
        out = out.withColumn("opaque", F.map_filter(F.from_json(column, "map<string,string>"), lambda k, v: ~F.array_contains(known, k)))
    if policy == "reject":
        more = F.array_except(F.json_object_keys(column), known)
        fail = F.raise_error(F.concat(F.lit("unknown members: "), F.concat_ws(", ", more))).cast("boolean")
        out = out.where(F.when(F.coalesce(F.size(more), F.lit(0)) > 0, fail).otherwise(True))
    return out


def unknown_members(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Rows with top-level members that the schema lacks, and which."""
    keys = F.array_except(F.json_object_keys(column), F.array(*map(F.lit, known)))
    return df.withColumn("unknown", keys).where(F.size("unknown") > 0)


def shred_json(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """One row per top-level member: name and its value as text."""
    return df.select(id_col, F.explode(F.from_json(column, "map<string,string>")).alias("name", "canon"))


def metadata(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """Annotations: members named @x annotate the member x."""
    rows = shred_json(df, id_col, column).where(F.startswith("name", F.lit("@")))
    return rows.select(id_col, F.substring("name", F.lit(2), F.length("name")).alias("node"), F.explode(F.from_json("canon", "map<string,string>")).alias("annotation", "value"))


def print_json(columns: list[str], shrink: bool = True) -> Column:
    """Absent leaves print nothing."""
    return F.to_json(F.struct(*columns), {"pretty": str(not shrink).lower(), "ignoreNullFields": "true"})


def print_nested(parents: DataFrame, children: DataFrame, keys: list[str], child_columns: list[str], member: str, order: str) -> DataFrame:
    """Parents with their child list as one JSON array, in order. A parent's list is one value of the document."""
    packed = children.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in child_columns if c != order]))).alias(member))
    return parents.join(packed, keys, "left")


def print_xml(columns: list[str], row: str = "entry") -> Column:
    return F.to_xml(F.struct(*columns), {"rowTag": row, "indent": ""})


def parse_xml(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn("data", F.from_xml(column, schema))


def unwrap(envelope: Column, path: str) -> Column:
    """The body inside an rpc or notification envelope."""
    return F.get_json_object(envelope, f"$.{path}")


def open_json(df: DataFrame, column: str) -> DataFrame:
    """Operation bodies in JSON: ``op_kind``, the outer member's name without its module, and ``body``, its text. What is
    no object of one member has neither."""
    members = F.from_json(column, "map<string,string>")
    outer = F.map_keys(members)[0]
    one = F.size(members) == 1
    return df.withColumn("op_kind", F.when(one, F.regexp_replace(outer, "^[^:]*:", ""))).withColumn("body", F.when(one, members[outer]))


def open_xml(df: DataFrame, column: str) -> DataFrame:
    """Envelopes in XML: ``op_kind`` is the outer element (rpc, rpc-reply, notification), ``message_id`` and
    ``stamp`` are its attribute and its eventTime, ``ok`` an empty reply, ``body_name`` the operation's element."""
    def at(path: str) -> Column:
        return F.xpath_string(column, F.lit(path))

    body = "/*/*[local-name()!='eventTime' and local-name()!='ok']"
    return (
        df.withColumn("op_kind", at("local-name(/*)")).withColumn("message_id", F.nullif(at("string(/*/@message-id)"), F.lit("")))
        .withColumn("stamp", F.nullif(at("string(/*/*[local-name()='eventTime'])"), F.lit("")))
        .withColumn("ok", F.xpath_boolean(column, F.lit("/*/*[local-name()='ok']"))).withColumn("body_name", F.nullif(at(f"local-name({body})"), F.lit("")))
    )


def reprefix(name: Column, prefixes: dict[str, str]) -> Column:
    """Identity names by module, as JSON has them, printed by prefix, as XML has them; names without a module, and those
    of modules without a prefix, stay as they are."""
    known = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    module = F.regexp_extract(name, "^([^:]+):", 1)
    return F.coalesce(F.concat(known[module], F.regexp_replace(name, "^[^:]+", "")), name) if prefixes else name


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Notification stamps as event time; what is no date-and-time is null."""
    return df.withColumn("event_time", F.try_to_timestamp(F.col(column)))
