"""Whole documents of any shape as node tables, and node tables as documents.

``shred_json`` has Spark read each text into a variant and write it again, so that
members are in order and numbers have one form, and opens it in one Arrow pass;
there is no shuffle, no schema and no pass over the texts before. ``print_json``
folds the other way: one shuffle brings the nodes of a tree together in document
order, and what nothing more comes below becomes text.

Node tables have the columns of ``sylva.operators.tree`` and further ones that a
document needs: label (the member's name as written), module (of the node, taken
over from its parent where it is not written), path (names without keys), type
(string, number, boolean, null, object, opaque) and multi (element of an array).

Entries of lists are named by their keys, as in ``/a/list[k='x']``, elements of
leaf-lists by their value, as in ``/a/tag[.='x']``, both with quotes doubled; an
element without keys, or of a leaf-list in which a value repeats, is named by its
position. So that documents compare, members come in the order of their names.

Numbers of up to 38 digits keep their value as text, exponents are expanded, and
64-bit integers that come as strings stay as written.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.rounds import ROWS_AT_ONCE, streamed

# What may become of input that the shape does not know.
POLICIES = ("reject", "skip", "opaque")
SCHEMA = "tree_id string, node_id string, parent_id string, anc_ids array<string>, doc_key array<string>, name string, kind string, canon string, label string, module string, path string, type string, multi boolean"


@dataclass
class Shape:
    """What is known of documents: the keys of lists by path, subtrees that stay text, and all paths that may occur."""

    lists: dict[str, list[str]] = field(default_factory=dict)
    text: set[str] = field(default_factory=set)
    known: set[str] | None = None
    unknown: str = "opaque"
    leaf_lists: set[str] = field(default_factory=set)  # elements that occur once need this in XML

    def __post_init__(self):
        if self.unknown not in POLICIES:
            raise ValueError(f"unknown policy {self.unknown}")


class _Written(str):
    """What stands in JSON as it is written: numbers, braces."""


_MARKS = {c: f"\\u{c:04X}" for c in range(32)} | {ord(c): "\\" + x for c, x in zip('\b\t\n\f\r"\\', 'btnfr"\\')}
_MARKED = re.compile(r'[\x00-\x1f"\\]')


def _quoted(text: str) -> str:
    """A text inside a path."""
    return "'" + text.replace("'", "''") + "'"


def _json_quoted(text: str) -> str:
    return f'"{text.translate(_MARKS) if _MARKED.search(text) else text}"'


def _json_of(value: object) -> str:
    """JSON of a value as it was read, without recursion."""
    out, left = [], [value]
    while left:
        v = left.pop()
        kind = type(v)
        if kind is _Written:
            out.append(v)
        elif kind is str:
            out.append(_json_quoted(v))
        elif kind is dict:
            parts = [x for k, e in v.items() for x in (_Written(f",{_json_quoted(k)}:"), e)]
            parts[:1] = [_Written(f"{{{parts[0][1:]}")] if parts else [_Written("{")]
            left += [_Written("}"), *reversed(parts)]
        elif kind is list:
            parts = [x for e in v for x in (_Written(","), e)]
            left += [_Written("]"), *reversed(parts[1:]), _Written("[")]
        else:
            out.append("null" if v is None else "true" if v else "false")
    return "".join(out)


def _plain(value: object) -> str | None:
    """A value as text."""
    return value if isinstance(value, str) else None if value is None else _json_of(value)


_TYPES = {str: "string", _Written: "number", bool: "boolean", type(None): "null"}


#: What members of one label below one path have in common is remembered for so many of them.
LABELS = 10_000
_PLACES = [f"{i:06d}.0000000000" for i in range(1000)]


def _label_facts(up_path: str, label: str, shape: Shape) -> tuple:
    """What a member's label and its parent's path decide: name, path, own module, note, odd, sealed, keys."""
    note = label.startswith("@")
    prefix, colon, rest = label.partition(":")
    name = rest if colon and "@" not in prefix else label
    path = f"{up_path}/{name}"
    odd = shape.known is not None and not note and path not in shape.known
    return name, path, prefix if colon and not note else None, note, odd, note or odd or path in shape.text, shape.lists.get(path)


def _json_nodes(tree: str | None, document: dict, shape: Shape, depth: int | None, facts: dict[tuple[str, str], tuple]) -> Iterator[tuple]:
    """Nodes of one JSON document; members come in their order. ``facts`` is kept from one document to the next."""
    stack, first = [(document, "", [], [], "", None, 1)], None
    while stack:
        members, up, above, order, up_path, up_module, level = stack.pop()
        parent, anc = up or None, [*above, up] if up else above
        opens = depth is None or level < depth
        for i, (label, content) in enumerate(members.items()):
            known = facts.get((up_path, label))
            if known is None:
                if len(facts) >= LABELS:
                    facts.clear()
                known = facts[up_path, label] = _label_facts(up_path, label, shape)
            name, path, module, note, odd, sealed, keys = known
            if odd and shape.unknown == "skip":
                continue
            if module is None:
                module = up_module
            stem, multi = f"{up}/{name}", type(content) is list and not note
            if not multi:
                kind_of = type(content)
                opaque = sealed or kind_of is list
                key = [*order, _PLACES[i] if i < 1000 else f"{i:06d}.0000000000"]
                if odd:
                    first = min(first or (key, stem), (key, stem))
                if opaque:
                    yield (tree, stem, parent, anc, key, name, "annotation" if note else "opaque", _json_of(content), label, module, path, "opaque", False)
                elif kind_of is dict:
                    yield (tree, stem, parent, anc, key, name, "container", None, label, module, path, "object", False)
                    if opens and content:
                        stack.append((content, stem, anc, key, path, module, level + 1))
                else:
                    yield (tree, stem, parent, anc, key, name, "leaf", _plain(content), label, module, path, _TYPES[kind_of], False)
                continue
            # Elements that are no objects are named by their values if these tell them apart.
            texts = [_plain(x) for x in content] if any(type(x) is not dict for x in content) else None
            alone = texts is not None and len(set(texts)) == len(texts)
            for j, value in enumerate(content):
                kind_of = type(value)
                opaque = sealed or kind_of is list
                inner = kind_of is dict and not opaque
                held = [_plain(value.get(k)) for k in keys] if inner and keys is not None else [None]
                if None not in held:
                    step = "".join([f"[{k}={_quoted(t)}]" for k, t in zip(keys, held)])
                elif alone and not inner and not opaque and value is not None:
                    step = f"[.={_quoted(texts[j])}]"
                else:
                    step = f"[{j + 1}]"
                here = stem + step
                key = [*order, f"{i:06d}.{j:010d}"]
                if odd:
                    first = min(first or (key, here), (key, here))
                if inner:
                    yield (tree, here, parent, anc, key, name, "list", None, label, module, path, "object", True)
                    if opens and value:
                        stack.append((value, here, anc, key, path, module, level + 1))
                else:
                    yield (tree, here, parent, anc, key, name, "opaque" if opaque else "leaf", _json_of(value) if opaque else texts[j], label, module, path, "opaque" if opaque else _TYPES[kind_of], True)
    if first is not None and shape.unknown == "reject":
        raise ValueError(f"unknown node {first[1]}")


def _packed(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _node_table(frame: DataFrame, nodes_of: Callable[[tuple], Iterable[tuple]]) -> DataFrame:
    """The nodes that ``nodes_of`` makes of each row, handed back some at a time, however many a document has."""
    schema = pa.schema([(n, pa.list_(pa.string()) if t.startswith("array") else pa.bool_() if t == "boolean" else pa.string()) for n, t in (x.strip().split(" ") for x in SCHEMA.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                for node in nodes_of(row):
                    held.append(node)
                    if len(held) == ROWS_AT_ONCE:
                        yield _packed(held, schema)
                        held = []
        if held:
            yield _packed(held, schema)

    return frame.mapInArrow(run, SCHEMA)


def shred_json(docs: DataFrame, tree_id: Column, column: str, shape: Shape | None = None, depth: int | None = None) -> DataFrame:
    """Nodes of JSON documents, one tree each. ``depth`` levels are opened; left out, all.

    A number too large for a double is the text Infinity. A text that is no JSON object becomes one node of kind opaque at the root; a null text has no nodes.
    """
    shape = shape or Shape()
    # Spark reads the texts: what it writes again has members in order and numbers in one form.
    read = F.to_json(F.try_parse_json(column))
    frame = docs.where(F.col(column).isNotNull()).select(tree_id.cast("string").alias("tree_id"), F.col(column).alias("_text"), read.alias("_json"))
    # The text itself is wanted only where it is no object.
    frame = frame.select("tree_id", F.when(F.startswith("_json", F.lit("{")), F.col("_json")).alias("_json"), F.when(~F.coalesce(F.startswith("_json", F.lit("{")), F.lit(False)), F.col("_text")).alias("_text"))

    facts: dict[tuple[str, str], tuple] = {}

    def nodes_of(row: tuple) -> Iterable[tuple]:
        tree, read, text = row
        if read is None:
            return [(tree, "/", None, [], [], "", "opaque", text, "", None, "", "opaque", False)]
        return _json_nodes(tree, json.loads(read, parse_int=_Written, parse_float=_Written), shape, depth, facts) if depth != 0 else []

    return _node_table(frame, nodes_of)


def _xml_nodes(tree: str, text: str, shape: Shape) -> Iterator[tuple]:
    """Nodes of one XML document, in document order."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        yield (tree, "/", None, [], [], "", "opaque", text, "", None, "", "opaque", False)
        return

    def split(tag: str) -> tuple[str | None, str]:
        return tuple(tag[1:].split("}", 1)) if tag[0] == "{" else (None, tag)

    stack = [(root, "", [], [], "", None, 0, "", False)]
    while stack:
        e, up, above, order, up_path, module, at, predicate, multi = stack.pop()
        space, name = split(e.tag)
        module, path = space or module, f"{up_path}/{name}"
        here, key = f"{up}/{name}{predicate}", [*order, f"{at:06d}.0000000000"]
        anc = [*above, up] if up else above
        unknown = shape.known is not None and path not in shape.known
        if unknown and shape.unknown == "reject":
            raise ValueError(f"unknown node {here}")
        if unknown and shape.unknown == "skip":
            continue
        opaque, inner = unknown or path in shape.text, len(e) > 0
        kind = "opaque" if opaque else ("list" if path in shape.lists or multi else "container") if inner or path in shape.lists else "leaf"
        value = ET.tostring(e, encoding="unicode") if opaque else None if inner else e.text or ""
        yield (tree, here, up or None, anc, key, name, kind, value, name, module, path, "opaque" if opaque else "object" if kind != "leaf" else "string", multi)
        for i, (k, v) in enumerate(e.attrib.items()):
            owner, attribute = split(k)
            yield (tree, f"{here}/@{attribute}", here, [*anc, here], [*key, f" {i:06d}"], f"@{attribute}", "annotation", v, f"@{attribute}", owner, f"{path}/@{attribute}", "opaque", False)
        if opaque:
            continue
        same: dict[str, list] = {}
        for c in e:
            same.setdefault(c.tag, []).append(c)
        place = {c: i for group in same.values() for i, c in enumerate(group, 1)}
        unique = {tag: len({x.text or "" for x in group}) == len(group) for tag, group in same.items()}
        for i, c in reversed(list(enumerate(e))):
            group, below = same[c.tag], f"{path}/{split(c.tag)[1]}"
            many = len(group) > 1 or below in shape.lists or below in shape.leaf_lists
            step = ""
            if many:
                values = {split(x.tag)[1]: x.text or "" for x in c}
                keys = shape.lists.get(below)
                if keys and all(k in values for k in keys):
                    step = "".join(f"[{k}={_quoted(values[k])}]" for k in keys)
                elif not len(c) and unique[c.tag]:
                    step = f"[.={_quoted(c.text or '')}]"
                else:
                    step = f"[{place[c]}]"
            stack.append((c, here, anc, key, path, module, i, step, many))


def shred_xml(docs: DataFrame, tree_id: Column, column: str, shape: Shape | None = None) -> DataFrame:
    """Nodes of XML documents. Text stays text, elements that occur again are lists or leaf-lists, attributes are
    annotations; names and modules (namespaces) are apart. Spark's own reader would guess types, so an Arrow pass parses
    each document once. What is not well-formed is one opaque node."""
    shape = shape or Shape()
    frame = docs.where(F.col(column).isNotNull()).select(tree_id.cast("string").alias("tree_id"), F.col(column).cast("string").alias("_text"))
    return _node_table(frame, lambda row: _xml_nodes(*row, shape))


def _place() -> Column:
    """doc_key as one text in the same order, which ends so that only what is below begins with it."""
    return F.concat(F.array_join("doc_key", "\0"), F.lit("\0")).alias("_place")


class _Fold:
    """Folds the nodes of one tree, which come in document order, from the leaves up: a node that nothing more comes below
    becomes its text, which its parent holds, so that what is kept is texts and the nodes on the way down."""

    def __init__(self):
        self.top: list = []
        self.open: list[tuple] = []  # (place, id, node) on the way down; nodes may share a place

    def parent(self, place: str, up: str | None):
        """What holds the children of the node ``up``; nothing if it isn't there."""
        while self.open and not place.startswith(self.open[-1][0]):
            self.close(self.open.pop()[2])
        return self.top if up is None else next((node for _, name, node in reversed(self.open) if name == up), None)

    def rest(self) -> None:
        while self.open:
            self.close(self.open.pop()[2])


class _JsonFold(_Fold):
    """Nodes as lists of label, multi, tagged, text and children; what has no text in the end is left out."""

    def __init__(self, empty: str | None):
        super().__init__()
        self.empty, self.known = empty, None

    def add(self, row: tuple) -> None:
        name, up, place, label, multi, kind, form, canon, out, tag = row
        box = kind in ("container", "list")
        text = None if box else canon if form in ("opaque", "number", "boolean") else "null" if form == "null" else "" if canon is None else _json_quoted(canon)
        if name == "/" and text is not None:
            self.known = text if self.known is None else max(self.known, text)
        if out:
            return
        node = [label, multi, tag, text, []]
        home = self.parent(place, up)
        if home is not None:
            (home if home is self.top else home[4]).append(node)
        if text is None:
            node[3] = self.empty if kind == "container" else "{}"
            self.open.append((place, name, node))

    def close(self, node: list) -> None:
        inner = self.inside(node[4])
        node[3:] = [node[3] if inner is None else inner, []]

    def inside(self, nodes: list) -> str | None:
        same: dict[tuple, list] = {}
        for label, multi, tag, text, _ in nodes:
            if text is not None:
                same.setdefault((label, multi), []).append((text, tag))
        members = []
        for (label, multi), each in same.items():
            one = ",".join([t for t, _ in each])
            members.append(f"{_json_quoted(label)}:[{one}]" if multi else f"{_json_quoted(label)}:{one}")
            if not multi and any(tag for _, tag in each):
                members.append(f'{_json_quoted("@" + label)}:{{"ietf-netconf-with-defaults:default":true}}')
        return f"{{{','.join(members)}}}" if members else None

    def end(self) -> list[tuple]:
        self.rest()
        # A text that was no object stands for itself.
        return [(self.known if self.known is not None else self.inside(self.top) or "{}",)]


def print_json(nodes: DataFrame, mode: str = "explicit", depth: int | None = None) -> DataFrame:
    """(tree_id, document) of each tree of a node table as ``shred_json`` gives it.

    ``mode`` decides on leaves with the columns implicit (taken from the schema, not set) and default (the schema's
    value) if the table has them: explicit leaves out implicit ones, trim those equal to their default, report-all
    nothing; report-all-tagged and implicit-tagged annotate equal and implicit ones. A state leaf (column state) that
    equals its default stays in trim. Containers that end up without members are left out unless all is reported.
    """
    implicit = F.coalesce(F.col("implicit"), F.lit(False)) if "implicit" in nodes.columns else F.lit(False)
    equal = F.coalesce(F.col("canon") == F.col("default"), F.lit(False)) if "default" in nodes.columns else F.lit(False)
    state = F.coalesce(F.col("state"), F.lit(False)) if "state" in nodes.columns else F.lit(False)
    modes = {"explicit": (~implicit, F.lit(False)), "trim": (~equal | state, F.lit(False)), "report-all": (F.lit(True), F.lit(False)), "report-all-tagged": (F.lit(True), equal), "implicit-tagged": (F.lit(True), implicit)}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode}")
    shown, tagged = modes[mode]
    leaf = F.col("kind") == "leaf"
    deeper = F.lit(False) if depth is None else F.size("anc_ids") > depth
    # A leaf that is left out keeps its row, so that its tree is still known.
    rows = nodes.select("tree_id", "node_id", "parent_id", _place(), "label", "multi", "kind", "type", "canon", ((leaf & ~shown) | deeper).alias("_out"), (leaf & tagged).alias("_tag"))
    empty = "{}" if mode.startswith("report-all") else None
    return streamed(rows, ["tree_id"], ["_place", "node_id"], lambda: _JsonFold(empty), "document string")


def _xml_text(value: str, quote: bool = False) -> str:
    out = value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;") if quote else out


class _XmlFold(_Fold):
    """Nodes as lists of name, module, attributes, text and children's texts."""

    def add(self, row: tuple) -> None:
        name, up, place, label, kind, canon, module = row
        home = self.parent(place, up)
        if kind == "annotation":
            if home is not None and home is not self.top and canon is not None:
                home[2] += f' {label[1:]}="{_xml_text(canon, True)}"'
            return
        if kind == "opaque":
            node = [None, None, "", canon or "", []]
        else:
            above = home[1] if home is not None and home is not self.top else None
            space = f' xmlns="{_xml_text(module, True)}"' if module is not None and module != above else ""
            node = [label, module, space, _xml_text(canon or ""), []]
            self.open.append((place, name, node))
        if home is not None:
            (home if home is self.top else home[4]).append(node)

    def close(self, node: list) -> None:
        label, _, notes, text, below = node
        node[:] = [None, None, "", f"<{label}{notes}>{''.join([x[3] for x in below]) if below else text}</{label}>", []]

    def end(self) -> list[tuple]:
        self.rest()
        return [("".join([x[3] for x in self.top]),)] if self.top else []


def print_xml(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(tree_id, document) of each tree of a node table as ``shred_xml`` gives it: elements in document order, annotations
    as attributes, a namespace where it differs from the parent's, opaque nodes as they were. One shuffle, as in
    ``print_json``; a tree of several roots prints one after the other."""
    rows = nodes if depth is None else nodes.where((F.size("anc_ids") <= depth) | (F.col("kind") == "annotation"))
    rows = rows.select("tree_id", "node_id", "parent_id", _place(), "name", "kind", "canon", "module")
    return streamed(rows, ["tree_id"], ["_place", "node_id"], _XmlFold, "document string")
