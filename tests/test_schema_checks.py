"""Whole trees against schema tables, and what paths and expressions touch, against plain loops."""

import itertools
import json
import random

from pyspark.sql import functions as F

from sylva.operators import diagnostics as G
from sylva.operators import schema_paths as A
from sylva.sources import documents as C

N = G.SchemaNode
SCHEMA = [
    N("/box", "container"), N("/box/id", mandatory=True), N("/box/note", status="obsolete"), N("/box/seen", config=False),
    N("/box/item", "list", keys=["k"], min_elements=1, max_elements=3), N("/box/item/k"), N("/box/item/v", default="5"), N("/box/item/w"),
    N("/box/how", "choice", mandatory=True), N("/box/fast", choice="how", case="a"), N("/box/slow", choice="how", case="b"),
]
SHAPE = C.Shape({"/box/item": ["k"]})


def _trees(rng, n):
    out = []
    for i in range(n):
        box = {}
        for name in ("id", "note", "seen", "fast", "slow", "odd"):
            if rng.random() < 0.5:
                box[name] = "x"
        items = []
        for k in range(rng.randint(0, 5)):
            item = {} if rng.random() < 0.1 else {"k": str(k)}
            if rng.random() < 0.6:
                item["v"] = str(rng.choice([4, 5]))
            if rng.random() < 0.8:
                item["w"] = str(rng.choice([1, 2]))
            if item:
                items.append(item)
        if items:
            box["item"] = items
        out.append((str(i), {"box": box}))
    return out


def _slow(tree, doc, state):
    box = doc["box"]
    items = box.get("item", [])
    out = []
    for name in box:
        if name == "odd":
            out.append(("unknown", "/box/odd", 'Node "odd" not found as a child of "box" node.'))
    names = [f"/box/item[k='{x['k']}']" if "k" in x else f"/box/item[{i + 1}]" for i, x in enumerate(items)]
    out += [("key", n, 'List instance is missing its key "k".') for n, x in zip(names, items) if "k" not in x]
    if "fast" in box and "slow" in box:
        out.append(("case", "/box", 'Data for both cases "a" and "b" exist.'))
    if "seen" in box and not state:
        out.append(("unexpected", "/box/seen", 'Unexpected data state node "seen" found.'))
    if "id" not in box:
        out.append(("mandatory", "/box", 'Mandatory node "id" instance does not exist.'))
    if "fast" not in box and "slow" not in box:
        out.append(("mandatory", "/box", 'Mandatory choice "how" data do not exist.'))
    if not items:
        out.append(("elements", "/box", 'Too few "item" instances.'))
    if len(items) > 3:
        out.append(("elements", "/box", 'Too many "item" instances.'))
    value = lambda x: (x.get("v", "5"), x.get("w"))
    given = lambda x: "v" in x and "w" in x
    told = lambda a, b: ("unique", names[b], f'Unique data leaf(s) "v w" not satisfied in "{names[a]}" and "{names[b]}".')
    for a, b in itertools.combinations(range(len(items)), 2):
        if value(items[a]) != value(items[b]) or value(items[a])[1] is None:
            continue
        if len(items) == 2 and given(items[0]):
            out.append(told(0, 1))
        if len(items) > 2 and given(items[b]) and all(value(items[j]) != value(items[b]) for j in range(a)):
            out.append(told(b, a))
    if "note" in box:
        out.append(("obsolete", "/box/note", 'Obsolete schema node "note" instantiated in data.'))
    return [(tree, *x) for x in out]


def test_trees_are_checked_as_by_loops(spark):
    trees = _trees(random.Random(4), 120)
    docs = spark.createDataFrame([(t, json.dumps(d)) for t, d in trees], "t string, d string").repartition(3)
    nodes = C.shred_json(docs, F.col("t"), "d", SHAPE).cache()
    schema = G.schema_table(spark, SCHEMA)
    uniques = [("/box/item", ["v", "w"])]
    for state in (True, False):
        got = G.validate(nodes, schema, uniques, state=state).collect()
        want = [x for t, d in trees for x in _slow(t, d, state)]
        assert sorted((r.tree_id, r.phase, r.path, r.message) for r in got) == sorted(want)
    final = G.validate(nodes, schema, uniques, phases=G.FINAL, state=False, operational=True).collect()
    assert {r.phase for r in final} == set(G.FINAL)
    assert all((r.severity == "warning") == (r.phase != "unexpected") for r in final)
    assert {(r.phase, r.app_tag) for r in final if r.app_tag} == {("mandatory", "missing-choice"), ("elements", "too-few-elements"), ("elements", "too-many-elements"), ("unique", "data-not-unique")}
    ordered = [G.PHASES.index(r.phase) for r in G.in_order(G.validate(nodes, schema)).collect()]
    assert ordered == sorted(ordered)


def test_doubles_modules_and_empty_trees(spark):
    schema = G.schema_table(spark, [N("/a", module="m", mandatory=True), N("/b", module="n", mandatory=True), N("/s", "leaf-list", config=False)])
    docs = spark.createDataFrame([("1", '{"a":"x"}'), ("1", '{"a":"x","s":["q","q"]}'), ("2", None), ("3", "{}")], "t string, d string")
    nodes = C.shred_json(docs, F.col("t"), "d")
    rows = {(r.tree_id, r.phase, r.message) for r in G.validate(nodes, schema).collect()}
    assert rows == {("1", "duplicate", 'Duplicate instance of "a".'), ("1", "mandatory", 'Mandatory node "b" instance does not exist.')}
    assert [r.phase for r in G.validate(nodes, schema, module="m").collect()] == ["duplicate"]
    assert G.validate(nodes.limit(0), schema).count() == 0


def test_path_atoms(spark):
    schema = spark.createDataFrame([(p,) for p in ("/s", "/s/server", "/s/server/name", "/s/server/port", "/s/tag")], "path string")
    paths = spark.createDataFrame([(1, "/s/server[name='a/b'']x']/port"), (2, "/s/tag[.='/no[x']"), (3, "/s/nope/deep"), (4, None), (5, "/s/server[3]"), (6, "/other")], "id long, p string")
    atoms, faults = A.path_atoms(paths, "p", schema)
    got = {}
    for r in atoms.collect():
        got.setdefault(r.id, set()).add(r.atom)
    assert got == {1: {"/s", "/s/server", "/s/server/name", "/s/server/port"}, 2: {"/s", "/s/tag"}, 3: {"/s"}, 5: {"/s", "/s/server"}}
    assert {(r.id, r.message) for r in faults.collect()} == {(3, 'Schema node "nope" for parent "/s" not found.'), (6, 'Schema node "other" for parent "/" not found.')}


def test_expression_atoms_equal_a_walk(spark):
    paths = ["/s", "/s/server", "/s/server/name", "/s/server/port", "/s/tag", "/t", "/t/name"]
    schema = spark.createDataFrame([(p,) for p in paths], "path string")
    up = lambda p: p.rsplit("/", 1)[0]
    reach = {
        "child": lambda p, q: q and up(q) == p, "parent": lambda p, q: p and up(p) == q, "self": lambda p, q: p == q,
        "descendant": lambda p, q: q.startswith(p + "/"), "descendant-or-self": lambda p, q: p == q or q.startswith(p + "/"),
        "ancestor": lambda p, q: p.startswith(q + "/"), "ancestor-or-self": lambda p, q: p == q or p.startswith(q + "/"),
        "following-sibling": lambda p, q: p and q and up(p) == up(q),
    }
    rng = random.Random(8)
    steps = []
    for e in range(60):
        for i in range(rng.randint(1, 4)):
            steps.append((e, i, rng.randrange(i) if i else None, rng.choice(list(reach)), rng.choice(["name", "server", "*", "node()", "nope"]), rng.choice([None, "/s/server"]) if not i else None))
    want, lost = set(), set()
    ends = {}
    for e, i, after, axis, test, start in steps:
        begin = {start or ""} if after is None else ends[e, after]
        fits = lambda q: test == "node()" or q and test in ("*", q.rsplit("/", 1)[1])
        ends[e, i] = {q for p in begin for q in ["", *paths] if reach[axis](p, q) and fits(q)}
        want |= {(e, i, q) for q in ends[e, i] if q}
        if begin and not ends[e, i]:
            lost.add((e, i))
    table = spark.createDataFrame(steps, "expr_id long, step int, after int, axis string, test string, start string")
    atoms, faults = A.expression_atoms(table, schema)
    assert {tuple(r) for r in atoms.collect()} == want
    assert {(r.expr_id, r.step) for r in faults.collect()} == lost
