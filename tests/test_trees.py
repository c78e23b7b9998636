"""Documents, intervals, moves, conditions, two contexts, pruned differences and folds against slow ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sylva.operators import contexts as N
from sylva.operators import diff as D
from sylva.operators import fixpoint as P
from sylva.operators import intervals as I
from sylva.operators import moves as M
from sylva.operators import tree as R
from sylva.operators import treediff as T
from sylva.sources import documents as C


def rows_of(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


DOC = {
    "m:a": {
        "l": [{"k": "q]", "j": 2, "v": "9007199254740993", "deep": {"x": {"y": True}}}, {"k": "it's", "j": 3}],
        "tag": ["u", "v", "v"], "n": None, "num": 1.5, "any": {"z": [1, {"b": 2}]}, "e": {}, "@tag": [{"o": "x"}],
    },
    "text": 'a "quoted" {brace} \\ \n é',
}
SHAPE = C.Shape({"/a/l": ["k", "j"]}, {"/a/any"})


def walk(value, path, label, ids, shape):
    """Paths and values of a parsed document, the slow way."""
    for key, x in value.items():
        name = key if key.startswith("@") else key.split(":")[-1]
        at, here = f"{path}/{name}", f"{ids}/{name}"
        if key.startswith("@") or at in shape.text:
            yield here, json.dumps(x, separators=(",", ":"), ensure_ascii=False)
        elif isinstance(x, list):
            for i, e in enumerate(x):
                if isinstance(e, dict):
                    keys = shape.lists.get(at)
                    step = "".join("[%s='%s']" % (k, str(e[k]).replace("'", "''")) for k in keys) if keys else f"[{i + 1}]"
                    yield here + step, None
                    yield from walk(e, at, key, here + step, shape)
                else:
                    yield here + (f"[.='{e}']" if len(set(x)) == len(x) else f"[{i + 1}]"), str(e)
        elif isinstance(x, dict):
            yield here, None
            yield from walk(x, at, key, here, shape)
        else:
            yield here, None if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def test_json_documents_become_nodes(spark):
    docs = spark.createDataFrame([(1, json.dumps(DOC)), (2, "bad{"), (3, None), (4, '{"p":123456789012345678901}'), (5, "[1]"), (6, "{}")], "id int, t string")
    nodes = C.shred_json(docs, F.col("id"), "t", SHAPE)
    assert rows_of(nodes.where("tree_id = '1'"), "node_id", "canon") == sorted(map(repr, walk(DOC, "", "", "", SHAPE)))
    got = {(r.tree_id, r.node_id): r for r in nodes.collect()}
    assert got["2", "/"].canon == "bad{" and got["5", "/"].kind == "opaque" and got["4", "/p"].canon == "123456789012345678901"
    assert got["1", "/a/l[k='it''s'][j='3']"].module == "m" and got["1", "/a/l[k='q]'][j='2']/deep/x"].anc_ids == ["/a", "/a/l[k='q]'][j='2']", "/a/l[k='q]'][j='2']/deep"]
    printed = C.print_json(nodes, "report-all")
    assert json.loads(printed.where("tree_id = '1'").first().document) == DOC
    again = C.shred_json(printed, F.col("tree_id"), "document", SHAPE)
    assert rows_of(again, *nodes.columns) == rows_of(nodes, *nodes.columns)
    assert C.shred_json(docs.limit(0), F.col("id"), "t", SHAPE).count() == 0


def test_unknown_nodes_at_any_depth(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":{"c":1,"d":{"e":2}},"f":3}}')], "id int, t string")
    known = {"/a", "/a/b", "/a/b/c"}
    ids = lambda policy: {r.node_id: (r.kind, r.canon) for r in C.shred_json(docs, F.col("id"), "t", C.Shape(known=known, unknown=policy)).collect()}
    assert set(ids("skip")) == known
    assert ids("opaque")["/a/b/d"] == ("opaque", '{"e":2}') and "/a/b/d/e" not in ids("opaque") and ids("opaque")["/a/f"] == ("opaque", "3")
    with pytest.raises(Exception, match="unknown node /a/b/d"):
        ids("reject")


def test_xml_documents_become_nodes(spark):
    text = '<r xmlns="urn:r" xmlns:p="urn:p" a="1"><l><k>x\'y</k><v>01</v></l><l><k>z</k></l><t>1.50</t><t>2</t><p:o><i/></p:o><x><b>1</b></x></r>'
    docs = spark.createDataFrame([(1, text), (2, "<bad"), (3, None)], "id int, t string")
    got = {(r.tree_id, r.node_id): r for r in C.shred_xml(docs, F.col("id"), "t", C.Shape({"/r/l": ["k"]}, {"/r/x"})).collect()}
    assert {k[1] for k in got if k[0] == "1"} == {"/r", "/r/@a", "/r/l[k='x''y']", "/r/l[k='x''y']/k", "/r/l[k='x''y']/v", "/r/l[k='z']", "/r/l[k='z']/k", "/r/t[.='1.50']", "/r/t[.='2']", "/r/o", "/r/o/i", "/r/x"}
    assert got["1", "/r/l[k='x''y']/v"].canon == "01" and got["1", "/r/o"].module == "urn:p" and got["1", "/r/l[k='z']"].module == "urn:r"
    assert got["1", "/r/x"].kind == "opaque" and "<b" in got["1", "/r/x"].canon.replace("ns0:", "") and got["2", "/"].canon == "<bad"


def test_with_defaults_of_whole_trees(spark):
    docs = spark.createDataFrame([(1, '{"a":{"x":1,"y":2,"z":3,"s":4},"b":{"w":1}}')], "id int, t string")
    nodes = C.shred_json(docs, F.col("id"), "t")
    facts = spark.createDataFrame([("/a/x", "1", False, False), ("/a/y", "2", True, False), ("/a/z", "9", False, False), ("/a/s", "4", False, True), ("/b/w", "1", True, False)], "node_id string, default string, implicit boolean, state boolean")
    full = nodes.join(facts, "node_id", "left")
    shown = {m: json.loads(C.print_json(full, m).first().document) for m in ("explicit", "trim", "report-all", "report-all-tagged", "implicit-tagged")}
    tag = {"ietf-netconf-with-defaults:default": True}
    assert shown["explicit"] == {"a": {"x": 1, "z": 3, "s": 4}} and shown["trim"] == {"a": {"z": 3, "s": 4}}
    assert shown["report-all"] == {"a": {"x": 1, "y": 2, "z": 3, "s": 4}, "b": {"w": 1}}
    assert shown["report-all-tagged"] == {"a": {"x": 1, "@x": tag, "y": 2, "@y": tag, "z": 3, "s": 4, "@s": tag}, "b": {"w": 1, "@w": tag}}
    assert shown["implicit-tagged"] == {"a": {"x": 1, "y": 2, "@y": tag, "z": 3, "s": 4}, "b": {"w": 1, "@w": tag}}


def some_trees(spark, seed=1, trees=2, size=60):
    rng = random.Random(seed)
    rows = []
    for t in range(trees):
        ids = [("", [], [])]
        for i in range(size):
            up, anc, key = rng.choice(ids)
            here = f"{up}/n{i}"
            rows.append((f"t{t}", here, up or None, anc, [*key, f"{i:03d}"], rng.choice("ab"), "list", str(rng.randrange(3))))
            ids.append((here, [*anc, here], [*key, f"{i:03d}"]))
    return rows, spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, anc_ids array<string>, doc_key array<string>, name string, kind string, canon string").repartition(5)


def test_intervals_equal_the_axes(spark):
    rows, nodes = some_trees(spark)
    labelled = I.label(nodes)
    got = {(r.tree_id, r.node_id): r for r in I.axis_counts(labelled, labelled, "a").collect()}
    first = {(r.tree_id, r.node_id): r.found for r in I.nearest(labelled, labelled, "a").collect()}
    last = {(r.tree_id, r.node_id): r.found for r in I.nearest(labelled, labelled, "b", after=False).collect()}
    order = {t: sorted((r for r in rows if r[0] == t), key=lambda r: r[4]) for t in ("t0", "t1")}
    for t, own in order.items():
        for i, r in enumerate(own):
            inside = [x for x in own if r[1] in x[3]]
            after = [x for x in own[i + 1 :] if x not in inside]
            n = got[t, r[1]]
            assert (n.descendants, n.following, n.preceding) == tuple(sum(x[5] == "a" for x in s) for s in (inside, after, own[:i]))
            assert first.get((t, r[1])) == next((x[1] for x in after if x[5] == "a"), None)
            done = [x for x in own[:i] if x[1] not in r[3] and x[5] == "b"]
            assert ((t, r[1]) in last) == bool(done) and (not done or last[t, r[1]] in {x[1] for x in done})
    some = labelled.where("canon = '1'")
    want = {(r[0], r[1]) for r in rows if any(x[0] == r[0] and x[7] == "1" and x[1] in [*r[3], r[1]] for x in rows)}
    assert {(r.tree_id, r.node_id) for r in I.within(some, labelled).collect()} == want


def longest_rising(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = max([1, *[best[j] + 1 for j in range(i) if values[j] < values[i]]])
    return max(best, default=0)


def test_moves_are_the_fewest_and_replay(spark):
    rng = random.Random(2)
    a, b, fewest = [], [], {}
    for g in range(40):
        old = [f"k{i}" for i in rng.sample(range(50), rng.randint(0, 25))]
        new = [k for k in old if rng.random() < 0.8] + [f"n{i}" for i in range(rng.randint(0, 3))]
        if g % 3:
            rng.shuffle(new)
        else:
            new = new[len(new) // 2 :] + new[: len(new) // 2]
        a += [(g, k, i) for i, k in enumerate(old)]
        b += [(g, k, i) for i, k in enumerate(new)]
        fewest[g] = len([k for k in new if k in old]) - longest_rising([old.index(k) for k in new if k in old])
    first, second = (spark.createDataFrame(x, "g int, k string, pos int") for x in (a, b))
    moves = M.minimal_moves(first, second, ["g"], "k", "pos").cache()
    count = {g: 0 for g in fewest} | {r.g: r.n for r in moves.where("op = 'move'").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count == fewest
    got = {}
    for r in M.replay(first, moves, ["g"], "k", "pos").orderBy("g", "pos").collect():
        got.setdefault(r.g, []).append((r.pos, r.k))
    want = {}
    for g, k, _ in b:
        want.setdefault(g, []).append((len(want.get(g, [])) + 1, k))
    assert got == want


def test_moves_see_what_earlier_ones_left(spark):
    rows = spark.createDataFrame([(1, k, i) for i, k in enumerate("abcdefgh")], "g int, k string, pos int")
    steps = [(1, 1, "move", "c", None), (1, 2, "move", "a", "h"), (1, 3, "create", "x", "a"), (1, 4, "move", "h", "x"), (1, 5, "delete", "b", None)]
    moves = spark.createDataFrame(steps, "g int, seq int, op string, k string, anchor string")
    assert [r.k for r in M.replay(rows, moves, ["g"], "k", "pos").orderBy("pos").collect()] == list("cdefgaxh")
    for bad in ((1, 1, "move", "z", None), (1, 1, "create", "a", None), (1, 1, "move", "a", "z"), (1, 1, "move", "a", "a")):
        with pytest.raises(Exception, match="cannot"):
            M.replay(rows, spark.createDataFrame([bad], moves.schema), ["g"], "k", "pos").collect()


def leaf_is(leaf, value):
    return lambda ctx, nodes: R.where_exists(ctx, R.child(ctx.select("ctx_id", *R.COLUMNS), nodes, leaf).where(F.col("canon") == value))


def test_whens_go_to_a_fixed_point(spark):
    def tree(t, names):
        out = [(t, f"/{t}", None, [], ["0"], "top", "container", None)]
        for i, (n, v) in enumerate(names):
            out.append((t, f"/{t}/{n}", f"/{t}", [f"/{t}"], ["0", str(i)], n, "leaf", v))
        return out

    rows = tree("x", [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")]) + tree("y", [("a", "0"), ("b", "1"), ("c", "1"), ("d", "1")]) + tree("z", [("b", "1"), ("p", "1"), ("q", "1")])
    nodes = spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, anc_ids array<string>, doc_key array<string>, name string, kind string, canon string")

    def sibling(name, value=None):
        def holds(ctx, left):
            there = left.where((F.col("name") == name) & (F.lit(value is None) | (F.col("canon") == value))).select("tree_id", "parent_id").distinct()
            return ctx.join(there, ["tree_id", "parent_id"], "left_semi")

        return holds

    # d needs c, c needs b, b needs a = 1; given the other way round. p and q need each other.
    rules = [P.When("d", sibling("c"), ("c",)), P.When("c", sibling("b"), ("b",)), P.When("b", sibling("a", "1"), ("a",)), P.When("p", sibling("q"), ("q",)), P.When("q", sibling("p"), ("p",))]
    stay, gone, circles = P.settle_whens(nodes, rules)
    assert {r.node_id for r in stay.collect()} == {"/x", "/x/a", "/x/b", "/x/c", "/x/d", "/y", "/y/a", "/z", "/z/p", "/z/q"}
    order = {r.node_id: r["round"] for r in gone.collect()}
    assert order["/y/b"] < order["/y/c"] < order["/y/d"] and "/z/b" in order and circles == [["p", "q"]]
    without = nodes.where("node_id <> '/z/p'")
    assert "/z/q" not in {r.node_id for r in P.settle_whens(without, rules)[0].collect()}
    assert P.settle_whens(nodes, [])[0].count() == nodes.count() and [[r.name for r in x] for x in P.layers(rules)][-1] != ["b"]


def test_predicates_with_two_contexts(spark):
    ifaces = spark.createDataFrame([("t1", "eth0", "up", "10"), ("t1", "eth1", "down", "20"), ("t2", "eth0", "up", "99")], "tree string, name string, state string, mtu string")
    uses = spark.createDataFrame([("t1", "1", "eth0", "10"), ("t1", "2", "eth1", "10"), ("t1", "3", None, "10"), ("t2", "1", "eth0", "10")], "tree string, id string, iface string, mtu string")
    nodes = R.shred(ifaces, F.col("tree"), [("iface", "name")], ["name", "state", "mtu"]).unionByName(R.shred(uses, F.col("tree"), [("use", "id")], ["id", "iface", "mtu"]))
    refs = R.context(nodes, (F.col("name") == "mtu") & F.col("parent_id").startswith("/use"))
    bad = N.keyed_leafref(refs, nodes, "iface", [("name", "../iface")], "mtu").collect()
    assert {r.path for r in bad} == {"/use[2]/mtu", "/use[3]/mtu", "/use[1]/mtu"} and len(bad) == 3
    found = N.matching(refs, nodes, "iface", [("name", "../iface")])
    assert {(r.tree_id, r.ctx_id, r.node_id) for r in found.collect()} == {("t1", "/use[1]/mtu", "/iface[eth0]"), ("t1", "/use[2]/mtu", "/iface[eth1]"), ("t2", "/use[1]/mtu", "/iface[eth0]")}
    assert {(r.tree_id, r.ctx_id, r.canon) for r in N.current(found, nodes).collect()} == {("t1", "/use[1]/mtu", "10"), ("t1", "/use[2]/mtu", "10"), ("t2", "/use[1]/mtu", "10")}
    assert [(r.tree_id, r.node_id) for r in N.deref(refs, nodes, "iface", [("name", "../iface")], "mtu").collect()] == [("t1", "/iface[eth0]/mtu")]


def test_pruned_diff_opens_only_what_differs(spark):
    rows, nodes = some_trees(spark, 5, 3, 80)
    rng = random.Random(6)
    gone = {(r[0], r[1]) for r in rng.sample(rows, 3)}
    new = [(t, n, p, a, k, name, kind, "changed" if rng.random() < 0.02 else c) for t, n, p, a, k, name, kind, c in rows if not any((t, x) in gone for x in [*a, n])]
    new.append(("t0", "/new", None, [], ["999"], "a", "list", "1"))
    new.append(("t0", "/new/x", "/new", ["/new"], ["999", "0"], "a", "list", "1"))
    other = spark.createDataFrame(new, nodes.schema)
    a, b = T.fingerprints(nodes), T.fingerprints(other)
    seen: list[int] = []
    changes = T.diff_trees(a, b, seen)
    got = {(r.tree_id, r.node_id): r.op for r in changes.collect()}
    old_ids, new_ids = {(r[0], r[1]): r for r in rows}, {(r[0], r[1]): r for r in new}
    want = {k: "replace" for k in old_ids.keys() & new_ids.keys() if old_ids[k][7] != new_ids[k][7]}
    want |= {k: "delete" for k, r in old_ids.items() if k not in new_ids and (r[2] is None or (r[0], r[2]) in new_ids)}
    want |= {k: "create" for k, r in new_ids.items() if k not in old_ids and (r[2] is None or (r[0], r[2]) in old_ids)}
    assert got == want and sum(seen) < len(rows) / 2
    assert rows_of(T.apply_tree_diff(nodes, changes, other), *R.COLUMNS) == rows_of(other, *R.COLUMNS)
    assert T.diff_trees(a, a).count() == 0


def test_fold_equals_steps(spark):
    rng = random.Random(7)
    state = {k: rng.randrange(3) for k in range(30)}
    base = spark.createDataFrame(list(state.items()), "k int, v int")
    log = []
    for seq in range(20):
        for k in rng.sample(range(40), 12):
            old = state.get(k)
            op = "create" if k not in state else rng.choice(["delete", "replace", "none"])
            new = rng.choice([None, *range(3)]) if op in ("create", "replace") else None if op == "delete" else old
            log.append((k, op, new, old, seq))
            if op == "delete":
                del state[k]
            elif op != "none":
                state[k] = new
    df = spark.createDataFrame(log, "k int, op string, v int, orig_v int, seq int")
    one = T.fold_diffs(df, ["k"], ["v"])
    assert {r.k: r.v for r in D.apply_diff(base, one, ["k"], ["v"]).collect()} == state
    assert one.where("op = 'replace' AND v <=> orig_v").count() == 0
    bad = spark.createDataFrame([(1, "create", 1, None, 0), (1, "create", 2, None, 1), (2, "delete", None, 1, 0), (2, "replace", 2, 1, 1)], df.schema)
    assert {r.k: r.op for r in T.fold_diffs(bad, ["k"], ["v"]).collect()} == {1: "error", 2: "error"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_keys_in_paths_are_told_apart(spark):
    rows = spark.createDataFrame([("a", "x]/k[1"), ("a", "plain 1"), ("a'b", "y")], "p string, k string")
    ids = {r.node_id for r in R.shred(rows, F.lit("t"), [("p", "p"), ("k", "k")], []).collect()}
    assert ids == {"/p[a]/k['x]/k[1']", "/p[a]/k[plain 1]", "/p['a''b']/k[y]"}


def test_numbers_and_instants_as_written(spark):
    from sylva.functions import types as Y
    from sylva.functions import xpath as X

    nan, inf = float("nan"), float("inf")
    cases = {"1d": nan, "0x1F": 31.0, "-0x1.8p1": -3.0, " 12": 12.0, "12 ": nan, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "": nan, "+7": 7.0, "inf": inf, "-Infinity": -inf, "1e999": nan, "0x": nan, "1_0": nan, "\t3": 3.0}
    got = {r.s: r.n for r in spark.createDataFrame([(k,) for k in cases], "s string").select("s", X.number(F.col("s")).alias("n")).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in cases.items()}
    stamps = {
        "2024-01-01T12:00:00+02:00": "2024-01-01T10:00:00+00:00", "2024-01-01T00:30:00.250+01:00": "2023-12-31T23:30:00.250+00:00", "2024-02-29T00:00:00Z": "2024-02-29T00:00:00+00:00", "2024-01-01T12:00:00-00:00": "2024-01-01T12:00:00-00:00",
        "2024-01-01T00:00:00+99:99": None, "2023-02-29T00:00:00Z": None, "2024-12-31T23:59:60Z": "2025-01-01T00:00:00+00:00", "2024-01-01T12:00:00-03:30": "2024-01-01T15:30:00+00:00", "2024-01-01 12:00:00Z": None, "2024-01-01T24:00:00Z": None,
    }
    got = {r.s: r.c for r in spark.createDataFrame([(k,) for k in stamps], "s string").select("s", Y.store_date_and_time(F.col("s"))["canon"].alias("c")).collect()}
    assert got == stamps
    assert spark.range(1).select(Y.store_date_and_time(F.lit("2024-01-01T12:00:00Z"), z_is_unknown=True)["canon"]).first()[0] == "2024-01-01T12:00:00Z"
    low, high = (Y.sort_key(F.lit(x), "enumeration", {"up": 5, "down": -3}) for x in ("down", "up"))
    assert spark.range(1).select(low < high, Y.sort_key(F.lit("9.0.0.1"), "ipv4-address") < Y.sort_key(F.lit("10.0.0.1"), "ipv4-address")).first()[:] == (True, True)


def test_other_trees_hold_no_instances(spark):
    from sylva.operators import validate as V

    nodes = spark.createDataFrame([("t1", "/a"), ("t2", "/b")], "tree_id string, node_id string")
    refs = spark.createDataFrame([("t1", "1", "/a"), ("t1", "2", "/b"), ("t2", "3", "/b")], "tree_id string, k string, at string")
    assert [r.path for r in V.instance_required(refs, "r", ["k"], "at", nodes).collect()] == ["/r[k='2']"]
    assert [r.path for r in V.leafref(refs, "r", ["k"], "at", nodes, "node_id", ["tree_id"]).collect()] == ["/r[k='2']"]
    assert R.find(nodes.withColumns({c: F.lit("") for c in R.COLUMNS if c not in nodes.columns}), "/b", "t1").count() == 0


def test_flags_go_up_and_stop_at_what_was_set(spark):
    from sylva.operators import defaults as H

    docs = spark.createDataFrame([(1, '{"a":{"b":{"x":1}}}'), (2, '{"a":{}}'), (3, '{"l":[{"k":"1"}]}')], "id int, t string")
    nodes = H.implied(C.shred_json(docs, F.col("id"), "t", C.Shape({"/l": ["k"]})), ["/a", "/a/b", "/a/b/c"], {"/a/b/x": "0", "/a/b/c/y": "9", "/l/z": "7"})
    got = {(r.tree_id, r.node_id): (r.implicit, r.default) for r in H.container_flags(nodes).collect()}
    assert got["1", "/a"] == (False, False) and got["1", "/a/b"] == (False, False) and got["1", "/a/b/c"] == (True, True) and got["1", "/a/b/c/y"] == (True, True) and got["1", "/a/b/x"] == (False, False)
    assert got["2", "/a"] == (False, True) and got["2", "/a/b/x"] == (True, True) and got["3", "/a/b/c"] == (True, True) and got["3", "/l[k='1']/z"] == (True, True) and got["3", "/l[k='1']"] == (False, False)
    assert H.container_flags(nodes, ["/a/b/c"]).where("tree_id = '2' AND node_id = '/a'").first().default is False


def test_streams_keep_state_by_key(spark, tmp_path):
    from sylva.streaming import changelog as S

    schema = "k int, op string, v int, seq int"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        S.keep_updates(stream, ["k"], ["v"], "seq", out, check).awaitTermination(120)

    def state():
        return {r.k: r.v for r in S.kept(spark, out, ["k"], ["v"], "seq").collect()}

    feed([(k, "create", k, 1) for k in range(50)])
    assert state() == {k: k for k in range(50)}
    feed([(3, "replace", 33, 5), (4, "delete", None, 5)])  # another query from the same checkpoint: a restart
    feed([(3, "replace", 7, 2), (4, "replace", 8, 3), (5, "replace", 55, 3)])  # older than what is known of 3 and 4
    assert state() == {k: k for k in range(50) if k not in (3, 4, 5)} | {3: 33, 5: 55}
    assert [spark.read.parquet(f"{out}/batch-{i}").count() for i in range(3)] == [50, 2, 3]


def test_replies_in_streams_meet_their_requests(spark, tmp_path):
    from sylva.streaming import changelog as S

    schema = "id string, ts timestamp, what string"
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    asked = [("a", at(0), "get"), ("b", at(1), "get"), ("c", at(2), "get"), ("z", at(59), "get")]
    given = [("a", at(3), "ok"), ("b", at(30), "late"), ("x", at(2), "none"), ("z", at(59), "ok")]
    frames = []
    for name, rows in (("q", asked), ("r", given)):
        spark.createDataFrame([(i, t, w) for i, t, w in rows], "id string, ts string, what string").select("id", F.col("ts").cast("timestamp").alias("ts"), "what").write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    want = {("a", "ok"), ("b", None), ("c", None), ("z", "ok")}
    assert {(r.id, r.answer_what) for r in S.replies(*frames, "id", "ts").collect()} == want
    streams = [spark.readStream.schema(schema).parquet(str(tmp_path / x)) for x in ("q", "r")]
    got: list = []
    query = S.replies(*streams, "id", "ts").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    query.awaitTermination(120)
    assert {(r.id, r.answer_what) for r in got} == want


def test_xml_goes_there_and_back(spark):
    text = '<r xmlns="urn:r" xmlns:p="urn:p" a="1 &lt; &quot;2&quot;"><l><k>x\'y &amp; z</k><v>01</v></l><l><k>z</k></l><t>1.50</t><t>2</t><p:o><i/></p:o></r>'
    docs = spark.createDataFrame([(1, text), (2, "<bad"), (3, None), (4, "<e/>")], "id int, t string")
    shape = C.Shape({"/r/l": ["k"]})
    nodes = C.shred_xml(docs, F.col("id"), "t", shape)
    printed = C.print_xml(nodes)
    got = {r.tree_id: r.document for r in printed.collect()}
    assert set(got) == {"1", "2", "4"} and got["2"] == "<bad" and got["4"] == "<e></e>"
    assert rows_of(C.shred_xml(printed, F.col("tree_id"), "document", shape), *nodes.columns) == rows_of(nodes, *nodes.columns)
    assert C.print_xml(nodes.limit(0)).count() == 0


def test_ipv6_forms_and_order(spark):
    import ipaddress

    from sylva.functions import inet6 as V
    from sylva.functions import types as Y

    rng = random.Random(9)
    texts = []
    for _ in range(300):
        g = [rng.choice([0, 0, 0, 1, 0xFFFF, rng.randrange(65536)]) for _ in range(8)]
        a = ipaddress.IPv6Address(b"".join(x.to_bytes(2, "big") for x in g))
        texts += [str(a), a.exploded.upper(), ":".join(f"{x:x}" for x in g)]
    texts += ["::", "::1", "1::", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::FFFF:1.2.3.4", "::0102:0304", "1:0:0:2:0:0:3:4", "1:0:2:3:4:5:6:7"]
    bad = ["", ":", ":::", "1:::2", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2:3:4:5:6:7:8", "12345::", "g::", "1.2.3.4", "::1.2.3", "::1.2.3.04", "::1.2.3.4:5", "1:", ":1", " ::1", "::1 ", "%a"]

    def slow(t):
        a = ipaddress.IPv6Address(t)
        b = a.packed
        v4 = ".".join(map(str, b[12:]))
        if a.ipv4_mapped:
            return "::ffff:" + v4
        return "::" + v4 if b[:12] == bytes(12) and b[12:14] != bytes(2) else a.compressed

    df = spark.createDataFrame([(t,) for t in [*texts, *bad, None]], "t string")
    rows = df.select("t", V.store_ipv6_address(F.col("t")).alias("v")).select("t", "v.ok", "v.canon", Y.sort_key(F.col("v.canon"), "ipv6-address").alias("key")).collect()
    for r in rows:
        if r.t in texts:
            assert r.ok and r.canon == slow(r.t) and bytes(r.key)[:16] == ipaddress.IPv6Address(r.t).packed, r
        else:
            assert not r.ok, r
    zones = ["::1", "::1%", "::1%a", "::1%a%b", "::2"]
    df = spark.createDataFrame([(t,) for t in zones[::-1]], "t string").select(V.store_ipv6_address(F.col("t"))["canon"].alias("t"))
    assert [r.t for r in df.orderBy(Y.sort_key(F.col("t"), "ipv6-address")).collect()] == zones
    zoned = spark.createDataFrame([("FAAC:21:011:Da85::87:daaF%1",)], "t string")
    a, b = zoned.select(V.store_ipv6_address(F.col("t")).alias("a"), V.store_ipv6_address(F.col("t"), zone=False).alias("b")).first()
    assert a.ok and a.canon == "faac:21:11:da85::87:daaf%1" and not b.ok
    some = [(t, n) for t in texts[:60] for n in (0, 1, 16, 33, 64, 111, 128)]
    df = spark.createDataFrame([(f"{t}/{n}", n) for t, n in some] + [("::/129", -1), ("::", -1), ("::/", -1), ("::/1/1", -1)], "t string, n int")
    for r in df.select("t", "n", V.store_ipv6_prefix(F.col("t")).alias("v")).collect():
        assert r.v.ok == (r.n >= 0)
        if r.v.ok:
            net = ipaddress.IPv6Network(r.t, strict=False)
            assert r.v.canon == f"{slow(str(net.network_address))}/{r.n}", r


def test_node_sets_compare_by_some_pair(spark):
    from sylva.operators import nodesets as E

    rng = random.Random(4)
    words = ["1", "1.0", "2", "-3", "x", "", "2.0000001", "7", None]
    kind = "ctx_id string, tree_id string, canon string"
    sides = [[(f"/c[{c}]", t, rng.choice(words)) for c in range(30) for t in ("t", "u") for _ in range(rng.randint(0, 3))] for _ in range(2)]
    left, right = (spark.createDataFrame(x, kind) for x in sides)

    def num(v):
        try:
            return round(float(v), 6)
        except (TypeError, ValueError):
            return None

    def holds(a, op, b):
        if op in ("=", "!="):
            return ((a or "") == (b or "")) == (op == "=")
        x, y = num(a), num(b)
        return x is not None and y is not None and {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    for op in ("=", "!=", "<", "<=", ">", ">="):
        want = {a[:2] for a in sides[0] for b in sides[1] if a[:2] == b[:2] and holds(a[2], op, b[2])}
        got = [tuple(r) for r in E.compare_sets(left, op, right).collect()]
        assert sorted(got) == sorted(want) and want, op
        assert E.compare_sets(left, op, right.limit(0)).count() == 0
    assert {tuple(r) for r in E.compare_value(left, "=", "x").collect()} == {a[:2] for a in sides[0] if a[2] == "x"}
    assert {tuple(r) for r in E.compare_value(left, ">", 1.0).collect()} == {a[:2] for a in sides[0] if (num(a[2]) or 0) > 1}
    assert E.compare_value(left, "=", False).count() == 0 and {tuple(r) for r in E.compare_value(left, "=", True).collect()} == {a[:2] for a in sides[0]}


def test_languages_come_from_the_nearest_ancestor(spark):
    from sylva.operators import nodesets as E

    text = '<a xml:lang="en-GB"><b><c>1</c></b><d xml:lang="de"><e>2</e><f xml:lang="EN"><g>3</g></f></d><h xml:lang="english"><i>4</i></h></a>'
    nodes = C.shred_xml(spark.createDataFrame([("t", text), ("u", "<a><c>1</c></a>")], "k string, t string"), F.col("k"), "t")
    got = E.lang(R.context(nodes, F.col("kind") == "leaf"), nodes, "en").select("tree_id", "node_id").collect()
    assert sorted(map(tuple, got)) == [("t", "/a/b/c"), ("t", "/a/d/f/g")]
