"""What larger tables and odd inputs of the fourth review showed."""

import json

from pyspark.sql import functions as F

from sylva.sources import documents as C


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_open_in_one_pass(spark):
    docs = spark.createDataFrame([(1, '{"m:a":{"l":[{"k":1,"d":{"e":[]}},{"k":"1","d":{"e":{}}}],"n":[null,"x",null]}}')], "id int, t string")
    nodes = C.shred_json(docs, F.col("id"), "t", C.Shape({"/a/l": ["k"]}))
    plan = plan_of(nodes)
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "Exchange" not in plan
    ids = sorted(r.node_id for r in nodes.collect())
    assert ids == sorted(["/a", *["/a/l[k='1']"] * 2, *["/a/l[k='1']/d"] * 2, "/a/l[k='1']/d/e", *["/a/l[k='1']/k"] * 2, "/a/n[1]", "/a/n[2]", "/a/n[3]"])


def test_trees_print_with_one_shuffle(spark):
    doc = {"m:a": {"b": [{"x": i, "y": {"z": [str(i), 'q"\\\n\u0001é']}} for i in range(12)], "c": {}, "d": None}, "w": 1.5}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "bad{"), (3, "{}")], "id int, t string")
    printed = C.print_json(C.shred_json(docs, F.col("id"), "t"), "report-all")
    assert plan_of(printed).count("Exchange") == 1
    got = {r.tree_id: r.document for r in printed.collect()}
    assert json.loads(got["1"]) == doc and got["2"] == "bad{" and "3" not in got
    xml = spark.createDataFrame([(1, "<r><a>1</a><a>2</a><b><c>3</c></b></r>")], "id int, t string")
    back = C.print_xml(C.shred_xml(xml, F.col("id"), "t"))
    assert plan_of(back).count("Exchange") == 1 and back.first().document == "<r><a>1</a><a>2</a><b><c>3</c></b></r>"


def test_nodes_of_one_place_keep_their_children(spark):
    row = lambda i, up, anc, key, name, kind, canon: ("t", i, up, anc, key, name, kind, canon, name, None, i, "number" if canon else "object", False)
    rows = [row("/b", None, [], ["~"], "b", "container", None), row("/a", None, [], ["~"], "a", "container", None), row("/b/x", "/b", ["/b"], ["~", "1"], "x", "leaf", "1"), row("/a/y", "/a", ["/a"], ["~", "0"], "y", "leaf", "2"), row("/c", None, [], ["~!"], "c", "leaf", "3")]
    nodes = spark.createDataFrame(rows, C.SCHEMA)
    assert C.print_json(nodes).first().document == '{"a":{"y":2},"b":{"x":1},"c":3}'


def test_instants_keep_their_places(spark):
    from sylva.functions import types as Y

    cases = {
        "0001-01-01T00:00:00Z": "0001-01-01T00:00:00+00:00", "1969-12-31T23:59:59.123456789123-00:30": "1969-12-31T23:29:59.123456789123+00:00", "2024-03-31T02:30:00+00:00": "2024-03-31T02:30:00+00:00",
        "2024-01-01T00:00:00.0Z": "2024-01-01T00:00:00.0+00:00", "2024-01-01T00:00:00.Z": None, "2024-01-01T00:00:00Z\n": None, "2024-01-01T00:00:00": None, "2024-01-01T00:60:00Z": None, "2024-01-01T00:00:00+24:00": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", Y.store_date_and_time(F.col("s")).alias("v"))
    assert {r.s: r.v.canon for r in rows.collect()} == cases
    assert {r.s for r in rows.where(Y.sort_key(F.col("v.canon"), "date-and-time") < Y.sort_key(F.lit("2024-01-01T00:00:00.00+00:00"), "date-and-time")).collect()} == {"0001-01-01T00:00:00Z", "1969-12-31T23:59:59.123456789123-00:30"}


def test_rounds_of_whens_keep_ids_only(spark):
    from sylva.operators import fixpoint as P
    from sylva.operators import tree as R

    rows = []
    for t in ("x", "y"):
        rows += [(t, "/a", None, [], ["0"], "a", "container", None), (t, "/a/b", "/a", ["/a"], ["0", "0"], "b", "leaf", t), (t, "/c", None, [], ["1"], "c", "container", None)]
        rows += [(t, "/c/d", "/c", ["/c"], ["1", "0"], "d", "container", None), (t, "/c/d/e", "/c/d", ["/c", "/c/d"], ["1", "0", "0"], "e", "leaf", "1"), (t, "/f", None, [], ["2"], "f", "leaf", "1")]
    nodes = spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, anc_ids array<string>, doc_key array<string>, name string, kind string, canon string")
    has = lambda name, value: lambda ctx, left: ctx.join(left.where((F.col("name") == name) & (F.col("canon") == value)).select("tree_id"), "tree_id", "left_semi")
    stay, gone, _ = P.settle_whens(nodes, [P.When("f", has("e", "1"), ("e", "c")), P.When("c", has("b", "x"), ("b",))])
    assert {(r.tree_id, r.node_id) for r in stay.collect()} == {(t, n) for t in "xy" for n in ("/a", "/a/b")} | {("x", n) for n in ("/c", "/c/d", "/c/d/e", "/f")}
    assert {(r.name, r.tree_id, r.node_id) for r in gone.collect()} == {("c", "y", "/c"), ("f", "y", "/f")} and stay.columns == R.COLUMNS
    # No checkpoint of nodes: what was written holds ids.
    files = [f.split("/")[-2] for f in stay.inputFiles()]
    assert files and all(f.startswith("stored-") for f in files)


def test_moves_are_worked_out_once(spark):
    import random

    from sylva.operators import moves as M

    rows = spark.createDataFrame([(g, k, i) for g in range(60) for i, k in enumerate("abcd")], "g int, k string, pos int")
    drawn = F.udf(lambda k: random.choice("bcd"), "string").asNondeterministic()
    moves = spark.range(60).select(F.col("id").cast("int").alias("g"), F.lit(1).alias("seq"), F.lit("move").alias("op"), drawn("id").alias("k"), F.lit(None).cast("string").alias("anchor"))
    got = {}
    for r in M.replay(rows, moves, ["g"], "k", "pos").orderBy("g", "pos").collect():
        got.setdefault(r.g, []).append(r.k)
    assert len(got) == 60 and {"".join(x) for x in got.values()} == {"bacd", "cabd", "dabc"}


def test_schema_tables_are_broadcast(spark):
    from sylva.operators import diagnostics as G
    from sylva.operators import schema_paths as A

    schema = G.schema_table(spark, [G.SchemaNode("/a", "container"), G.SchemaNode("/a/l", "list", keys=["k"], min_elements=2), G.SchemaNode("/a/l/k"), G.SchemaNode("/a/x", status="obsolete", config=False)])
    nodes = C.shred_json(spark.createDataFrame([(1, '{"a":{"l":[{"k":1}],"x":2,"y":3}}')], "id int, t string"), F.col("id"), "t", C.Shape({"/a/l": ["k"]}))
    for rows in (G.unknown_nodes(nodes, schema), G.obsolete(nodes, schema), A.path_atoms(nodes, "node_id", schema.select("path"))[0]):
        assert "hashpartitioning" not in plan_of(rows) and "BroadcastHashJoin" in plan_of(rows)
    assert sorted(r.phase for r in G.validate(nodes, schema, state=False).collect()) == ["elements", "obsolete", "unexpected", "unknown"]
