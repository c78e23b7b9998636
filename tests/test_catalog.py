"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sylva.functions import xpath as X
from sylva.operators import diff as D
from sylva.plans import catalog
from sylva.plans.schema import Leaf, ListNode, Model

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = sql.sql(catalog.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())


def test_scalar_traps(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-1.5, 1.25, "x"), (float("nan"), 0.0, None)], "a double, b double, s string")
    got = df.select(
        X.floor(F.col("a")), X.ceiling(F.col("a")), X.string(F.col("b")), X.number(F.col("s")), X.compare(F.col("a"), "=", F.col("a")), X.divide(F.lit(1.0), F.col("b"))
    ).collect()
    assert tuple(got[0])[:3] == (-1.0, 0.0, "1.2") and got[0][4] is True
    assert got[1][4] is True and got[1][5] == float("inf") and got[1][3] != got[1][3]


def test_diff_algebra_round_trip(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    d = D.diff(a, b, ["k"], ["v"])
    assert {(r.k, r.op) for r in d.collect()} == {(1, "delete"), (2, "replace"), (4, "create")}
    assert D.conflicts(a, d, ["k"]).count() == 0
    assert sorted(map(tuple, D.apply_diff(a, d, ["k"], ["v"]).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert D.merge_diffs(d, D.reverse(d, ["k"], ["v"]), ["k"], ["v"]).count() == 0


def test_model_reports_each_rule(spark):
    model = Model(
        ListNode("iface", ["name"], [Leaf("name", mandatory=True), Leaf("mtu", "uint16", must="mtu BETWEEN 68 AND 9000")]),
        ListNode("addr", ["ip"], [Leaf("ip"), Leaf("iface", leafref=("iface", "name"))], parent=("iface", ["iface"]), min_elements=1),
    )
    iface = spark.createDataFrame([("eth0", 1500), ("eth1", 10)], "name string, mtu int")
    addr = spark.createDataFrame([("10.0.0.1", "eth0"), ("10.0.0.1", "eth9")], "ip string, iface string")
    rules = sorted(r.rule for r in model.validate({"iface": iface, "addr": addr}).collect())
    assert rules == ["duplicate", "instance-required", "must-violation", "too-few-elements"]
    assert model.nodes(spark).where("leafref = '/iface/name'").count() == 1


def test_text_functions_on_odd_text(spark):
    from pyspark.sql import functions as F

    inf, nan = float("inf"), float("nan")
    cases = [("12345", 1.5, 2.6, "234"), ("12345", 0.0, 3.0, "12"), ("12345", nan, 3.0, ""), ("12345", 1.0, nan, ""), ("12345", -42.0, inf, "12345"), ("éa", 1.0, 2.0, "é"), ("éa", 2.0, 2.0, "\ufffda"), ("x", 5.0, 1.0, ""), (None, 1.0, 1.0, "")]
    df = spark.createDataFrame(cases, "s string, a double, n double, want string")
    assert all(r[0] == r[1] for r in df.select(X.substring(F.col("s"), F.col("a"), F.col("n")), "want").collect())
    texts = spark.createDataFrame([("a^b",), ("a$",), ("x1",), ("x\u0661",), ("-",), ("é",), ("a\nb",), ("7",), ("8",)], "s string")

    def match(pattern):
        return {r.s for r in texts.where(X.re_match(F.col("s"), pattern)).collect()}

    assert match("a^b") == {"a^b"} and match("a$") == {"a$"} and match("^a.*") == set()
    assert match(r"x\d") == {"x1", "x\u0661"} and match(r"x\\d") == set() and match(r"\w") == {"é", "7", "8"} and match(r"\W") == {"-"}
    assert match("a.b") == {"a^b"} and match(r"[\d-[02468]]") == {"7"} and match(r"\p{IsLatin-1Supplement}") == {"é"}


def test_operators_keep_trees_apart(spark):
    from pyspark.sql import functions as F

    from sylva.operators import tree as R

    rows = spark.createDataFrame([("t1", "eth0", "a", 1), ("t1", "eth0", "b", 2), ("t2", "eth0", "a", 5)], "tree string, iface string, unit string, mtu int")
    nodes = R.shred(rows, F.col("tree"), [("iface", "iface"), ("unit", "unit")], ["mtu"])
    tops = R.shred(rows.select("tree", "iface").distinct(), F.col("tree"), [("iface", "iface")], ["iface"])
    every = nodes.unionByName(tops)
    ctx = R.context(every, F.col("kind") == "list").where("name = 'iface'")
    units = R.child(ctx, every, "unit")
    assert {(r.tree_id, r.n) for r in R.count(ctx, units).collect()} == {("t1", 2), ("t2", 1)}
    assert {(r.tree_id, r.total) for r in R.total(ctx, R.descendant(ctx, every, "mtu")).collect()} == {("t1", 3.0), ("t2", 5.0)}
    refs = R.context(tops, F.col("name") == "iface").where("kind = 'leaf'")
    assert R.deref(refs, tops.where("kind = 'leaf'")).count() == 2
    order = [r.name for r in every.where("tree_id = 't2'").orderBy("doc_key").collect()]
    assert order == ["iface", "iface", "unit", "mtu"]  # an entry, its leaf, then its child entries


def test_conflicting_changes_fail(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    for op, k in (("create", 1), ("delete", 2), ("replace", 2), ("error", 1)):
        change = spark.createDataFrame([(k, op, "x", None)], "k int, op string, v string, orig_v string")
        with pytest.raises(Exception, match="cannot"):
            D.apply_diff(base, change, ["k"], ["v"]).collect()
        assert [tuple(r) for r in D.apply_diff(base, change, ["k"], ["v"], strict=False).collect()] == [(1, "a")]


def test_late_changes_do_not_bring_entries_back(spark, tmp_path):
    from sylva.streaming import changelog as S

    schema = "k int, op string, v string, at int"
    for i, rows in enumerate([[(1, "create", "a", 1), (2, "create", "b", 1)], [(1, "delete", None, 5)], [(1, "replace", "late", 3), (2, "replace", "c", 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
        S.fold_stream(stream, ["k"], ["v"], "at", f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    assert [tuple(r) for r in S.folded(spark, f"{tmp_path}/state", ["k"], ["v"]).collect()] == [(2, "c")]


def test_unknown_members_follow_the_policy(spark):
    from sylva.sources import codecs as C

    df = spark.createDataFrame([('{"a": "1", "b": "2"}',)], "line string")
    assert C.parse_json(df, "line", "a string", "skip").first().data.a == "1"
    assert C.parse_json(df, "line", "a string", "opaque").first().opaque == {"b": "2"}
    with pytest.raises(Exception, match="unknown members"):
        C.parse_json(df, "line", "a string", "reject").collect()


def test_typed_texts(spark):
    from pyspark.sql import functions as F
    from sylva.functions import types as Y

    def stored(f, *texts):
        out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", f(F.col("s")).alias("v")).orderBy("i")
        return [r.v.canon if r.v.ok else None for r in out.collect()]

    assert stored(Y.store_ipv4_prefix, "10.1.2.3/8", "255.255.255.255/32", "1.2.3.4/0", "1.2.3.4/33", "1.2.3.4", "01.2.3.4/8", "", None) == ["10.0.0.0/8", "255.255.255.255/32", "0.0.0.0/0", None, None, None, None, None]
    assert stored(Y.store_ipv4_address, "1.2.3.4", "1.2.3.4%eth0", "1.2.3.4%", "1.2.3", "256.1.1.1", None) == ["1.2.3.4", "1.2.3.4%eth0", None, None, None, None]
    assert stored(Y.store_date_and_time, "2024-02-29T10:00:00Z", "2023-02-29T10:00:00Z", "2024-01-01T10:00:00.5-00:00", "2024-01-01 10:00:00Z", None) == ["2024-02-29T10:00:00+00:00", None, "2024-01-01T10:00:00.5-00:00", None, None]


def test_copies_and_fingerprints(spark):
    from pyspark.sql import functions as F
    from sylva.operators import edit as E
    from sylva.operators import tree as R

    a = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, "x"), (2, 2, None)], "a int, b int, v string")
    path = [("a", "a"), ("b", "b")]
    nodes = R.shred(a.select("a").distinct(), F.lit("t"), path[:1], []).unionByName(R.shred(a, F.lit("t"), path, ["v"]))
    prints = {r.node_id: (r.f1, r.f2, r.n_nodes) for r in E.fingerprints(nodes).collect()}
    assert prints["/a[1]"] == prints["/a[2]"] and prints["/a[1]/b[1]"] != prints["/a[1]/b[2]"] and len(prints) == nodes.count()
    both = nodes.where("node_id IN ('/a[1]', '/a[1]/b[1]')")
    copies = {(r.root_id, r.node_id): (r.parent_id, len(r.anc_ids)) for r in E.duplicate(nodes, both, F.col("root_id")).collect()}
    assert copies == {
        ("/a[1]", "/a[1]"): (None, 0), ("/a[1]", "/a[1]/b[1]"): ("/a[1]", 1), ("/a[1]", "/a[1]/b[2]"): ("/a[1]", 1), ("/a[1]", "/a[1]/b[1]/v"): ("/a[1]/b[1]", 2),
        ("/a[1]/b[1]", "/a[1]/b[1]"): (None, 0), ("/a[1]/b[1]", "/a[1]/b[1]/v"): ("/a[1]/b[1]", 1),
    }
    kept = E.duplicate(nodes, both, F.col("root_id"), with_parents=True)
    assert {(r.node_id, r.parent_id) for r in kept.where("root_id = '/a[1]/b[1]'").collect()} == {("/a[1]/b[1]", "/a[1]"), ("/a[1]/b[1]/v", "/a[1]/b[1]")}
    changed = E.set_value(nodes, spark.createDataFrame([("t", "/a[1]/b[1]/v", "y"), ("t", "/a[9]/v", "z")], "tree_id string, node_id string, canon string"))
    assert [(r.node_id, r.canon) for r in changed.where("changed").collect()] == [("/a[1]/b[1]/v", "y")]
    assert E.add(nodes, nodes).count() == nodes.count()
    empty = nodes.where("false")
    assert E.add(empty, nodes).count() == nodes.count() and E.preorder(empty).count() == 0 and E.fingerprints(empty).count() == 0
