"""Registered queries on whole trees: documents, intervals, moves, conditions, contexts, pruned differences, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import inet6 as V
from sylva.functions import types as Y
from sylva.operators import contexts as N
from sylva.operators import defaults as H
from sylva.operators import diff as D
from sylva.operators import fixpoint as P
from sylva.operators import intervals as I
from sylva.operators import moves as M
from sylva.operators import nodesets as E
from sylva.operators import tree as R
from sylva.operators import treediff as T
from sylva.plans import schema as K
from sylva.plans.catalog import _CP, _GEO, _MOVED, _NP, _geo, _ordered, _t, query
from sylva.sources import documents as C
from sylva.streaming import changelog as S

_LINES = "l AS (SELECT l_orderkey AS k, l_suppkey AS s, min(l_linenumber) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)"
_SHAPE = C.Shape({"/order/line": ["supp"]})


def _lines(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"), F.sum("l_quantity").cast("long").alias("q"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    """(k, document): orders with their lines as JSON, three levels deep, quantities as text as 64-bit integers are."""
    line = F.struct(F.col("l_suppkey").alias("supp"), F.struct(F.col("q").cast("string").alias("q"), (F.col("q") > 30).alias("big")).alias("much"), F.col("n"))
    lines = _lines(s, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("line"))
    full = _t(s, d, "orders").join(lines, "o_orderkey", "left")
    body = F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.array(F.lit("a"), F.col("o_orderstatus")).alias("tag"), "line").alias("shop:order"))
    return full.select(F.col("o_orderkey").alias("k"), F.to_json(body).alias("document"))


_NODES = f"""WITH {_LINES} SELECT o_orderkey::VARCHAR AS tree_id, '/order' AS node_id, 'container' AS kind, NULL AS canon, 'object' AS type FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, '/order/status', 'leaf', o_orderstatus, 'string' FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, '/order/tag[.=''a'']', 'leaf', 'a', 'string' FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, '/order/tag[.=''' || o_orderstatus || ''']', 'leaf', o_orderstatus, 'string' FROM orders
UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']', 'list', NULL, 'object' FROM l JOIN orders ON k = o_orderkey
UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']/supp', 'leaf', s::VARCHAR, 'number' FROM l JOIN orders ON k = o_orderkey
UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']/n', 'leaf', n::VARCHAR, 'number' FROM l JOIN orders ON k = o_orderkey
UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']/much', 'container', NULL, 'object' FROM l JOIN orders ON k = o_orderkey
UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']/much/q', 'leaf', q::VARCHAR, 'string' FROM l JOIN orders ON k = o_orderkey
UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']/much/big', 'leaf', (q > 30)::VARCHAR, 'boolean' FROM l JOIN orders ON k = o_orderkey"""


@query("c1_document_nodes", _NODES)
def c1_nodes(s, d):
    return C.shred_json(_documents(s, d), F.col("k"), "document", _SHAPE).select("tree_id", "node_id", "kind", "canon", "type")


@query("c1_event_props", "SELECT event_id::VARCHAR AS tree_id, '/' || key AS node_id, (props::JSON ->> key)::VARCHAR AS canon FROM events, unnest(json_keys(props::JSON)) AS t(key)")
def c1_props(s, d):
    return C.shred_json(_t(s, d, "events"), F.col("event_id"), "props").select("tree_id", "node_id", "canon")


@query("c11_anydata_text", f"WITH {_LINES} SELECT k::VARCHAR AS tree_id, '/order/line[supp=''' || s || ''']/much' AS node_id, 'opaque' AS kind, '{{\"big\":' || (q > 30) || ',\"q\":\"' || q || '\"}}' AS canon FROM l JOIN orders ON k = o_orderkey")
def c11(s, d):
    nodes = C.shred_json(_documents(s, d), F.col("k"), "document", C.Shape(_SHAPE.lists, text={"/order/line/much"}))
    return nodes.where("path LIKE '/order/line/much%'").select("tree_id", "node_id", "kind", "canon")


@query("c4_unknown_at_depth", f"WITH {_LINES} SELECT k::VARCHAR AS tree_id, '/order/line[supp=''' || s || ''']/n' AS node_id FROM l JOIN orders ON k = o_orderkey")
def c4_depth(s, d):
    known = {"/order", "/order/line", "/order/line/n"}
    return C.shred_json(_documents(s, d), F.col("k"), "document", C.Shape(_SHAPE.lists, known=known, unknown="skip")).where("kind = 'leaf'").select("tree_id", "node_id")


@query("c3_xml_nodes", f"WITH {_LINES} SELECT k::VARCHAR AS tree_id, '/order' AS node_id, 'urn:shop' AS module, NULL AS canon FROM l GROUP BY k UNION ALL SELECT k::VARCHAR, '/order/@id', NULL, k::VARCHAR FROM l GROUP BY k UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']', 'urn:shop', NULL FROM l UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']/supp', 'urn:shop', s::VARCHAR FROM l UNION ALL SELECT k::VARCHAR, '/order/line[supp=''' || s || ''']/q', 'urn:q', '0' || q FROM l")
def c3_nodes(s, d):
    line = F.concat(F.lit("<line><supp>"), F.col("l_suppkey").cast("string"), F.lit("</supp><x:q>0"), F.col("q").cast("string"), F.lit("</x:q></line>"))
    docs = _lines(s, d).groupBy("l_orderkey").agg(F.concat_ws("", F.sort_array(F.collect_list(line))).alias("_l"))
    text = F.concat(F.lit('<order xmlns="urn:shop" xmlns:x="urn:q" id="'), F.col("l_orderkey").cast("string"), F.lit('">'), "_l", F.lit("</order>"))
    return C.shred_xml(docs.select("l_orderkey", text.alias("t")), F.col("l_orderkey"), "t", _SHAPE).select("tree_id", "node_id", "module", "canon")


_LINE_TEXT = """string_agg('{"much":{"big":' || (q > 30) || ',"q":"' || q || '"},"n":' || n || ',"supp":' || s || '}', ',' ORDER BY s)"""


@query("c12_print_whole_tree", f"""WITH {_LINES}, j AS (SELECT k, {_LINE_TEXT} AS ls FROM l GROUP BY k) SELECT o_orderkey::VARCHAR AS tree_id, '{{"shop:order":{{' || CASE WHEN ls IS NULL THEN '' ELSE '"line":[' || ls || '],' END || '"status":"' || o_orderstatus || '","tag":["a","' || o_orderstatus || '"]}}}}' AS document FROM orders LEFT JOIN j ON k = o_orderkey""")
def c12_tree(s, d):
    return C.print_json(C.shred_json(_documents(s, d), F.col("k"), "document", _SHAPE))


@query("c14_whole_tree_trim", """SELECT d.doc_id::VARCHAR AS tree_id, CASE WHEN coalesce(l.toxic, 0) = 0 THEN '{}' ELSE '{"judged":{"toxic":' || l.toxic || '}}' END AS trimmed, '{"judged":{"toxic":' || coalesce(l.toxic, 0) || CASE WHEN l.toxic IS NULL THEN ',"@toxic":{"ietf-netconf-with-defaults:default":true}' ELSE '' END || '}}' AS tagged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def c14_tree(s, d):
    both = _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    texts = both.select("doc_id", F.col("toxic").isNull().alias("_set"), F.to_json(F.struct(F.struct(F.coalesce("toxic", F.lit(0)).alias("toxic")).alias("judged"))).alias("t"))
    nodes = C.shred_json(texts, F.col("doc_id"), "t", depth=2)
    given = texts.select(F.col("doc_id").cast("string").alias("tree_id"), F.lit("toxic").alias("name"), F.col("_set").alias("implicit"), F.lit("0").alias("default"))
    full = nodes.join(given, ["tree_id", "name"], "left")
    trimmed, tagged = (C.print_json(full, m, depth=1).withColumnRenamed("document", c) for m, c in (("trim", "trimmed"), ("implicit-tagged", "tagged")))
    return trimmed.join(tagged, "tree_id")


@query("d12_interval_counts", f"SELECT {_NP} AS node_id, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT '/region[' || r_regionkey || ']', count(c_custkey) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def d12_intervals(s, d):
    labelled = I.label(_geo(s, d).where("kind = 'list'"))
    return I.axis_counts(labelled.where("name <> 'customer'"), labelled, "customer").select("node_id", F.col("descendants").alias("n"))


@query("d15_interval_following", f"SELECT node_id, pos - 1 AS preceding, count(*) OVER () - pos AS following FROM (SELECT {_CP} AS node_id, row_number() OVER (ORDER BY r_regionkey, n_nationkey, c_custkey) AS pos FROM {_GEO})")
def d15_intervals(s, d):
    labelled = I.label(_geo(s, d).where("kind = 'list'"))
    return I.axis_counts(labelled.where("name = 'customer'"), labelled, "customer").select("node_id", "preceding", "following")


@query("d15_nearest_following", f"SELECT * FROM (SELECT {_NP} AS node_id, lead({_NP}) OVER (ORDER BY r_regionkey, n_nationkey) AS found FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE found IS NOT NULL")
def d15_nearest(s, d):
    labelled = I.label(_geo(s, d).where("kind = 'list'"))
    return I.nearest(labelled.where("name = 'nation'"), labelled, "nation").select("node_id", "found")


@query("f5_minimal_moves", f"WITH {_MOVED} SELECT l_orderkey, least(top // 2, top - top // 2) AS n FROM x GROUP BY ALL HAVING top > 1")
def f5_fewest(s, d):
    # Each list is turned so that its second half comes first: only the smaller half has to move.
    from pyspark.sql import Window

    rows = _ordered(s, d)
    half = F.floor(F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")) / 2)
    turned = rows.withColumn("_h", half).withColumn("pos", F.when(F.col("pos") <= F.col("_h"), F.col("pos") + 1_000_000).otherwise(F.col("pos"))).drop("_h")
    return M.minimal_moves(rows, turned, ["l_orderkey"], "l_suppkey", "pos").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("f5_replay_restores", f"WITH {_MOVED} SELECT l_orderkey, l_suppkey, top + 1 - pos AS pos FROM x")
def f5_replay(s, d):
    rows = _ordered(s, d)
    back = rows.withColumn("pos", -F.col("pos"))
    return M.replay(rows, M.minimal_moves(rows, back, ["l_orderkey"], "l_suppkey", "pos"), ["l_orderkey"], "l_suppkey", "pos")


_CHAIN = ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"]


@query("h9_when_chain", "WITH RECURSIVE c(k, i) AS (SELECT o_orderkey, 0 FROM orders UNION ALL SELECT k, i + 1 FROM c JOIN orders ON o_orderkey = k WHERE i < 3 AND (i > 0 OR o_orderstatus = 'F')) SELECT '/order[' || k || ']/' || ['o_orderstatus', 'o_totalprice', 'o_orderpriority', 'o_custkey'][i + 1] AS node_id FROM c")
def h9_chain(s, d):
    nodes = R.shred(_t(s, d, "orders"), F.lit("sales"), [("order", "o_orderkey")], _CHAIN)

    def beside(name: str, value: str | None = None):
        def holds(ctx, left):
            there = left.where((F.col("name") == name) & (F.lit(True) if value is None else F.col("canon") == value)).select("tree_id", "parent_id")
            return ctx.join(there, ["tree_id", "parent_id"], "left_semi")

        return holds

    # Each leaf needs the one before it, and the second needs a value of the first.
    rules = [P.When(b, beside(a, "F" if a == _CHAIN[0] else None), (a,)) for a, b in reversed(list(zip(_CHAIN, _CHAIN[1:])))]
    return P.settle_whens(nodes, rules)[0].where("kind = 'leaf'").select("node_id")


def _claims(s: SparkSession, d: str) -> DataFrame:
    """Nodes of orders, and of claims: a line says which customer its order is of, wrongly for every third order."""
    orders = _t(s, d, "orders").select("o_orderkey", "o_custkey")
    claims = _lines(s, d).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    claims = claims.select("l_orderkey", "l_suppkey", (F.col("o_custkey") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)).alias("cust"))
    one = R.shred(orders, F.lit("sales"), [("order", "o_orderkey")], ["o_orderkey", "o_custkey"])
    return one.unionByName(R.shred(claims, F.lit("sales"), [("of", "l_orderkey"), ("claim", "l_suppkey")], ["l_orderkey", "cust"]))


@query("h11_keyed_leafref", f"WITH {_LINES} SELECT 'instance-required' AS rule, '/of[' || k || ']/claim[' || s || ']/cust' AS path, 'cust refers to ' || (o_custkey + 1) AS message FROM l JOIN orders ON k = o_orderkey WHERE k % 3 = 0")
def h11_keyed(s, d):
    nodes = _claims(s, d)
    return N.keyed_leafref(R.context(nodes, F.col("name") == "cust"), nodes, "order", [("o_orderkey", "../l_orderkey")], "o_custkey")


@query("e28_current", f"WITH {_LINES} SELECT '/of[' || k || ']/claim[' || s || ']' AS ctx_id, '/order[' || k || ']' AS node_id FROM l JOIN orders ON k = o_orderkey")
def e28(s, d):
    nodes = _claims(s, d)
    return N.matching(R.context(nodes, F.col("name") == "claim"), nodes, "order", [("o_orderkey", "l_orderkey")]).select("ctx_id", "node_id")


@query("e29_deref_by_path", f"WITH {_LINES} SELECT '/of[' || k || ']/claim[' || s || ']/cust' AS ctx_id, '/order[' || k || ']/o_custkey' AS node_id FROM l JOIN orders ON k = o_orderkey WHERE k % 3 <> 0")
def e29_path(s, d):
    nodes = _claims(s, d)
    return N.deref(R.context(nodes, F.col("name") == "cust"), nodes, "order", [("o_orderkey", "../l_orderkey")], "o_custkey").select("ctx_id", "node_id")


@query("f1_pruned_tree_diff", f"SELECT {_CP} || '/c_acctbal' AS node_id, 'replace' AS op FROM {_GEO} WHERE c_custkey % 50 = 0 AND n_nationkey <> 3 UNION ALL SELECT {_NP}, 'delete' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3 UNION ALL SELECT '/region[' || (r_regionkey + 100) || ']', 'create' FROM region WHERE r_regionkey = 2")
def f1_pruned(s, d):
    nodes = _geo(s, d)
    key = F.regexp_extract("node_id", r"/customer\[([0-9]+)\]", 1).try_cast("bigint")
    changed = nodes.where(~F.col("node_id").rlike(r"/nation\[3\]")).withColumn("canon", F.when((F.col("name") == "c_acctbal") & (key % 50 == 0), F.concat("canon", F.lit("9"))).otherwise(F.col("canon")))
    more = _t(s, d, "region").where("r_regionkey = 2").withColumn("r_regionkey", F.col("r_regionkey") + 100)
    changed = changed.unionByName(R.shred(more, F.lit("geo"), [("region", "r_regionkey")], ["r_name"]))
    return T.diff_trees(T.fingerprints(nodes), T.fingerprints(changed)).select("node_id", "op")


def _log(s: SparkSession, d: str) -> DataFrame:
    """Twenty differences in turn: a third of all orders get another price each time, and those of the last are deleted if
    their key divides by 5."""
    rows = _t(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("seq")).where("(o_orderkey + seq) % 3 = 0")
    before = F.when(F.col("seq") > 3, F.col("p") + F.col("seq") - 3).otherwise(F.col("p"))
    ends = (F.col("seq") > 17) & (F.col("o_orderkey") % 5 == 0)
    return rows.select("o_orderkey", "seq", F.when(ends, "delete").otherwise("replace").alias("op"), F.when(~ends, F.col("p") + F.col("seq")).alias("o_totalprice"), before.alias("orig_o_totalprice"))


@query("f9_fold_log", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'replace' END AS op, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice + m END AS o_totalprice, o_totalprice AS orig_o_totalprice FROM (SELECT *, (SELECT max(s) FROM range(1, 21) t(s) WHERE (o_orderkey + s) % 3 = 0) AS m FROM orders)")
def f9_fold(s, d):
    return T.fold_diffs(_log(s, d), ["o_orderkey"], ["o_totalprice"])


@query("f9_fold_applied", "SELECT o_orderkey, o_totalprice + (SELECT max(s) FROM range(1, 21) t(s) WHERE (o_orderkey + s) % 3 = 0) AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0")
def f9_applied(s, d):
    base = _t(s, d, "orders").select("o_orderkey", "o_totalprice")
    return D.apply_diff(base, f9_fold(s, d), ["o_orderkey"], ["o_totalprice"])


def _judged(s: SparkSession, d: str) -> DataFrame:
    """A tree a document: a container for its label, if it has any, beside the language."""
    both = _t(s, d, "documents").select("doc_id", "lang").join(_t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    text = F.to_json(F.struct(F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.when(F.col("quality").isNotNull(), F.struct("quality")).alias("judged")).alias("doc")))
    nodes = C.shred_json(both.select("doc_id", text.alias("t")), F.col("doc_id"), "t", depth=3)
    return H.implied(nodes, ["/doc/judged", "/doc/judged/limits", "/stats"], {"/doc/judged/quality": "0", "/doc/judged/limits/most": "5", "/stats/seen": "no"})


@query("h6_implied_tree", "WITH d AS (SELECT d.doc_id::VARCHAR AS tree_id, coalesce(lang, '') AS lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT tree_id, '/doc' AS node_id, NULL AS canon, false AS implicit FROM d UNION ALL SELECT tree_id, '/doc/lang', lang, false FROM d UNION ALL SELECT tree_id, '/doc/judged', NULL, quality IS NULL FROM d UNION ALL SELECT tree_id, '/doc/judged/quality', coalesce(quality, 0)::VARCHAR, quality IS NULL FROM d UNION ALL SELECT tree_id, '/doc/judged/limits', NULL, true FROM d UNION ALL SELECT tree_id, '/doc/judged/limits/most', '5', true FROM d UNION ALL SELECT tree_id, '/stats', NULL, true FROM d UNION ALL SELECT tree_id, '/stats/seen', 'no', true FROM d")
def h6_tree(s, d):
    return _judged(s, d).select("tree_id", "node_id", "canon", "implicit")


@query("h8_container_flags", "WITH d AS (SELECT d.doc_id::VARCHAR AS tree_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT tree_id, '/doc' AS node_id, false AS is_default FROM d UNION ALL SELECT tree_id, '/doc/judged', quality IS NULL FROM d UNION ALL SELECT tree_id, '/doc/judged/limits', true FROM d UNION ALL SELECT tree_id, '/stats', true FROM d")
def h8(s, d):
    return H.container_flags(_judged(s, d)).where("kind = 'container'").select("tree_id", "node_id", F.col("default").alias("is_default"))


@query("g8_instants", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.50+00:00' AS canon, true AS equal, event_id % 2 = 0 AS before FROM events")
def g8_instants(s, d):
    # One instant in two zones and with two fractions of the same size, and another one a little earlier or later.
    def written(moved: str, zone: str, fraction: str):
        return F.concat(F.date_format(F.col("ts") + F.expr(moved), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(fraction + zone))

    other = F.concat(F.date_format(F.col("ts") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, ".51-03:00").otherwise(".4999-03:00"))
    # Texts, instants and keys are made once each, in steps.
    rows = _t(s, d, "events").select("event_id", written("INTERVAL 0 HOURS", "Z", ".50").alias("one"), written("INTERVAL 5 HOURS 30 MINUTES", "+05:30", ".5").alias("two"), other.alias("other"))
    rows = rows.select("event_id", *[Y.store_date_and_time(F.col(c)).alias(c) for c in ("one", "two", "other")])
    before = Y.sort_key(F.col("one.canon"), "date-and-time") < Y.sort_key(F.col("other.canon"), "date-and-time")
    return rows.select("event_id", F.col("one.canon").alias("canon"), Y.same_instant(F.col("one"), F.col("two")).alias("equal"), before.alias("before"))


@query("d27_number_shapes", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey::DOUBLE WHEN 1 THEN (o_orderkey % 4096)::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN o_orderkey * 100::DOUBLE ELSE NULL END AS value FROM orders")
def d27_shapes(s, d):
    from sylva.functions import xpath as X

    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("0x"), F.hex(k % 4096))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit("d"))).when(k % 5 == 3, F.concat(k.cast("string"), F.lit("e2"))).otherwise(F.concat(k.cast("string"), F.lit(" ")))
    value = X.number(text)
    return _t(s, d, "orders").select("o_orderkey", F.when(~F.isnan(value), value).alias("value"))


@query("s3_replies", "SELECT q.event_id, r.event_id AS answer FROM events q LEFT JOIN events r ON r.event_id = q.event_id + 1 AND r.ts BETWEEN q.ts AND q.ts + INTERVAL 1 HOUR WHERE q.event_id % 2 = 0")
def s3(s, d):
    e = _t(s, d, "events").select("event_id", "ts", (F.col("event_id") - F.col("event_id") % 2).alias("message"))
    out = S.replies(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "message", "ts", "1 HOUR")
    return out.select("event_id", F.col("answer_event_id").alias("answer"))


@query("s2_updates_folded", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_id % 7, event_id) <> 0")
def s2_updates(s, d):
    log = _t(s, d, "events").select("user_id", "event_id", "value", F.when(F.col("event_id") % 7 == 0, "delete").otherwise("replace").alias("op"))
    return S.fold(S.updates(log, ["user_id"], ["value"], "event_id"), ["user_id"], ["value"], "event_id")


_SALES = K.Model(
    K.ListNode("customer", ["c_custkey"], [K.Leaf("c_custkey", "int64", mandatory=True), K.Leaf("c_acctbal", "double", must="c_acctbal >= 0")]),
    K.ListNode(
        "orders", ["o_orderkey"], [K.Leaf("o_orderkey", "int64", mandatory=True), K.Leaf("o_custkey", "int64", leafref=("customer", "c_custkey")), K.Leaf("o_orderpriority", when="o_orderstatus = 'F'")],
        parent=("customer", ["o_custkey"]), min_elements=1, max_elements=20,
    ),
)


@query("h1_validate_model", """WITH c AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0)
SELECT 'must-violation' AS rule, '/customer[c_custkey=''' || c_custkey || ''']' AS path, 'must condition is false' AS message FROM c WHERE c_acctbal < 0
UNION ALL SELECT 'instance-required', '/orders[o_orderkey=''' || o_orderkey || ''']', 'o_custkey refers to ' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'when-violation', '/orders[o_orderkey=''' || o_orderkey || ''']', 'o_orderpriority is present though its when is false' FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT CASE WHEN n > 20 THEN 'too-many-elements' ELSE 'too-few-elements' END, '/customer[c_custkey=''' || c_custkey || ''']', n || ' entries' FROM (SELECT c_custkey, count(o_orderkey) AS n FROM c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE n < 1 OR n > 20""")
def h1(s, d):
    return _SALES.validate({"customer": _t(s, d, "customer").where("c_custkey % 10 <> 0"), "orders": _t(s, d, "orders")})



@query("c13_print_whole_tree", f"""WITH {_LINES} SELECT k::VARCHAR AS tree_id, '<order xmlns="urn:shop" id="' || k || '">' || string_agg('<line><supp>' || s || '</supp><q xmlns="urn:q">0' || q || '</q></line>', '' ORDER BY '<line><supp>' || s || '</supp><x:q>0' || q) || '</order>' AS document FROM l GROUP BY k""")
def c13_tree(s, d):
    line = F.concat(F.lit("<line><supp>"), F.col("l_suppkey").cast("string"), F.lit("</supp><x:q>0"), F.col("q").cast("string"), F.lit("</x:q></line>"))
    docs = _lines(s, d).groupBy("l_orderkey").agg(F.concat_ws("", F.sort_array(F.collect_list(line))).alias("_l"))
    text = F.concat(F.lit('<order xmlns="urn:shop" xmlns:x="urn:q" id="'), F.col("l_orderkey").cast("string"), F.lit('">'), "_l", F.lit("</order>"))
    return C.print_xml(C.shred_xml(docs.select("l_orderkey", text.alias("t")), F.col("l_orderkey"), "t", _SHAPE))


_OPS = ["=", "!=", "<", "<=", ">", ">="]


@query("d24_node_sets", "WITH v AS (SELECT l_orderkey AS k, l_linenumber AS a, (l_quantity % 8)::BIGINT AS b FROM lineitem) SELECT DISTINCT '/order[' || x.k || ']' AS ctx_id, op FROM v x JOIN v y ON x.k = y.k, unnest(['=', '!=', '<', '<=', '>', '>=']) AS t(op) WHERE CASE op WHEN '=' THEN x.a = y.b WHEN '!=' THEN x.a <> y.b WHEN '<' THEN x.a < y.b WHEN '<=' THEN x.a <= y.b WHEN '>' THEN x.a > y.b ELSE x.a >= y.b END")
def d24_sets(s, d):
    lines = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("a"), (F.col("l_quantity") % 8).cast("long").alias("b"))
    nodes = R.shred(lines, F.lit("sales"), [("order", "l_orderkey"), ("line", "l_linenumber")], ["a", "b"])

    def values(name: str) -> DataFrame:
        return nodes.where(F.col("name") == name).select(F.element_at("anc_ids", 1).alias("ctx_id"), *R.COLUMNS)

    out = [E.compare_sets(values("a"), op, values("b")).select("ctx_id", F.lit(op).alias("op")) for op in _OPS]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


@query("d24_set_and_value", "SELECT '/order[' || l_orderkey || ']' AS ctx_id, '4.0' AS value FROM lineitem WHERE l_linenumber = 4 GROUP BY l_orderkey UNION ALL SELECT '/order[' || l_orderkey || ']', 'true' FROM lineitem GROUP BY l_orderkey UNION ALL SELECT '/order[' || l_orderkey || ']', 'not O' FROM lineitem WHERE l_linestatus <> 'O' GROUP BY l_orderkey")
def d24_value(s, d):
    lines = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("a"), F.col("l_linestatus").alias("status"))
    nodes = R.shred(lines, F.lit("sales"), [("order", "l_orderkey"), ("line", "l_linenumber")], ["a", "status"])
    sets = {n: nodes.where(F.col("name") == n).select(F.element_at("anc_ids", 1).alias("ctx_id"), *R.COLUMNS) for n in ("a", "status")}
    number = E.compare_value(sets["a"], "=", 4.0).select("ctx_id", F.lit("4.0").alias("value"))
    truth = E.compare_value(sets["a"], "=", True).select("ctx_id", F.lit("true").alias("value"))
    return number.unionByName(truth).unionByName(E.compare_value(sets["status"], "!=", "O").select("ctx_id", F.lit("not O").alias("value")))


@query("e14_lang_inherited", "SELECT doc_id::VARCHAR AS tree_id, '/doc/q/r' AS node_id FROM documents UNION ALL SELECT doc_id::VARCHAR, '/doc/p' FROM documents WHERE lang = 'fr' OR lang LIKE 'fr-%'")
def e14_inherited(s, d):
    own = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("lang"), F.lit('"'))).otherwise("")
    text = F.concat(F.lit("<doc"), own, F.lit('><p>x</p><q xml:lang="FR-ca"><r>y</r></q></doc>'))
    nodes = C.shred_xml(_t(s, d, "documents").select("doc_id", text.alias("t")), F.col("doc_id"), "t")
    return E.lang(R.context(nodes, F.col("kind") == "leaf"), nodes, "fr").select("tree_id", "node_id")


@query("g1_ipv6_address", """WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 65536 AS x FROM customer)
SELECT c_custkey, c_custkey % 4 < 3 AS ok, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN x = 0 THEN '2001:db8::1' ELSE '2001:db8::' || printf('%x', x) || ':0:0:1' END WHEN 1 THEN 'fe80::' || printf('%x', x) || '%eth' || c_nationkey WHEN 2 THEN '::ffff:10.7.' || (x // 256) || '.' || (x % 256) END AS canon FROM c""")
def g1_ipv6(s, d):
    x = F.lpad(F.hex(F.col("c_custkey") % 65536), 4, "0")
    kinds = [
        F.concat(F.lit("2001:0DB8:0:000:"), x, F.lit(":0:00:0001")),
        F.concat(F.lit("FE80:0::0:"), x, F.lit("%eth"), F.col("c_nationkey").cast("string")),
        F.concat(F.lit("0:0:0:0::FFFF:0A07:"), x),
        F.concat(F.lit("1:::"), x),
    ]
    out = _t(s, d, "customer").select("c_custkey", V.store_ipv6_address(F.element_at(F.array(*kinds), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("v"))
    return out.select("c_custkey", "v.ok", F.when(F.col("v.ok"), F.col("v.canon")).alias("canon"))


@query("g9_ipv6_prefix_order", """WITH c AS (SELECT c_custkey, 32 + c_custkey % 17 AS n, c_custkey % 65536 AS x FROM customer), p AS (SELECT c_custkey, n, x - x % (1 << (48 - n)::INT) AS m FROM c)
SELECT c_custkey, CASE WHEN m = 0 THEN '2001:db8::/' || n ELSE '2001:db8:' || printf('%x', m) || '::/' || n END AS canon, dense_rank() OVER (ORDER BY m, n) AS place FROM p""")
def g9_ipv6(s, d):
    n = (F.col("c_custkey") % 17 + 32).cast("string")
    text = F.concat(F.lit("2001:DB8:"), F.hex(F.col("c_custkey") % 65536), F.lit(":1::9/"), n)
    rows = _t(s, d, "customer").select("c_custkey", V.store_ipv6_prefix(text)["canon"].alias("canon"))
    # Equal prefixes share a place, so the distinct ones are counted by ranges.
    places = Y.ranked(rows.select("canon").distinct(), Y.sort_key(F.col("canon"), "ipv6-prefix"), "place")
    return rows.join(places, "canon").select("c_custkey", "canon", F.col("place").cast("long").alias("place"))
