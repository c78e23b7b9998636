"""The registered queries of the library and their SQL, over the driver's tables.

The tables are lists of one model: region[r_regionkey]/nation[n_nationkey]/
customer[c_custkey], orders, lineitem (a bag), part, supplier, events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import types as Y
from sylva.functions import xpath as X
from sylva.operators import diff as D
from sylva.operators import edit as E
from sylva.operators import tree as R
from sylva.operators import validate as V
from sylva.sources import codecs as C
from sylva.streaming import changelog as S

_ALL: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        _ALL[name] = (f, sql)
        return f

    return add


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _geo(s: SparkSession, d: str) -> DataFrame:
    """Nodes of region/nation/customer, customers with name and segment."""
    region, nation, customer = _t(s, d, "region"), _t(s, d, "nation"), _t(s, d, "customer")
    tree = F.lit("geo")
    n = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    c = customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    path = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey")]
    return (
        R.shred(region, tree, path[:1], ["r_name"])
        .unionByName(R.shred(n, tree, path[:2], ["n_name"]))
        .unionByName(R.shred(c, tree, path, ["c_name", "c_mktsegment", "c_acctbal"]))
    )


_GEO = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_CP = "'/region[' || r_regionkey || ']/nation[' || n_nationkey || ']/customer[' || c_custkey || ']'"
_NP = "'/region[' || r_regionkey || ']/nation[' || n_nationkey || ']'"


@query("d8_axis_child", f"SELECT {_NP} AS ctx_id, {_CP} AS node_id FROM {_GEO}")
def d8(s, d):
    n = _geo(s, d)
    return R.child(R.context(n, F.col("name") == "nation"), n, "customer").select("ctx_id", "node_id")


@query("d10_axis_parent", f"SELECT DISTINCT {_CP} AS ctx_id, {_NP} AS node_id FROM {_GEO}")
def d10(s, d):
    n = _geo(s, d)
    return R.parent(R.context(n, F.col("name") == "customer"), n, single=True).select("ctx_id", "node_id")


@query("d11_axis_ancestor", f"SELECT {_CP} AS ctx_id, {_NP} AS node_id FROM {_GEO} UNION ALL SELECT {_CP}, '/region[' || r_regionkey || ']' FROM {_GEO}")
def d11(s, d):
    n = _geo(s, d)
    return R.ancestor(R.context(n, F.col("name") == "customer"), n, single=True).select("ctx_id", "node_id")


@query("d12_axis_descendant", f"SELECT '/region[' || r_regionkey || ']' AS ctx_id, count(*) AS n FROM {_GEO} GROUP BY 1")
def d12(s, d):
    n = _geo(s, d)
    return R.descendant(R.context(n, F.col("name") == "region"), n, "customer", single=True).groupBy("ctx_id").agg(F.count(F.lit(1)).alias("n"))


@query("d13_any_depth", "SELECT '/region[' || r_regionkey || ']/nation[' || n_nationkey || ']/customer[' || c_custkey || ']/c_name' AS node_id, c_name AS canon FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def d13(s, d):
    return R.any_depth(_geo(s, d), "c_name").select("node_id", "canon")



@query("d14_following_sibling", "SELECT a.n_nationkey AS k, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey GROUP BY 1")
def d14(s, d):
    n = _geo(s, d)
    out = R.following_sibling(R.context(n, F.col("name") == "nation"), n, "nation")
    return out.groupBy(F.regexp_extract("ctx_id", r"nation\[(\d+)\]", 1).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("d14_preceding_sibling", "SELECT a.n_nationkey AS k, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey < a.n_nationkey GROUP BY 1")
def d14b(s, d):
    n = _geo(s, d)
    out = R.preceding_sibling(R.context(n, F.col("name") == "nation"), n, "nation")
    return out.groupBy(F.regexp_extract("ctx_id", r"nation\[(\d+)\]", 1).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("d15_following", "SELECT a.r_regionkey AS k, count(*) AS n FROM region a JOIN nation b ON b.n_regionkey > a.r_regionkey GROUP BY 1")
def d15(s, d):
    n = _geo(s, d).where("name IN ('region', 'nation')")
    out = R.following(R.context(n, F.col("name") == "region"), n, "nation")
    return out.groupBy(F.regexp_extract("ctx_id", r"region\[(\d+)\]", 1).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("d15_preceding", "SELECT a.r_regionkey AS k, count(*) AS n FROM region a JOIN nation b ON b.n_regionkey < a.r_regionkey GROUP BY 1")
def d15b(s, d):
    n = _geo(s, d).where("name IN ('region', 'nation')")
    out = R.preceding(R.context(n, F.col("name") == "region"), n, "nation")
    return out.groupBy(F.regexp_extract("ctx_id", r"region\[(\d+)\]", 1).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("d19_predicate_exists", f"SELECT DISTINCT {_NP} AS node_id FROM {_GEO} WHERE c_mktsegment = 'BUILDING'")
def d19(s, d):
    n = _geo(s, d)
    ctx = R.context(n, F.col("name") == "nation")
    return R.where_exists(ctx, R.descendant(ctx, n, "c_mktsegment").where("canon = 'BUILDING'")).select("node_id")


@query("e11_not", f"SELECT {_CP} AS node_id FROM {_GEO} WHERE NOT c_mktsegment = 'BUILDING'")
def e11(s, d):
    n = _geo(s, d)
    ctx = R.context(n, F.col("name") == "customer")
    return R.where_exists(ctx, R.child(ctx, n, "c_mktsegment").where("canon = 'BUILDING'"), absent=True).select("node_id")


@query("d20_position", f"SELECT ctx_id, node_id FROM (SELECT {_NP} AS ctx_id, {_CP} AS node_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS p FROM {_GEO}) WHERE p <= 3")
def d20(s, d):
    n = _geo(s, d)
    return R.at_position(R.child(R.context(n, F.col("name") == "nation"), n, "customer"), 1, 3).select("ctx_id", "node_id")


@query("d20_last", f"SELECT {_NP} AS ctx_id, arg_max({_CP}, c_custkey) AS node_id FROM {_GEO} GROUP BY 1")
def d20b(s, d):
    n = _geo(s, d)
    return R.last(R.child(R.context(n, F.col("name") == "nation"), n, "customer")).select("ctx_id", "node_id")


@query("d22_union", f"SELECT {_CP} AS node_id FROM {_GEO} WHERE c_mktsegment = 'BUILDING' OR c_custkey < 100")
def d22(s, d):
    n = _geo(s, d)
    ctx = R.context(n, F.col("name") == "customer")
    one = R.where_exists(ctx, R.child(ctx, n, "c_mktsegment").where("canon = 'BUILDING'"))
    return R.union(one, ctx.where(F.regexp_extract("node_id", r"customer\[(\d+)\]", 1).cast("int") < 100)).select("node_id")


@query("d5_trim", f"SELECT {_CP} AS node_id FROM {_GEO} WHERE n_nationkey = 3 UNION ALL SELECT {_CP} || '/c_name' FROM {_GEO} WHERE n_nationkey = 3 UNION ALL SELECT {_CP} || '/c_mktsegment' FROM {_GEO} WHERE n_nationkey = 3 UNION ALL SELECT {_CP} || '/c_acctbal' FROM {_GEO} WHERE n_nationkey = 3 UNION ALL SELECT '/region[' || n_regionkey || ']/nation[3]' FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '/region[' || n_regionkey || ']/nation[3]/n_name' FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '/region[' || n_regionkey || ']' FROM nation WHERE n_nationkey = 3")
def d5(s, d):
    n = _geo(s, d)
    return R.trim(n, n.where("name = 'nation' AND node_id LIKE '%/nation[3]'")).select("node_id")


@query("i6_remove", f"SELECT {_CP} AS node_id FROM {_GEO} WHERE n_regionkey <> 1")
def i6(s, d):
    n = _geo(s, d)
    return R.remove(n, n.where("name = 'region' AND node_id = '/region[1]'")).where("name = 'customer'").select("node_id")


@query("e1_count", f"SELECT {_NP} AS ctx_id, count(*) AS n FROM {_GEO} GROUP BY 1")
def e1(s, d):
    n = _geo(s, d)
    ctx = R.context(n, F.col("name") == "nation")
    return R.count(ctx, R.child(ctx, n, "customer")).select("ctx_id", "n")


def _orders(s: SparkSession, d: str) -> DataFrame:
    """Nodes of customer/order, each order with its price and its customer."""
    path = [("customer", "o_custkey"), ("order", "o_orderkey")]
    return R.shred(_t(s, d, "orders"), F.lit("sales"), path, ["o_totalprice", "o_custkey"])


@query("e2_sum", "SELECT '/customer[' || c_custkey || ']' AS ctx_id, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def e2(s, d):
    nodes = _orders(s, d).unionByName(R.shred(_t(s, d, "customer"), F.lit("sales"), [("customer", "c_custkey")], []))
    ctx = R.context(nodes, F.col("name") == "customer")
    prices = R.descendant(ctx, nodes, "o_totalprice", single=True)
    return R.total(ctx, prices).select("ctx_id", F.round("total", 2).alias("total"))



@query("e15_rounding", "SELECT c_custkey, trunc(c_acctbal) + 0.0 AS f, CASE WHEN trunc(c_acctbal) = c_acctbal THEN c_acctbal ELSE trunc(c_acctbal) + 1 END AS c, trunc(c_acctbal + 0.5) + 0.0 AS r FROM customer")
def e15(s, d):
    b = F.col("c_acctbal")
    return _t(s, d, "customer").select("c_custkey", (X.floor(b) + 0.0).alias("f"), X.ceiling(b).alias("c"), (X.round_(b) + 0.0).alias("r"))


@query("e18_strings", "SELECT p_partkey, p_brand || '/' || p_type AS joined, contains(p_type, 'BRASS') AS has, starts_with(p_type, 'STANDARD') AS starts, substr(p_name, 2, 4) AS part, CASE WHEN strpos(p_brand, '#') > 0 THEN substr(p_brand, 1, strpos(p_brand, '#') - 1) ELSE '' END AS before, CASE WHEN strpos(p_brand, '#') > 0 THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END AS after, strlen(p_name)::INT AS bytes, translate(p_type, 'AEIOU', 'aeiou') AS vowels FROM part")
def e18(s, d):
    c = F.col
    return _t(s, d, "part").select(
        "p_partkey", X.concat(c("p_brand"), F.lit("/"), c("p_type")).alias("joined"), X.contains(c("p_type"), F.lit("BRASS")).alias("has"),
        X.starts_with(c("p_type"), F.lit("STANDARD")).alias("starts"), X.substring(c("p_name"), F.lit(2.0), F.lit(4.0)).alias("part"),
        X.substring_before(c("p_brand"), F.lit("#")).alias("before"), X.substring_after(c("p_brand"), F.lit("#")).alias("after"),
        X.string_length(c("p_name")).alias("bytes"), X.translate(c("p_type"), "AEIOU", "aeiou").alias("vowels"),
    )


@query("e27_re_match", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, 'Customer#[0-9]*[02468]')")
def e27(s, d):
    return _t(s, d, "customer").where(X.re_match(F.col("c_name"), r"Customer#\d*[0-9-[13579]]")).select("c_custkey")


@query("e29_deref", "SELECT '/customer[' || o_custkey || ']/order[' || o_orderkey || ']/o_custkey' AS ctx_id, '/customer[' || c_custkey || ']/c_custkey' AS node_id FROM orders JOIN customer ON o_custkey = c_custkey")
def e29(s, d):
    refs = R.context(_orders(s, d), F.col("name") == "o_custkey")
    keys = R.shred(_t(s, d, "customer"), F.lit("sales"), [("customer", "c_custkey")], ["c_custkey"]).where("name = 'c_custkey'")
    # The same customers in another tree are no targets.
    other = keys.withColumn("tree_id", F.lit("archive"))
    return R.deref(refs, keys.unionByName(other)).select("ctx_id", "node_id")



@query("e32_enum_value", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 2.0 ELSE 3.0 END AS v FROM orders")
def e32(s, d):
    return _t(s, d, "orders").select("o_orderkey", X.enum_value(F.col("o_orderstatus"), {"F": 1, "O": 2, "P": 3}).alias("v"))


@query("d24_existential_less", "SELECT DISTINCT c_custkey FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_acctbal < s_acctbal")
def d24(s, d):
    # An existential comparison with a set holds if it holds for its greatest number, so no pairs are formed.
    most = _t(s, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("m"))
    both = _t(s, d, "customer").join(most, F.col("c_nationkey") == F.col("s_nationkey"))
    return both.where(X.compare(F.col("c_acctbal"), "<", F.col("m"))).select("c_custkey")



# --- types

@query("g1_store_integer", "SELECT l_orderkey, l_linenumber, l_quantity::INT::VARCHAR AS canon FROM lineitem WHERE l_quantity BETWEEN 1 AND 20")
def g1(s, d):
    v = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", Y.store_integer(F.col("l_quantity").cast("int").cast("string"), "uint8", [(1, 20)]).alias("v"))
    return v.where("v.ok").select("l_orderkey", "l_linenumber", F.col("v.canon").alias("canon"))


@query("g3_length_pattern", "SELECT p_partkey FROM part WHERE length(p_type) BETWEEN 5 AND 18 AND regexp_full_match(p_type, '[A-Z ]+')")
def g3(s, d):
    return _t(s, d, "part").where(Y.store_string(F.col("p_type"), [(5, 18)], [("[A-Z ]+", True)])["ok"]).select("p_partkey")


@query("g9_type_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS pos FROM customer")
def g9(s, d):
    key = Y.sort_key((-F.col("c_custkey")).cast("string"), "int64")
    return Y.ranked(_t(s, d, "customer").select("c_custkey"), key)


@query("g9_decimal_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS pos FROM supplier")
def g9b(s, d):
    key = F.concat(Y.sort_key(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), "decimal64"), Y.sort_key(F.col("s_suppkey").cast("string"), "int64"))
    return Y.ranked(_t(s, d, "supplier").select("s_suppkey", "s_acctbal"), key).select("s_suppkey", "pos")



# --- validation

@query("h3_duplicate_keys", "SELECT 'duplicate' AS rule, '/lineitem[l_orderkey=''' || l_orderkey || '''][l_linenumber=''' || l_linenumber || ''']' AS path, count(*) || ' instances' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def h3(s, d):
    return V.duplicate_keys(_t(s, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


@query("h10_must", "SELECT 'must-violation' AS rule, '/customer[c_custkey=''' || c_custkey || ''']' AS path, 'must condition is false' AS message FROM customer WHERE NOT c_acctbal >= 0")
def h10(s, d):
    return V.must(_t(s, d, "customer"), "customer", ["c_custkey"], F.col("c_acctbal") >= 0)


@query("h9_when_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority FROM orders")
def h9(s, d):
    return V.drop_when_false(_t(s, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderpriority")


@query("h11_leafref_require_instance", "SELECT 'instance-required' AS rule, '/supplier[s_suppkey=''' || s_suppkey || ''']' AS path, 's_suppkey refers to ' || s_suppkey AS message FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 3 <> 0)")
def h11(s, d):
    return V.leafref(_t(s, d, "supplier"), "supplier", ["s_suppkey"], "s_suppkey", _t(s, d, "lineitem").where("l_suppkey % 3 <> 0"), "l_suppkey")


@query("h15_mandatory", "SELECT 'missing-leaf' AS rule, '/documents[doc_id=''' || d.doc_id || ''']' AS path, 'mandatory quality is absent' AS message FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def h15(s, d):
    docs = _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels"), "doc_id", "left")
    return V.mandatory(docs, "documents", ["doc_id"], "quality")


@query("h16_min_max_elements", "SELECT CASE WHEN n > 15 THEN 'too-many-elements' ELSE 'too-few-elements' END AS rule, '/customer[c_custkey=''' || c_custkey || ''']' AS path, n || ' entries' AS message FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) WHERE n > 15 OR n < 5")
def h16(s, d):
    return V.element_counts(_t(s, d, "customer"), "customer", ["c_custkey"], _t(s, d, "orders"), ["o_custkey"], 5, 15)


@query("h17_unique", "SELECT 'data-not-unique' AS rule, '/part[p_brand=''' || p_brand || '''][p_type=''' || p_type || '''][p_size=''' || p_size || ''']' AS path, count(*) || ' entries' AS message FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1")
def h17(s, d):
    return V.unique(_t(s, d, "part"), "part", ["p_brand", "p_type", "p_size"])


@query("h5_choice", "SELECT 'choice' AS rule, '/orders[o_orderkey=''' || o_orderkey || ''']' AS path, '2 cases present' AS message FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def h5(s, d):
    o = _t(s, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 1000, 1).alias("big"), F.when(F.col("o_orderstatus") == "F", 1).alias("done"))
    return V.choice(o, "orders", ["o_orderkey"], {"a": ["big"], "b": ["done"]})


@query("h6_defaults", "SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic, l.toxic IS NULL AS toxic_default FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def h6(s, d):
    docs = _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels"), "doc_id", "left")
    return V.defaults(docs, {"toxic": 0}).select("doc_id", "toxic", "toxic_default")


@query("c14_with_defaults_trim", "SELECT doc_id, nullif(toxic, 0) AS toxic FROM labels")
def c14(s, d):
    return V.with_defaults(_t(s, d, "labels"), {"toxic": 0}, "trim").select("doc_id", "toxic")


@query("h22_leafref_links", "SELECT l_orderkey, l_linenumber, p_partkey AS target FROM lineitem JOIN part ON l_partkey = p_partkey")
def h22(s, d):
    return V.leafref_links(_t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", _t(s, d, "part"), "p_partkey")


@query("a22_identity_closure", "WITH RECURSIVE e AS (SELECT 'any' AS base, 'r' || r_regionkey AS derived FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation), c AS (SELECT * FROM e UNION SELECT c.base, e.derived FROM c JOIN e ON c.derived = e.base) SELECT * FROM c")
def a22(s, d):
    r = _t(s, d, "region").select(F.lit("any").alias("base"), F.concat(F.lit("r"), "r_regionkey").alias("derived"))
    n = _t(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("base"), F.concat(F.lit("n"), "n_nationkey").alias("derived"))
    return V.identity_closure(r.unionByName(n))


# --- differences

_LEAVES = ["o_orderstatus", "o_totalprice"]


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = _t(s, d, "orders").select("o_orderkey", *_LEAVES)
    b = a.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    extra = a.where("o_orderkey % 11 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return a, b.unionByName(extra)


_B = "b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 = 0)"


@query("f1_diff", f"WITH {_B} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'create' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'replace' END AS op, b.o_orderstatus, b.o_totalprice, a.o_orderstatus AS orig_o_orderstatus, a.o_totalprice AS orig_o_totalprice FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice")
def f1(s, d):
    return D.diff(*_two(s, d), ["o_orderkey"], _LEAVES)


@query("f7_apply_diff", f"WITH {_B} SELECT * FROM b")
def f7(s, d):
    a, b = _two(s, d)
    return D.apply_diff(a, D.diff(a, b, ["o_orderkey"], _LEAVES), ["o_orderkey"], _LEAVES)


@query("f12_reverse_diff", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def f12(s, d):
    a, b = _two(s, d)
    back = D.reverse(D.diff(a, b, ["o_orderkey"], _LEAVES), ["o_orderkey"], _LEAVES)
    return D.apply_diff(b, back, ["o_orderkey"], _LEAVES)


@query("f9_merge_diff", "SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def f9(s, d):
    a, b = _two(s, d)
    c = a.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    k = ["o_orderkey"]
    return D.apply_diff(a, D.merge_diffs(D.diff(a, b, k, _LEAVES), D.diff(b, c, k, _LEAVES), k, _LEAVES), k, _LEAVES)


@query("f3_bag_difference", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f3(s, d):
    items = D.with_occurrence(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    once = items.where("occ = 1")
    gone = D.diff(items, once, ["l_orderkey", "l_linenumber", "occ"], [])
    return gone.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("f5_user_order_anchor", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS anchor FROM conversations")
def f5(s, d):
    return D.move_anchors(_t(s, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", "turn")


@query("i7_merge_trees", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def i7(s, d):
    base = _t(s, d, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return D.merge_trees(base, _t(s, d, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"])


# --- sources and streams

@query("c1_parse_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def c1(s, d):
    return C.parse_json(_t(s, d, "events"), "props", "k string").select("event_id", F.col("data.k").alias("k"))


@query("c12_print_json", "SELECT r_regionkey, to_json({r_regionkey: r_regionkey, r_name: r_name})::VARCHAR AS line FROM region")
def c12(s, d):
    return _t(s, d, "region").select("r_regionkey", C.print_json(["r_regionkey", "r_name"]).alias("line"))


@query("s1_notification_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def s1(s, d):
    out = S.windowed_counts(_t(s, d, "events"), "ts", "event_type")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("s2_fold_changes", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> (SELECT min(event_type) FROM events)")
def s2(s, d):
    e = _t(s, d, "events")
    least = e.agg(F.min("event_type").alias("m"))
    log = e.crossJoin(F.broadcast(least)).withColumn("op", F.when(F.col("event_type") == F.col("m"), "delete").otherwise("create"))
    return S.fold(log, ["user_id"], ["value"], "event_id")


# --- edits, moves, functions of names and values, further checks

@query("d6_find", "SELECT '/region[1]/nation[1]' AS node_id, 'list' AS kind")
def d6(s, d):
    return R.find(_geo(s, d), "/region[1]/nation[1]").select("node_id", "kind")


@query("d9_self_text", "SELECT '/region[' || r_regionkey || ']/r_name' AS node_id, r_name AS canon FROM region")
def d9(s, d):
    n = _geo(s, d)
    return R.text(R.self_(R.child(R.context(n, F.col("name") == "region"), n), "r_name")).select("node_id", "canon")


@query("d14_sibling_counts", "SELECT n_nationkey AS k, row_number() OVER w - 1 AS before, count(*) OVER (PARTITION BY n_regionkey) - row_number() OVER w AS after FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def d14c(s, d):
    out = R.sibling_counts(_geo(s, d), "nation")
    return out.select(F.regexp_extract("node_id", r"nation\[(\d+)\]", 1).cast("int").alias("k"), "before", "after")


@query("d28_string_value", "SELECT '/region[' || r_regionkey || ']' AS node_id, '  ' || r_name AS value FROM region")
def d28(s, d):
    return R.string_value(R.shred(_t(s, d, "region"), F.lit("geo"), [("region", "r_regionkey")], ["r_name"])).select("node_id", "value")


@query("d26_arithmetic", "SELECT p_partkey, p_size % 7 AS m, -(p_size % 7) AS neg, p_retailprice / 4 AS q FROM part")
def d26(s, d):
    size = X.number(F.col("p_size").cast("string"))
    return _t(s, d, "part").select(
        "p_partkey", X.modulo(size, F.lit(7.0)).cast("int").alias("m"), X.modulo(-size, F.lit(7.0)).cast("int").alias("neg"), X.divide(F.col("p_retailprice"), F.lit(4.0)).alias("q")
    )


@query("d27_casts", "SELECT p_partkey, p_size::VARCHAR AS text, p_size <> 0 AS truth, length(p_name) > 0 AS named, true AS yes, false AS no FROM part")
def d27(s, d):
    size = X.number(F.col("p_size").cast("string"))
    return _t(s, d, "part").select("p_partkey", X.string(size).alias("text"), X.boolean(size).alias("truth"), X.truth(F.col("p_name")).alias("named"), X.true_().alias("yes"), X.false_().alias("no"))


@query("d25_canonical_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 7")
def d25(s, d):
    written = Y.store_decimal(F.concat(F.lit("+0"), F.col("l_quantity").cast("int").cast("string"), F.lit(".00")), 2)
    return _t(s, d, "lineitem").where(Y.same_value(written, Y.store_decimal(F.lit("7"), 2))).select("l_orderkey", "l_linenumber")


@query("e5_names", "SELECT DISTINCT event_type AS local, 'ev:' || event_type AS name, 'urn:example:ev' AS uri FROM events")
def e5(s, d):
    name = F.concat(F.lit("ev:"), "event_type")
    rows = _t(s, d, "events").select("event_type").distinct()
    return rows.select(X.local_name(name).alias("local"), X.qualified_name(F.col("event_type"), F.lit("ev")).alias("name"), X.namespace_uri(name, F.lit("ev"), {"ev": "urn:example:ev"}).alias("uri"))


@query("e14_lang", "SELECT doc_id FROM documents WHERE lang = 'en' OR lang LIKE 'en-%'")
def e14(s, d):
    return _t(s, d, "documents").where(X.lang_matches(F.col("lang"), "EN")).select("doc_id")


@query("e21_substring_bytes", "SELECT doc_id, CASE WHEN strlen(lang) > 1 THEN substr(lang, 2) ELSE '' END AS rest, '' AS nothing, lang AS whole, 'é' AS char FROM documents WHERE lang IS NOT NULL")
def e21(s, d):
    c, inf = F.col("lang"), F.lit(float("inf"))
    odd = X.substring(F.concat(F.lit("é"), c), F.lit(1.0), F.lit(2.0))
    return _t(s, d, "documents").where("lang IS NOT NULL").select(
        "doc_id", X.substring(c, F.lit(2.0)).alias("rest"), X.substring(c, F.lit(X.NAN)).alias("nothing"), X.substring(c, F.lit(-5.0), inf).alias("whole"), odd.alias("char")
    )


@query("e25_normalize_space", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS line FROM documents WHERE text IS NOT NULL")
def e25(s, d):
    return _t(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.normalize_space(F.col("text")).alias("line"))


@query("e30_derived_from", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def e30(s, d):
    c = _t(s, d, "customer").withColumn("kind", F.concat(F.lit("n"), "c_nationkey"))
    return V.derived_from(c, "kind", a22(s, d), "r2").select("c_custkey")


@query("e31_derived_from_or_self", "SELECT 'r2' AS kind UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 2")
def e31(s, d):
    kinds = a22(s, d).select(F.col("derived").alias("kind")).distinct()
    return V.derived_from(kinds, "kind", a22(s, d), "r2", or_self=True)


@query("e33_bit_is_set", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'PROMO')")
def e33(s, d):
    return _t(s, d, "part").where(X.bit_is_set(F.split("p_type", " "), "PROMO")).select("p_partkey")


@query("g6_pattern_anchors", "SELECT p_partkey, false AS anchored, true AS plain, p_size % 2 = 1 AS odd FROM part")
def g6(s, d):
    last = X.re_match(F.col("p_size").cast("string"), r"\d*[\d-[02468]]")
    return _t(s, d, "part").select("p_partkey", X.re_match(F.col("p_name"), "^.*$").alias("anchored"), X.re_match(F.concat(F.lit("a^b$"), F.lit("x")), r"a^b$\w").alias("plain"), last.alias("odd"))


@query("g5_bad_values", "SELECT 'invalid-value' AS rule, '/part[p_partkey=''' || p_partkey || ''']' AS path, 'not a valid uint8' AS message FROM part WHERE p_size > 30")
def g5(s, d):
    return V.bad_values(_t(s, d, "part"), "part", ["p_partkey"], Y.store_integer(F.col("p_size").cast("string"), "uint8", [(0, 30)]))


@query("h4_missing_keys", "SELECT 'missing-key' AS rule, '/documents[source=''''][lang=''' || coalesce(lang, '') || ''']' AS path, 'list instance lacks its key' AS message FROM documents WHERE nullif(source, (SELECT min(source) FROM documents)) IS NULL")
def h4(s, d):
    docs = _t(s, d, "documents")
    least = docs.agg(F.min("source").alias("m"))
    docs = docs.join(F.broadcast(least), F.col("source") == F.col("m"), "left").withColumn("source", F.when(F.col("m").isNull(), F.col("source")))
    return V.missing_keys(docs, "documents", ["source", "lang"])


@query("h7_drop_superseded", "SELECT user_id, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id FROM events WHERE event_type <> 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def h7(s, d):
    rows = _t(s, d, "events").select("user_id", "event_id", (F.col("event_type") != "click").alias("is_default"))
    return V.drop_superseded(rows, ["user_id"], "is_default").select("user_id", "event_id")


@query("h12_instance_required", "SELECT 'instance-required' AS rule, '/supplier[s_suppkey=''' || s_suppkey || ''']' AS path, 'home names no node: /region[1]/nation[' || s_nationkey || ']' AS message FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def h12(s, d):
    sup = _t(s, d, "supplier").withColumn("home", F.concat(F.lit("/region[1]/nation["), F.col("s_nationkey").cast("string"), F.lit("]")))
    return V.instance_required(sup, "supplier", ["s_suppkey"], "home", _geo(s, d).where("name = 'nation'"))


@query("h13_union_resolution", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) THEN 'small' WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) THEN 'medium' ELSE 'number' END AS member FROM lineitem")
def h13(s, d):
    part = _t(s, d, "part")
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("ref"))
    out = V.resolve_union(rows, "ref", {"small": (part.where("p_size < 10"), "p_partkey"), "medium": (part.where("p_size < 20"), "p_partkey")}, "number")
    return out.select("l_orderkey", "l_linenumber", F.col("ref_member").alias("member"))


@query("h18_unexpected_state", "SELECT 'unexpected-state' AS rule, '/labels[doc_id=''' || doc_id || ''']' AS path, 'state node toxic is present' AS message FROM labels WHERE toxic IS NOT NULL")
def h18(s, d):
    return V.unexpected(_t(s, d, "labels"), "labels", ["doc_id"], {"toxic": "state"})


@query("h19_obsolete", "SELECT 'obsolete' AS rule, '/labels[doc_id=''' || doc_id || ''']' AS path, 'quality is obsolete' AS message FROM labels WHERE quality IS NOT NULL")
def h19(s, d):
    return V.obsolete(_t(s, d, "labels"), "labels", ["doc_id"], ["quality"])


@query("f13_validation_diff", "SELECT d.doc_id, 'replace' AS op, 0 AS toxic, NULL::INT AS orig_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL")
def f13(s, d):
    given = _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id", "left")
    return D.diff(given, V.defaults(given, {"toxic": 0}), ["doc_id"], ["toxic"]).select("doc_id", "op", F.col("toxic").cast("int").alias("toxic"), F.col("orig_toxic").cast("int").alias("orig_toxic"))


@query("f2_subtree_diff", f"WITH {_B} SELECT a.o_orderkey, 'replace' AS op FROM orders a JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey <= 100 AND a.o_orderstatus <> b.o_orderstatus UNION ALL SELECT o_orderkey, 'delete' FROM orders WHERE o_orderkey <= 100 AND o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'create' FROM b WHERE o_orderkey < 0")
def f2(s, d):
    a, b = (x.where("o_orderkey <= 100") for x in _two(s, d))
    return D.diff(a, b, ["o_orderkey"], _LEAVES).select("o_orderkey", "op")


_META = ["event_id", "annotation"]


@query("f6_metadata_diff", "SELECT event_id, '@k' AS annotation, CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'replace' END AS op FROM events WHERE event_id % 2 = 0")
def f6(s, d):
    e = _t(s, d, "events").select("event_id", F.lit("@k").alias("annotation"), F.get_json_object("props", "$.k").alias("value"))
    new = e.where("event_id % 4 <> 0").withColumn("value", F.when(F.col("event_id") % 2 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return D.diff(e, new, _META, ["value"]).select(*_META, "op")


@query("f8_apply_metadata", "SELECT event_id, '@k' AS annotation, json_extract_string(props, '$.k') || CASE WHEN event_id % 2 = 0 THEN '!' ELSE '' END AS value FROM events WHERE event_id % 4 <> 0")
def f8(s, d):
    e = _t(s, d, "events").select("event_id", F.lit("@k").alias("annotation"), F.get_json_object("props", "$.k").alias("value"))
    new = e.where("event_id % 4 <> 0").withColumn("value", F.when(F.col("event_id") % 2 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return D.apply_diff(e, D.diff(e, new, _META, ["value"]), _META, ["value"])


@query("f7_conflicts", f"WITH {_B} SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders) THEN 'create' ELSE 'replace' END AS op FROM b")
def f7b(s, d):
    a, b = _two(s, d)
    there = F.col("o_orderkey") >= 0
    log = b.withColumn("op", F.when(there, "create").otherwise("replace"))
    return D.conflicts(a, log, ["o_orderkey"]).select("o_orderkey", "op")


@query("i2_upsert", f"WITH {_B} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, CASE WHEN b.o_orderkey IS NULL THEN 'kept' WHEN a.o_orderkey IS NULL THEN 'created' WHEN a.o_orderstatus = b.o_orderstatus THEN 'same' ELSE 'changed' END AS done FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def i2(s, d):
    a, b = _two(s, d)
    return D.upsert(a, b, ["o_orderkey"], ["o_orderstatus"])


_MOVED = "m AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL), o AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS pos FROM m), x AS (SELECT *, max(pos) OVER (PARTITION BY l_orderkey) AS top FROM o)"


def _ordered(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _t(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("at"))
    return rows.select("l_orderkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("at", "l_suppkey")).alias("pos"))


def _last_to_front(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("l_orderkey").agg(F.max_by("l_suppkey", "pos").alias("l_suppkey"))
    return last.select("l_orderkey", "l_suppkey", F.lit(None).cast("long").alias("anchor"))


@query("i5_move_to_front", f"WITH {_MOVED} SELECT l_orderkey, l_suppkey, CASE WHEN pos = top THEN 1 ELSE pos + 1 END AS pos FROM x")
def i5(s, d):
    rows = _ordered(s, d)
    return D.move(rows, ["l_orderkey"], "l_suppkey", "pos", _last_to_front(rows))


@query("f5_moves_replayed", f"WITH {_MOVED} SELECT l_orderkey, l_suppkey, CASE WHEN pos = 1 THEN top ELSE pos - 1 END AS pos FROM x")
def f5b(s, d):
    # The first entry goes behind the last one; the difference of both orders, replayed, gives the new order.
    rows = _ordered(s, d)
    ends = rows.groupBy("l_orderkey").agg(F.min_by("l_suppkey", "pos").alias("l_suppkey"), F.max_by("l_suppkey", "pos").alias("anchor"))
    return D.move(rows, ["l_orderkey"], "l_suppkey", "pos", ends.where("l_suppkey <> anchor"))


@query("f5_moves_between", f"WITH {_MOVED} SELECT l_orderkey, count(*) AS n FROM x WHERE top > 1 AND (pos = top OR pos = 1) GROUP BY 1")
def f5c(s, d):
    rows = _ordered(s, d)
    moved = D.move(rows, ["l_orderkey"], "l_suppkey", "pos", _last_to_front(rows))
    return D.moves_between(rows, moved, ["l_orderkey"], "l_suppkey", "pos").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("c4_opaque_members", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def c4(s, d):
    out = C.parse_json(_t(s, d, "events"), "props", "other string", "opaque")
    return out.select("event_id", F.col("opaque")["k"].alias("k")).where("k IS NOT NULL")


@query("c12_print_nested", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def c12b(s, d):
    nation = _t(s, d, "nation").withColumn("r_regionkey", F.col("n_regionkey"))
    out = C.print_nested(_t(s, d, "region"), nation, ["r_regionkey"], ["n_nationkey", "n_name"], "nation", "n_nationkey")
    lines = out.select("r_regionkey", C.print_json(["r_regionkey", "r_name", "nation"]).alias("line"))
    # Read back from the printed line, so that the nested list is what is compared.
    back = C.parse_json(lines, "line", "nation array<struct<n_nationkey:int,n_name:string>>")
    return back.select("r_regionkey", F.concat_ws(",", F.col("data.nation.n_name")).alias("names"))


@query("c13_xml_round_trip", "SELECT n_nationkey, n_name FROM nation")
def c13(s, d):
    lines = _t(s, d, "nation").select(C.print_xml(["n_nationkey", "n_name"]).alias("line"))
    return C.parse_xml(lines, "line", "n_nationkey int, n_name string").select("data.n_nationkey", "data.n_name")


@query("c14_with_defaults_modes", "SELECT d.doc_id, l.toxic AS explicit, coalesce(l.toxic, 0) = 0 AS tagged, coalesce(l.toxic, 0) AS everything FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def c14b(s, d):
    both = _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    full = V.defaults(both, {"toxic": 0})
    modes = full.withColumn("everything", F.col("toxic"))
    tagged = V.with_defaults(modes, {"toxic": 0}, "report-all-tagged").withColumn("tagged", F.col("toxic_tagged"))
    return V.with_defaults(tagged, {"toxic": 0}, "explicit").select("doc_id", F.col("toxic").alias("explicit"), "tagged", "everything")


@query("c10_event_time", "SELECT event_id, ts AS event_time FROM events")
def c10(s, d):
    stamped = _t(s, d, "events").select("event_id", F.to_json(F.struct(F.struct(F.col("ts").cast("string").alias("eventTime")).alias("notification"))).alias("line"))
    out = C.event_time(stamped.withColumn("stamp", C.unwrap(F.col("line"), "notification.eventTime")), "stamp")
    return out.select("event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


# --- edits, copies, annotations, what expressions see


def _notes(s: SparkSession, d: str) -> DataFrame:
    """Annotations on customers: their segment under the name of "segment"."""
    leaves = _geo(s, d).where("name = 'c_mktsegment'")
    return leaves.select("tree_id", F.col("parent_id").alias("node_id"), F.lit("segment").alias("annotation"), F.col("canon").alias("value"))


@query("d16_axis_attribute", f"SELECT {_CP} AS ctx_id, c_mktsegment AS value FROM {_GEO}")
def d16(s, d):
    return R.attribute(R.context(_geo(s, d), F.col("name") == "customer"), _notes(s, d), "segment").select("ctx_id", "value")


@query("d29_accessible_tree", f"SELECT {_CP} || '/' || x AS node_id FROM {_GEO} CROSS JOIN (VALUES ('c_name'), ('c_mktsegment')) v(x) WHERE n_regionkey <> 1")
def d29(s, d):
    nodes = _geo(s, d)
    return R.accessible(nodes, ["c_acctbal"], when_false=nodes.where("node_id = '/region[1]'")).where("kind = 'leaf' AND parent_id LIKE '%customer%'").select("node_id")


@query("i3_new_terms", f"SELECT {_CP} || '/c_rank' AS node_id, 'new' AS canon FROM {_GEO} UNION ALL SELECT {_CP} || '/c_name', c_name FROM {_GEO}")
def i3(s, d):
    nodes = _geo(s, d)
    homes = nodes.where("name = 'customer'")
    made = E.term(homes, "c_rank", F.lit("new"), 3).unionByName(E.term(homes, "c_name", F.lit("not taken")))
    return E.add(nodes, made).where("name IN ('c_rank', 'c_name')").select("node_id", "canon")


@query("i4_set_value", f"SELECT {_CP} || '/c_mktsegment' AS node_id, 'BUILDING' AS canon, c_mktsegment <> 'BUILDING' AS changed FROM {_GEO} WHERE n_regionkey = 2 UNION ALL SELECT {_CP} || '/c_mktsegment', c_mktsegment, false FROM {_GEO} WHERE n_regionkey <> 2")
def i4(s, d):
    nodes = _geo(s, d)
    values = nodes.where("name = 'c_mktsegment' AND anc_ids[0] = '/region[2]'").select("tree_id", "node_id", F.lit("BUILDING").alias("canon"))
    return E.set_value(nodes, values).where("name = 'c_mktsegment'").select("node_id", "canon", "changed")


@query("i8_duplicate", f"SELECT {_NP} AS tree_id, {_CP} AS node_id, 1 AS depth, {_NP} AS parent_id FROM {_GEO} UNION ALL SELECT {_NP}, {_NP}, 0, NULL FROM nation JOIN region ON n_regionkey = r_regionkey")
def i8(s, d):
    nodes = _geo(s, d)
    out = E.duplicate(nodes, nodes.where("name = 'nation'"), F.col("root_id")).where("kind = 'list'")
    return out.select("tree_id", "node_id", F.size("anc_ids").alias("depth"), "parent_id")


@query("i9_metadata_edit", f"SELECT {_CP} AS node_id, CASE WHEN n_regionkey = 0 THEN 'set' ELSE c_mktsegment END AS value FROM {_GEO} WHERE n_regionkey <> 3")
def i9(s, d):
    notes = _notes(s, d)
    given = notes.where("node_id LIKE '/region[0]%'").withColumn("value", F.lit("set"))
    return E.drop_annotations(E.annotate(notes, given), notes.where("node_id LIKE '/region[3]%'"), "segment").select("node_id", "value")


@query("i10_preorder", f"SELECT node_id, row_number() OVER (ORDER BY r, n, c) AS pos FROM (SELECT {_CP} AS node_id, r_regionkey AS r, n_nationkey AS n, c_custkey AS c FROM {_GEO} UNION ALL SELECT {_NP}, r_regionkey, n_nationkey, -1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '/region[' || r_regionkey || ']', r_regionkey, -1, -1 FROM region)")
def i10(s, d):
    return E.preorder(_geo(s, d).where("kind = 'list'")).select("node_id", "pos")


@query("i10_children_no_keys", f"SELECT {_CP} AS ctx_id, x AS name FROM {_GEO} CROSS JOIN (VALUES ('c_mktsegment'), ('c_acctbal')) v(x)")
def i10b(s, d):
    nodes = _geo(s, d)
    return E.children_no_keys(R.child(R.context(nodes, F.col("name") == "customer"), nodes), ["c_name"]).select("ctx_id", "name")


@query("i12_sorted_runs", "SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber) AS pos FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem)")
def i12(s, d):
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    nodes = rows.select("*", F.lit("bag").alias("tree_id"), F.col("l_orderkey").cast("string").alias("parent_id"), F.format_string("%06d", "l_linenumber").alias("node_id"), F.lit("supp").alias("name"), F.col("l_suppkey").cast("string").alias("canon"))
    return E.sorted_runs(nodes, "supp", "uint32").select("l_orderkey", "l_linenumber", "l_suppkey", "pos")


@query("g11_node_comparison", "SELECT '/region[' || n_regionkey || ']/nation[' || n_nationkey || ']' AS node_id, count(c_custkey) = 0 AS equal FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 20 = 0 AND c_mktsegment <> 'X' GROUP BY ALL")
def g11(s, d):
    nodes = _geo(s, d)
    key = F.regexp_extract("node_id", r"/customer\[([0-9]+)\]", 1).try_cast("bigint")
    changed = nodes.withColumn("canon", F.when((F.col("name") == "c_mktsegment") & (key % 20 == 0), "X").otherwise(F.col("canon")))
    return E.equal_subtrees(nodes, changed).where(r"node_id RLIKE '/nation\\[[0-9]+\\]$'").select("node_id", "equal")


@query("g1_ipv4_prefix", "SELECT s_suppkey, '10.' || (s_suppkey % 256) || '.' || ((s_nationkey * 7) % 16 * 16) || '.0/20' AS canon, s_nationkey >= 5 AS ok FROM supplier WHERE s_nationkey >= 5 UNION ALL SELECT s_suppkey, NULL, false FROM supplier WHERE s_nationkey < 5")
def g1b(s, d):
    third = (F.col("s_nationkey") * 7) % 16 * 16 + F.col("s_suppkey") % 16
    text = F.concat(F.lit("10."), (F.col("s_suppkey") % 256).cast("string"), F.lit("."), third.cast("string"), F.when(F.col("s_nationkey") < 5, ".300/20").otherwise(".9/20"))
    out = _t(s, d, "supplier").select("s_suppkey", Y.store_ipv4_prefix(text).alias("v"))
    return out.select("s_suppkey", "v.canon", "v.ok")


@query("g1_date_and_time", "SELECT event_id, event_id % 3 <> 0 AS ok, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS canon FROM events")
def g1c(s, d):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, " UTC").otherwise("Z"))
    return _t(s, d, "events").select("event_id", Y.store_date_and_time(stamp).alias("v")).select("event_id", "v.ok", "v.canon")


@query("c9_xml_envelopes", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'rpc' WHEN 1 THEN 'rpc-reply' ELSE 'notification' END AS op_kind, CASE WHEN event_id % 3 < 2 THEN event_id::VARCHAR END AS message_id, event_id % 3 = 1 AS ok, CASE WHEN event_id % 3 <> 1 THEN event_type END AS body_name, CASE WHEN event_id % 3 = 2 THEN '2024-01-01T00:00:00Z' END AS stamp FROM events")
def c9(s, d):
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    line = (
        F.when(F.col("event_id") % 3 == 0, F.format_string('<rpc message-id="%s" xmlns="urn:x"><%s/></rpc>', n, kind))
        .when(F.col("event_id") % 3 == 1, F.format_string('<rpc-reply message-id="%s" xmlns="urn:x"><ok/></rpc-reply>', n))
        .otherwise(F.format_string('<notification xmlns="urn:x"><eventTime>2024-01-01T00:00:00Z</eventTime><%s/></notification>', kind))
    )
    return C.open_xml(_t(s, d, "events").select("event_id", line.alias("line")), "line").drop("line")


@query("c9_json_envelopes", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'input' END AS op_kind, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind FROM events")
def c9b(s, d):
    body = F.to_json(F.struct(F.col("event_type").alias("kind")))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"a":1,"b":'), body, F.lit("}"))).otherwise(F.concat(F.lit('{"ev:input":'), body, F.lit("}")))
    out = C.open_json(_t(s, d, "events").select("event_id", line.alias("line")), "line")
    return out.select("event_id", "op_kind", F.get_json_object("body", "$.kind").alias("kind"))


@query("c15_reprefix", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'p:' ELSE 'other:' END || p_brand AS name FROM part")
def c15(s, d):
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "parts:").otherwise("other:"), F.col("p_brand"))
    return _t(s, d, "part").select("p_partkey", C.reprefix(name, {"parts": "p"}).alias("name"))


@query("h14_metadata_references", f"SELECT 'instance-required' AS rule, '/notes[node_id=''' || {_CP} || ''']' AS path, 'value names no node: /region[' || (r_regionkey + 3) || ']' AS message FROM {_GEO} WHERE r_regionkey > 1")
def h14(s, d):
    nodes = _geo(s, d)
    region = F.regexp_extract("node_id", r"^/region\[([0-9]+)\]", 1).cast("int")
    notes = _notes(s, d).withColumn("value", F.concat(F.lit("/region["), (region + 3).cast("string"), F.lit("]")))
    return V.instance_required(notes, "notes", ["node_id"], "value", nodes.where("name = 'region'"))


@query("h20_operation_references", "SELECT 'instance-required' AS rule, '/orders[o_orderkey=''' || o_orderkey || ''']' AS path, 'o_custkey refers to ' || o_custkey AS message FROM orders WHERE o_orderkey % 10 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND o_custkey % 10 <> 5")
def h20(s, d):
    # The operation's own entries and the datastore's are one tree for its references; only the operation is reported.
    op = _t(s, d, "orders").where("o_orderkey % 10 = 0")
    store = _t(s, d, "customer").where("c_custkey % 2 = 0").select("c_custkey")
    brought = op.where("o_custkey % 10 = 5").select(F.col("o_custkey").alias("c_custkey"))
    return V.leafref(op, "orders", ["o_orderkey"], "o_custkey", store.unionByName(brought), "c_custkey")


@query("f10_merge_subtree_diff", "SELECT o_orderkey, 'replace' AS op, o_totalprice + 3 AS o_totalprice FROM orders WHERE o_orderkey <= 200")
def f10(s, d):
    a = _t(s, d, "orders").select("o_orderkey", *_LEAVES)
    b, c = (a.withColumn("o_totalprice", F.col("o_totalprice") + n) for n in (1, 3))
    first, second = (D.diff(x, y, ["o_orderkey"], _LEAVES).where("o_orderkey <= 200") for x, y in ((a, b), (b, c)))
    return D.merge_diffs(first, second, ["o_orderkey"], _LEAVES).select("o_orderkey", "op", "o_totalprice")


# Queries on whole trees register themselves.
from sylva.plans import checks as _checks  # noqa: E402, F401
from sylva.plans import trees as _trees  # noqa: E402, F401
