"""Composed rules, diagnostics and helpers over facts: nations are modules, customers their items, orders what these hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import advice as A, diagnostics as D, findings as N, rules as O, signal as S
from ..sources import documents as L
from . import advice as _advice, cohesion as _cohesion, read


def _key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def _pick(column: str, modulus: int, *values):
    """The value at a key modulo ``modulus``; the last one stands for the rest."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col(column) % modulus == i, F.lit(v)).otherwise(out)
    return out


def _tree(spark, d):
    nations = read(spark, d, "nation").select(_key("n", "n_nationkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    customers = read(spark, d, "customer").select(_key("c", "c_custkey").alias("node"), _key("n", "c_nationkey").alias("parent"))
    orders = read(spark, d, "orders").select(_key("o", "o_orderkey").alias("node"), _key("c", "o_custkey").alias("parent"))
    return nations.unionByName(customers).unionByName(orders)


def _ancestors(spark, d):
    _cohesion._checkpoints(spark)
    return O.enclosing(_tree(spark, d))


def _items(spark, d):
    """Attributes of customers and nations; every fifth customer is ``main``."""
    c = read(spark, d, "customer").select(_key("c", "c_custkey").alias("node"), F.when(F.col("c_custkey") % 5 == 0, "main").otherwise(F.col("c_name")).alias("name"),
                                          F.array(_pick("c_custkey", 4, "test", "std::prelude::v1::test", "::rstest::case", "core::prelude::test")).alias("attributes"))
    n = read(spark, d, "nation").select(_key("n", "n_nationkey").alias("node"), F.col("n_name").alias("name"), F.array(_pick("n_nationkey", 10, "tokio::test", "allow")).alias("attributes"))
    return c.unionByName(n)


def enclosing_items(spark, d):
    return _ancestors(spark, d).select("node", "ancestor", F.col("distance").cast("bigint").alias("distance"))


def item_context(spark, d):
    sites = read(spark, d, "orders").select(_key("o", "o_orderkey").alias("node"))
    return O.context(sites, _ancestors(spark, d), _items(spark, d)).select("node", "in_test", "in_main")


def _calls(spark, d):
    path = F.when(F.col("l_returnflag") == "R", "std::rt::begin_panic").when(F.col("l_returnflag") == "A", "core::panicking::panic_fmt").otherwise("std::mem::swap")
    return read(spark, d, "lineitem").select(_key("o", "l_orderkey").alias("node"), path.alias("path"), (F.col("l_linenumber") % 2 == 0).alias("interpolated"))


def closure_panics(spark, d):
    return O.closure_panics(_ancestors(spark, d), _calls(spark, d))


def panic_violations(spark, d):
    """Closures are orders and customers; panics in ``main`` are allowed."""
    o = read(spark, d, "orders").select(_key("o", "o_orderkey").alias("node"), (F.col("o_orderpriority") == "1-URGENT").alias("doctest"))
    c = read(spark, d, "customer").select(_key("c", "c_custkey").alias("node"), (F.col("c_mktsegment") == "BUILDING").alias("doctest"))
    return O.panic_violations(o.unionByName(c), _ancestors(spark, d), _items(spark, d), _calls(spark, d), allow_in_main=True).select("node", "interpolated_only")


def _modules(spark, d):
    """Customers are functions and modules of nations, named by segment and key; orders are what modules hold."""
    c = read(spark, d, "customer").select(
        _key("c", "c_custkey").alias("id"), _key("n", "c_nationkey").alias("parent"), F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("name"), _pick("c_custkey", 3, "mod", "fn").alias("kind"),
        F.col("c_custkey").alias("ordinal"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), (F.col("c_custkey") % 2 == 0).alias("from_expansion"), (F.col("c_custkey") % 50 == 1).alias("is_test"))
    kind = F.when(F.col("o_orderstatus") == "F", "fn").when(F.col("o_orderstatus") == "O", "const").otherwise("extern_crate")
    name = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("core")).when(F.col("o_orderkey") % 97 == 0, O.HARNESS_DESCRIPTOR).otherwise(F.col("o_orderpriority"))
    o = read(spark, d, "orders").select(_key("o", "o_orderkey").alias("id"), _key("c", "o_custkey").alias("parent"), name.alias("name"), kind.alias("kind"), F.floor(F.col("o_orderkey") / 1000).alias("ordinal"), F.month("o_orderdate").alias("lo"),
                                        F.quarter("o_orderdate").alias("hi"), F.lit(False).alias("from_expansion"), F.lit(False).alias("is_test"))
    return c.unionByName(o)


def companion_functions(spark, d):
    return O.companions(_modules(spark, d))


def expect_violations(spark, d):
    sites = read(spark, d, "orders").select(
        _key("o", "o_orderkey").alias("node"), _pick("o_orderkey", 3, "unwrap", "expect").alias("method"),
        F.when(F.col("o_orderstatus") == "F", "core::option::Option").when(F.col("o_orderstatus") == "O", "std::result::Result").otherwise("my::Maybe").alias("receiver"),
        (F.col("o_orderpriority") == "1-URGENT").alias("doctest"), _pick("o_orderkey", 7, "tests/a.rs", "app\\tests\\x\\main.rs", "tests/x/y.rs", "src/lib.rs").alias("path"))
    return O.expect_violations(sites, _ancestors(spark, d), _items(spark, d), companion_functions(spark, d)).select("node", "receiver", "path")


def _conditions(spark, d):
    """Customers are roots of conditions (every ninth one a call), their orders the operands."""
    root = _key("c", "c_custkey")
    c = read(spark, d, "customer").select(root.alias("node"), root.alias("root"), _pick("c_custkey", 9, "call", "or").alias("kind"))
    o = read(spark, d, "orders").select(_key("o", "o_orderkey").alias("node"), _key("c", "o_custkey").alias("root"), F.when(F.col("o_orderstatus") == "F", "and").when(F.col("o_orderstatus") == "P", "not").otherwise("path").alias("kind"))
    return c.unionByName(o)


def over_branched(spark, d):
    return O.over_branched(O.branches(_conditions(spark, d), _ancestors(spark, d)), 4)


def statement_segments(spark, d):
    """Orders as statements: dates are lines."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    o = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("fn"), _pick("o_orderkey", 6, "if", "while", "loop", "match_arm", "call", "if").alias("kind"), (F.col("o_orderkey") % 11 == 0).alias("from_expansion"), day.alias("test_start"), (day + 1).alias("test_end"),
        (F.col("o_orderkey") % 7 == 0).alias("test_is_let"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 5 + 1).alias("branches"), (day + 1).alias("body_start"), (day + 4).alias("body_end"),
        F.when(F.col("o_orderkey") % 6 == 5, day + 5).alias("else_start"), F.when(F.col("o_orderkey") % 6 == 5, day + 8).alias("else_end"))
    return S.segments(o)


def predicate_flags(spark, d):
    """Attribute, receiver and file predicates over part names turned into paths."""
    p = read(spark, d, "part")
    path = F.concat(_pick("p_partkey", 8, "test", "::tokio::test", "std::prelude::rust_2024::test", "core::prelude::test", "my::case", "rstest::case", "core::result::Result::", "Option<u8>"), F.when(F.col("p_size") > 40, "::x").otherwise(""))
    file = F.concat(_pick("p_partkey", 4, "tests/", "app/tests/", "src/", "tests\\deep\\"), _pick("p_partkey", 5, "main.rs", "a.rs", "x/main.rs", "x/a.rs", "a.txt"))
    return p.select("p_partkey", X.is_test_attribute(path, ("my::case",)).alias("is_test"), X.is_option_or_result(path).alias("wrapped"), X.is_integration_root(file).alias("test_root"), O.parameter_kind(F.col("p_size") % 3 > 0, F.col("p_size") % 2 == 0).alias("parameter"))


def marked_functions(spark, d):
    """Direct and traced test and fixture markers, doc attributes and outer ones of parts."""
    p = read(spark, d, "part")
    one = lambda c, inner: F.struct(c.alias("path"), F.lit(inner).alias("inner"))
    attrs = F.array(one(_pick("p_partkey", 6, "rstest", "rstest::rstest", "fixture", "rstest::fixture", "doc", "allow"), False), one(_pick("p_size", 3, "doc", "cfg", "::doc"), True))
    trace = F.when(F.col("p_size") % 4 > 0, F.array(_pick("p_size", 4, "x", "rstest", "rstest::fixture", "rstest::rstest::x")))
    return p.select("p_partkey", O.has_marker(attrs, O.TEST_MARKERS).alias("is_test"), O.has_marker(attrs, O.FIXTURE_MARKERS).alias("is_fixture"), O.has_marker(attrs, O.TEST_MARKERS, trace).alias("traced_test"),
                    O.has_marker(attrs, O.FIXTURE_MARKERS, trace).alias("traced_fixture"), F.size(O.split_attributes(attrs)["docs"]).alias("n_docs"), F.size(O.split_attributes(attrs)["rest"]).alias("n_rest"), F.size(O.outer_attributes(attrs)).alias("n_outer"))


def argument_shapes(spark, d):
    """Line items as calls of two arguments: lowered atoms, their redacted shape and the span to report."""
    l = read(spark, d, "lineitem")
    name = _key("v", "l_linenumber")
    known = F.array(F.lit("v1"), F.lit("v3"))
    atom = lambda kind, ok: O.argument_atom(kind, name, ok, known)
    atoms = F.array(atom(F.when(F.col("l_returnflag") == "R", "local").when(F.col("l_returnflag") == "A", "const").otherwise("call"), F.col("l_linenumber") != 7), atom(_pick("l_partkey", 2, "literal", "local"), F.lit(True)))
    frame = lambda text, macro: F.struct(F.lit(text).alias("span"), macro.alias("from_expansion"))
    own = F.array(frame("call", F.col("l_partkey") % 2 == 0), frame("site", F.col("l_partkey") % 3 == 0))
    outer = F.array(F.array(frame("outer", F.col("l_suppkey") % 2 == 0)), F.array(frame("inner", F.col("l_suppkey") % 3 == 0)))
    shown = l.select(O.argument_shape(atoms).alias("shape"), F.array_join(F.transform(atoms, lambda a: a["value"]), ",", "-").alias("texts"), O.editable_span(own)["kind"].alias("kind"), O.recovered_span(own, outer).alias("span"))
    return shown.groupBy("shape", "texts", "kind", "span").agg(F.count(F.lit(1)).alias("n"))


def paragraph_slots(spark, d):
    """Users are paragraphs, and the rounded values of their events names."""
    e = read(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("name"))
    return O.local_slots(e, "user_id", "event_id", "name").select("user_id", "name", F.col("slot").cast("bigint").alias("slot"))


def sorted_prefixes(spark, d):
    p = read(spark, d, "part").select(F.concat(F.lit("app::"), F.replace("p_name", F.lit(" "), F.lit("::"))).alias("prefix")).distinct()
    return O.ordered_prefixes(p)


def _measured(spark, d):
    """Customers' metrics with their brain methods, as for ``type_disposition``; suppliers of R items are the foreign reach."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("type"), F.col("o_orderkey").alias("name"), F.floor(F.col("o_totalprice") / 5000).alias("cc"), F.floor(F.col("o_totalprice") / 2000).alias("loc"))
    brain = F.filter(F.array_sort(F.collect_list(F.struct("name", "cc", "loc"))), lambda b: (b["cc"] >= 97) & (b["loc"] >= 60))
    return o.groupBy("type").agg(F.sum("cc").alias("wmc"), brain.alias("brain"), (F.count(F.lit(1)) % 4).alias("lcom4"), (F.max("cc") % 3).alias("reach"))


def type_messages(spark, d):
    m = _measured(spark, d)
    n = F.size("brain")
    return m.select("type", D.type_message(F.col("type"), F.col("wmc"), F.col("lcom4"), F.col("reach"), F.col("brain")).alias("message"), D.type_note(F.col("lcom4"), F.col("reach"), n).alias("note"), D.type_help(F.col("lcom4"), F.col("reach"), n).alias("help"))


def trait_messages(spark, d):
    t = _cohesion._traits(spark, d)
    total, required, default, cc = (F.col(c) for c in ("n_methods", "n_required", "n_default", "default_cc"))
    return t.select("trait", D.trait_message(F.col("trait"), total, required, default, cc).alias("message"), D.trait_note(required, cc).alias("note"), D.trait_help(total, required, cc).alias("help"))


def localised_messages(spark, d):
    """Nations are the catalogue: keys are their numbers, locales their regions; every fourth text is missing, some have marks."""
    n = read(spark, d, "nation")
    text = F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit("\u2068"), F.col("n_name"), F.lit("\u2069")))
    catalogue = n.select(F.col("n_regionkey").alias("locale"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("primary"), text.alias("note"), F.lit("help").alias("help"))
    fallback = F.struct(F.col("c_mktsegment").alias("primary"), F.lit("\u2068none").alias("note"), F.lit("see").alias("help"))
    rows = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("locale"), F.col("c_nationkey").alias("key"), fallback.alias("fallback"))
    return D.resolved(rows, catalogue).select("c_custkey", "localized", "message.*")


def chosen_locales(spark, d):
    c = read(spark, d, "customer")
    asked = F.when(F.col("c_custkey") % 3 == 0, F.lit(" cy ")).when(F.col("c_custkey") % 3 == 1, F.lit(" "))
    setting = F.when(F.col("c_custkey") % 5 == 0, "fr").when(F.col("c_custkey") % 5 == 1, "gd")
    return c.select("c_custkey", X.pick_locale(("en-GB", "cy", "gd"), asked, F.lower("c_mktsegment"), setting).alias("locale"))


def ordered_findings(spark, d):
    """Line items as findings, some of them without a fragment."""
    l = read(spark, d, "lineitem")
    return D.in_order(l.select(_pick("l_linenumber", 3, *(r[0] for r in N.RULES)).alias("rule_id"), F.when(F.col("l_linestatus") == "F", _key("f", "l_partkey")).alias("fragment"), _key("m", "l_orderkey").alias("message")))


def rule_catalogue(spark, d):
    return N.rules(spark)


def span_lines(spark, d):
    o = read(spark, d, "orders")
    a, b, c, e = F.col("o_orderkey") % 7, F.col("o_custkey") % 3, F.col("o_custkey") % 7, F.col("o_orderkey") % 3
    error = D.span_error(a, b, c, e)
    return o.select("o_orderkey", error.alias("error"), F.when(error.isNull(), D.line_count(a, c)).alias("n_lines"))


def region_checks(spark, d):
    l = read(spark, d, "lineitem")
    a, b, c, e = F.col("l_linenumber") - 2, F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey") % 9), F.col("l_suppkey") % 4, F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 5)
    x = l.select(a.alias("line"), N.region_is_valid(a, b, c, e).alias("ok"), N.compact_span(a.cast("int"), c.cast("int"), b.cast("int"), e.cast("int")).alias("span"))
    return x.groupBy("line", "ok", "span").agg(F.count(F.lit(1)).alias("n"))


def merged_inventory(spark, d):
    """Parts as libraries of their brand; what was found again stands twice."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("toolchain"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("crate"), "p_partkey")
    return D.merged_inventory(p.filter("p_partkey % 3 > 0"), p.filter("p_partkey % 2 = 0"))


def library_inventory(spark, d):
    p = read(spark, d, "part").select(F.concat(F.lit("/x/lib"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("@"), F.col("p_brand"), F.when(F.col("p_partkey") % 5 > 0, ".so").otherwise(".dll")).alias("path"))
    return L.inventory_text(L.libraries(p))


def property_bags(spark, d):
    """Bags written under one key and read back."""
    p = read(spark, d, "part").select("p_partkey", L.wrapped_properties(F.struct(F.col("p_type").alias("profile"), F.col("p_size").alias("k"))).alias("bag"))
    return p.select("p_partkey", "bag", L.unwrapped_properties(F.col("bag"), "profile string, k int").alias("x")).select("p_partkey", "bag", "x.*")


def checksums(spark, d):
    p = read(spark, d, "part")
    digest = F.sha2(F.col("p_name"), 256)
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.upper(digest), F.lit("  lib.so"))).when(F.col("p_partkey") % 4 == 1, F.concat(digest, F.lit("x"))).otherwise(digest)
    return p.select("p_partkey", X.checksum(text).alias("sha256"))


def adjacency(spark, d):
    return A.adjacency(_advice.similarity_edges(spark, d))


def unstable_labels(spark, d):
    """Nodes that would move, were every node labelled with the first word of its name."""
    v = _advice.feature_vectors(spark, d)
    labels = v.select("subject", "method").distinct().withColumn("community", F.substring_index("method", "_", 1))
    return A.unsettled(A.votes(v, labels), labels)


def edge_errors(spark, d):
    l = read(spark, d, "lineitem")
    e = A.edge_error(F.col("l_linenumber"), F.col("l_suppkey") % 12, F.floor("l_quantity") % 6, F.lit(10))
    return l.select(e.alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    enclosing_items, item_context, closure_panics, panic_violations, companion_functions, expect_violations, over_branched, statement_segments, predicate_flags, marked_functions, argument_shapes, paragraph_slots,
    sorted_prefixes, type_messages, trait_messages, localised_messages, chosen_locales, ordered_findings, rule_catalogue, span_lines, region_checks, merged_inventory, library_inventory, property_bags, checksums, adjacency,
    unstable_labels, edge_errors,
)}


def _case(column: str, modulus: int, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {column} % {modulus} {whens} ELSE '{values[-1]}' END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ITEM = "(c_custkey % 4 < 3 OR n_nationkey % 10 = 0)"
_UP = "orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
_PANICS = "p AS (SELECT l_orderkey, bool_and(l_linenumber % 2 = 0) AS io FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1)"
_COMPANIONS = f"""x AS (SELECT o_orderkey AS id, o_custkey AS parent, CASE o_orderstatus WHEN 'F' THEN 'fn' WHEN 'O' THEN 'const' ELSE 'ext' END AS kind, o_orderkey // 1000 AS ordinal, month(o_orderdate) AS lo, quarter(o_orderdate) AS hi,
    CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'core' END WHEN o_orderkey % 97 = 0 THEN '{O.HARNESS_DESCRIPTOR}' ELSE o_orderpriority END AS name FROM orders),
  c AS (SELECT *, c_mktsegment || (c_custkey % 7) AS name FROM customer),
  good AS (SELECT c_nationkey, name FROM c m WHERE c_custkey % 3 = 0 AND (EXISTS (SELECT 1 FROM x WHERE x.parent = m.c_custkey AND x.kind = 'const' AND x.name = '{O.HARNESS_DESCRIPTOR}')
    OR (c_custkey % 2 = 0 AND EXISTS (SELECT 1 FROM x a JOIN x b ON a.parent = b.parent AND a.name = b.name AND a.kind = 'fn' AND b.kind = 'const' WHERE a.parent = m.c_custkey
      AND ((a.lo = b.lo AND a.hi = b.hi) OR (abs(a.ordinal - b.ordinal) = 1 AND EXISTS (SELECT 1 FROM x t WHERE t.parent = a.parent AND t.kind = 'ext' AND t.name = 'test'))))))),
  marked AS (SELECT c_custkey FROM c WHERE c_custkey % 3 <> 0 AND (c_custkey % 50 = 1 OR EXISTS (SELECT 1 FROM good WHERE good.c_nationkey = c.c_nationkey AND good.name = c.name)))"""
_BRAIN = "cc >= 97 AND loc >= 60"
_TYPES = f"""o AS (SELECT o_custkey AS type, o_orderkey AS name, floor(o_totalprice / 5000)::BIGINT AS cc, floor(o_totalprice / 2000)::BIGINT AS loc FROM orders),
  m AS (SELECT type, sum(cc)::BIGINT AS wmc, count(*) FILTER ({_BRAIN}) AS n, string_agg('`' || name || '` (CC=' || cc || ', LOC=' || loc || ')', ', ' ORDER BY name) FILTER ({_BRAIN}) AS b, count(*) % 4 AS lcom4, max(cc) % 3 AS reach FROM o GROUP BY type)"""
_FAR = "CASE WHEN reach > 0 THEN ', foreign reach=' || reach ELSE '' END"


def _help_sql(pairs: list[tuple[str, str]], otherwise: str) -> str:
    parts = ", ".join(f"CASE WHEN {c} THEN {_quoted(t)} END" for c, t in pairs)
    joined = f"array_to_string(list_filter([{parts}], lambda s: s IS NOT NULL), ', ')"
    return f"CASE WHEN {joined} <> '' THEN 'Consider ' || {joined} || '.' ELSE {_quoted(otherwise)} END"


_EDGES = _advice._edges(_advice._V)
_DAY = "date_diff('day', DATE '1990-01-01', o_orderdate::DATE)"
ORACLE = {
    "enclosing_items": """SELECT 'o' || o_orderkey AS node, 'o' || o_orderkey AS ancestor, 0::BIGINT AS distance FROM orders UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 0 FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1 FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 1 FROM orders UNION ALL SELECT 'o' || o_orderkey, 'n' || c_nationkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey""",
    "item_context": f"SELECT 'o' || o_orderkey AS node, {_ITEM} AS in_test, c_custkey % 5 = 0 AS in_main FROM {_UP}",
    "closure_panics": f"""WITH {_PANICS} SELECT 'o' || l_orderkey AS node, true AS panics, io AS interpolated_only FROM p UNION ALL SELECT 'c' || o_custkey, true, bool_and(io) FROM p JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey
      UNION ALL SELECT 'n' || c_nationkey, true, bool_and(io) FROM p JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""",
    "panic_violations": f"""WITH {_PANICS}, s AS (SELECT 'o' || o_orderkey AS node, io, o_orderpriority = '1-URGENT' AS doc, c_custkey, n_nationkey FROM {_UP} JOIN p ON l_orderkey = o_orderkey
      UNION ALL SELECT 'c' || c_custkey, bool_and(io), any_value(c_mktsegment) = 'BUILDING', c_custkey, any_value(n_nationkey) FROM {_UP} JOIN p ON l_orderkey = o_orderkey GROUP BY c_custkey)
      SELECT node, io AS interpolated_only FROM s WHERE NOT doc AND NOT ({_ITEM} AND io) AND c_custkey % 5 <> 0""",
    "companion_functions": f"WITH {_COMPANIONS} SELECT 'c' || c_custkey AS id FROM marked",
    "expect_violations": rf"""WITH {_COMPANIONS} SELECT 'o' || o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 'core::option::Option' ELSE 'std::result::Result' END AS receiver, {_case('o_orderkey', 7, 'tests/a.rs', 'a', 'tests/x/y.rs', 'src/lib.rs')} AS path
      FROM {_UP} WHERE o_orderkey % 3 <> 0 AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '1-URGENT' AND o_orderkey % 7 > 1 AND NOT {_ITEM} AND c_custkey NOT IN (SELECT c_custkey FROM marked)""",
    "over_branched": "SELECT 'c' || c_custkey AS root, count(*) AS branches FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 9 <> 0 AND o_orderstatus = 'O' GROUP BY c_custkey HAVING count(*) > 4",
    "statement_segments": f"""WITH s AS (SELECT o_orderkey AS fn, {_DAY}::INT AS d, o_orderkey % 6 AS m, o_orderkey % 7 = 0 AS is_let, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 5 + 1 END AS b FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 6 <> 4)
      SELECT fn, d AS start, d + 1 AS "end", (b * 0.5)::DOUBLE AS value FROM s WHERE m <> 2 AND NOT is_let AND b IS NOT NULL UNION ALL SELECT fn, d + 1, d + 4, 1.0 FROM s UNION ALL SELECT fn, d + 5, d + 8, 1.0 FROM s WHERE m = 5 UNION ALL SELECT fn, d + 1, d + 4, 0.5 FROM s WHERE m = 3""",
    "predicate_flags": """SELECT p_partkey, p_size <= 40 AND p_partkey % 8 IN (0, 1, 2, 4, 5) AS is_test, p_size <= 40 AND p_partkey % 8 = 6 AS wrapped,
      CASE p_partkey % 4 WHEN 2 THEN false WHEN 3 THEN p_partkey % 5 = 0 ELSE p_partkey % 5 < 3 END AS test_root, CASE WHEN p_size % 3 = 0 THEN 'unsupported_pattern' WHEN p_size % 2 = 0 THEN 'provider' ELSE 'fixture_local' END AS parameter FROM part""",
    "marked_functions": """SELECT p_partkey, p_partkey % 6 < 2 AS is_test, p_partkey % 6 IN (2, 3) AS is_fixture, p_partkey % 6 < 2 OR p_size % 4 = 1 AS traced_test, p_partkey % 6 IN (2, 3) OR p_size % 4 = 2 AS traced_fixture,
      (p_partkey % 6 = 4)::INT + (p_size % 3 <> 1)::INT AS n_docs, 2 - (p_partkey % 6 = 4)::INT - (p_size % 3 <> 1)::INT AS n_rest, 1 AS n_outer FROM part""",
    "argument_shapes": """WITH l AS (SELECT *, 'v' || l_linenumber AS v, l_linenumber IN (1, 3) AS known FROM lineitem),
      t AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 'unsupported' WHEN l_returnflag = 'R' AND known THEN 'fixture_local' WHEN l_returnflag = 'A' THEN 'const' ELSE 'unsupported' END AS a, CASE WHEN l_partkey % 2 = 0 THEN 'literal' WHEN known THEN 'fixture_local' ELSE 'unsupported' END AS b FROM l)
      SELECT a || ',' || b AS shape, (CASE a WHEN 'unsupported' THEN '-' ELSE v END) || ',' || (CASE b WHEN 'unsupported' THEN '-' ELSE v END) AS texts, CASE WHEN l_partkey % 2 <> 0 THEN 'direct' WHEN l_partkey % 3 <> 0 THEN 'recovered' ELSE 'macro_only' END AS kind,
        CASE WHEN l_partkey % 2 <> 0 THEN 'call' WHEN l_partkey % 3 <> 0 THEN 'site' WHEN l_suppkey % 3 <> 0 THEN 'inner' WHEN l_suppkey % 2 <> 0 THEN 'outer' END AS span, count(*) AS n FROM t GROUP BY ALL""",
    "paragraph_slots": "SELECT user_id, name, rank() OVER (PARTITION BY user_id ORDER BY first) - 1 AS slot FROM (SELECT user_id, floor(value)::BIGINT AS name, min(event_id) AS first FROM events GROUP BY 1, 2)",
    "sorted_prefixes": "SELECT DISTINCT 'app::' || replace(p_name, ' ', '::') AS prefix FROM part",
    "type_messages": f"""WITH {_TYPES} SELECT type, '`' || type || '` has WMC=' || wmc || CASE WHEN n = 0 THEN ' and LCOM4=' || lcom4 || {_FAR} ELSE ', LCOM4=' || lcom4 || {_FAR} || CASE WHEN n = 1 THEN ', and a brain method ' ELSE ', and ' || n || ' brain methods: ' END || b END || '.' AS message,
      {_quoted(D.TYPE_NOTE[0])} || CASE WHEN n > 0 THEN {_quoted(D.TYPE_NOTE[1])} ELSE '' END || CASE WHEN lcom4 >= 2 THEN {_quoted(D.TYPE_NOTE[2])} ELSE '' END || CASE WHEN reach > 0 THEN replace({_quoted(D.TYPE_NOTE[3])}, '%d', reach::VARCHAR) ELSE '' END AS note,
      {_help_sql([('n > 0', D.TYPE_HELP[0]), ('lcom4 >= 2', D.TYPE_HELP[1]), ('reach > 0', D.TYPE_HELP[2])], D.TYPE_ADVICE)} AS help FROM m""",
    "trait_messages": f"""WITH {_cohesion._T} SELECT trait, '`' || trait || '` has ' || n_methods || ' methods (' || n_required || ' required, ' || n_default || ' default)' || CASE WHEN default_cc > 0 THEN ' with default method complexity CC=' || default_cc ELSE '' END || '.' AS message,
      {_quoted(D.TRAIT_NOTE[0])} || CASE WHEN default_cc > 0 THEN {_quoted(D.TRAIT_NOTE[1])} ELSE '' END || CASE WHEN n_required > 0 THEN {_quoted(D.TRAIT_NOTE[2])} ELSE '' END AS note,
      {_help_sql([('n_methods > 0', D.TRAIT_HELP[0]), ('default_cc > 0', D.TRAIT_HELP[1]), ('n_required > 0', D.TRAIT_HELP[2])], D.TRAIT_ADVICE)} AS help FROM t""",
    "localised_messages": """SELECT c_custkey, n_nationkey IS NOT NULL AS localized, coalesce(n_name, c_mktsegment) AS "primary", coalesce(n_name, 'none') AS note, CASE WHEN n_nationkey IS NULL THEN 'see' ELSE 'help' END AS help
      FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = c_custkey % 5 AND n_nationkey % 4 > 0""",
    "chosen_locales": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cy' WHEN c_custkey % 5 = 1 THEN 'gd' ELSE 'en-GB' END AS locale FROM customer",
    "ordered_findings": f"SELECT {_case('l_linenumber', 3, *(r[0] for r in N.RULES))} AS rule_id, CASE WHEN l_linestatus = 'F' THEN 'f' || l_partkey END AS fragment, 'm' || l_orderkey AS message FROM lineitem",
    "rule_catalogue": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_quoted(x) for x in r) + ")" for r in N.RULES) + ") t(id, name, description)",
    "span_lines": """WITH s AS (SELECT o_orderkey, o_orderkey % 7 AS a, o_custkey % 3 AS b, o_custkey % 7 AS c, o_orderkey % 3 AS e FROM orders)
      SELECT o_orderkey, CASE WHEN (a, b) > (c, e) THEN 'StartAfterEnd' END AS error, CASE WHEN (a, b) <= (c, e) THEN c - a + 1 END AS n_lines FROM s""",
    "region_checks": """WITH s AS (SELECT l_linenumber - 2 AS a, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 9 END AS b, l_suppkey % 4 AS c, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 5 END AS e FROM lineitem)
      SELECT a AS line, a >= 1 AND coalesce(b, a) >= a AND c >= 1 AND coalesce(e, 1) >= 1 AND (coalesce(b, a) <> a OR coalesce(e >= c, true)) AS ok, a || ':' || c || '-' || coalesce(b, a) || ':' || coalesce(e, c) AS span, count(*) AS n FROM s GROUP BY ALL""",
    "merged_inventory": "SELECT p_brand AS toolchain, replace(p_name, ' ', '_') AS crate FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_brand, replace(p_name, ' ', '_') FROM part WHERE p_partkey % 2 = 0",
    "library_inventory": "SELECT p_brand || ': ' || string_agg(DISTINCT replace(p_name, ' ', '_'), ', ' ORDER BY replace(p_name, ' ', '_')) AS value FROM part WHERE p_partkey % 5 > 0 GROUP BY p_brand",
    "property_bags": """SELECT p_partkey, '{"clone":{"profile":"' || p_type || '","k":' || p_size || '}}' AS bag, p_type AS profile, p_size::INT AS k FROM part""",
    "checksums": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 1 THEN sha256(p_name) END AS sha256 FROM part",
    "adjacency": f"WITH e AS ({_advice.ORACLE['similarity_edges']}) SELECT subject, a AS node, b AS neighbour, dot AS weight FROM e UNION ALL SELECT subject, b, a, dot FROM e",
    "unstable_labels": f"""WITH e AS ({_EDGES}), y AS (SELECT subject, a AS node, b AS near, dot FROM e UNION ALL SELECT subject, b, a, dot FROM e), l AS (SELECT DISTINCT subject, node, string_split(node, '_')[1] AS label FROM y),
      v AS (SELECT y.subject, y.node, l.label AS theirs, sum(dot) AS s FROM y JOIN l ON l.subject = y.subject AND l.node = y.near GROUP BY ALL), b AS (SELECT subject, node, theirs AS best FROM v QUALIFY row_number() OVER (PARTITION BY subject, node ORDER BY s DESC, theirs) = 1)
      SELECT subject, node, label, best FROM l JOIN b USING (subject, node) WHERE label <> best""",
    "edge_errors": "SELECT CASE WHEN l_linenumber >= l_suppkey % 12 THEN 'NonCanonicalEdge' WHEN l_suppkey % 12 >= 10 THEN 'EndpointOutOfRange' WHEN floor(l_quantity) % 6 = 0 THEN 'ZeroWeight' END AS error, count(*) AS n FROM lineitem GROUP BY ALL",
}
