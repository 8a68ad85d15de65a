"""Tree features over the hierarchy region, nation, customer, order; covers over order dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import u64
from ..operators import trees as O
from . import read


def _nodes(spark, d):
    """One tree for each nation: nation, segments, customers, orders. Kinds: 1, 2, 3 and 4 plus the order's status."""
    n, c, o = read(spark, d, "nation"), read(spark, d, "customer"), read(spark, d, "orders")
    tree = F.col("c_nationkey").cast("bigint")
    none = F.lit(None).cast("string")
    root = n.select(F.col("n_nationkey").cast("bigint").alias("tree"), F.lit("r").alias("node"), none.alias("parent"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).alias("depth"), F.lit(1).alias("kind"), none.alias("leaf"))
    seg = c.select(tree.alias("tree"), "c_mktsegment").distinct().select("tree", F.concat(F.lit("s-"), F.col("c_mktsegment")).alias("node"), F.lit("r").alias("parent"), F.length("c_mktsegment").cast("bigint").alias("ordinal"), F.lit(1).alias("depth"), F.lit(2).alias("kind"), none.alias("leaf"))
    cust = c.select(tree.alias("tree"), F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("s-"), F.col("c_mktsegment")).alias("parent"), F.col("c_custkey").alias("ordinal"), F.lit(2).alias("depth"), F.lit(3).alias("kind"), none.alias("leaf"))
    orders = o.join(c, o.o_custkey == c.c_custkey).select(tree.alias("tree"), F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("node"), F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("parent"),
        F.col("o_orderkey").alias("ordinal"), F.lit(3).alias("depth"), (F.lit(4) + F.ascii("o_orderstatus") % 3).alias("kind"), F.when(F.col("o_orderpriority") == "1-URGENT", "ident").when(F.col("o_orderpriority") == "2-HIGH", "literal").otherwise("other").alias("leaf"))
    return root.unionByName(seg).unionByName(cust).unionByName(orders)


def kind_counts(spark, d):
    return O.kind_counts(_nodes(spark, d))


def kind_histogram(spark, d):
    return O.histogram(_nodes(spark, d))


def productions(spark, d):
    return O.productions(_nodes(spark, d))


def tree_hash(spark, d):
    return O.hashes(_nodes(spark, d))


def smallest_cover(spark, d):
    """For each customer the shortest span of days, of those between the orders of a priority and status by month, that holds the account's first and last order in that month."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    covers = o.groupBy("o_orderpriority", "m").agg(F.min("day").alias("start"), F.max("day").alias("end")).select(F.concat_ws("/", "m", "o_orderpriority").alias("cover"), "start", "end")
    targets = o.groupBy("o_custkey", "m").agg(F.min("day").alias("start"), F.max("day").alias("end")).select(F.concat_ws("/", F.col("o_custkey").cast("string"), "m").alias("target"), "start", "end")
    return O.smallest_cover(targets, covers, 31)


QUERIES = {f.__name__: f for f in (kind_counts, kind_histogram, productions, tree_hash, smallest_cover)}
_N = """n AS (SELECT n_nationkey::BIGINT AS tree, 'r' AS node, NULL AS parent, 0 AS depth, 1 AS kind FROM nation
  UNION ALL SELECT DISTINCT c_nationkey::BIGINT, 's-' || c_mktsegment, 'r', 1, 2 FROM customer UNION ALL SELECT c_nationkey::BIGINT, 'c-' || c_custkey, 's-' || c_mktsegment, 2, 3 FROM customer
  UNION ALL SELECT c_nationkey::BIGINT, 'o-' || o_orderkey, 'c-' || o_custkey, 3, 4 + ascii(o_orderstatus) % 3 FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _byte(hx: str) -> str:
    return f"list_transform(range(0, len({hx}) // 2), lambda i: ((instr('0123456789ABCDEF', substr({hx}, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({hx}, 2 * i + 2, 1)) - 1)::UBIGINT)"


def _node(kind: str, leaf: str, kids: str) -> str:
    """Hexadecimal bytes of a node; fewer than 65536 children."""
    low = "upper(lpad(to_hex(({0}) % 256), 2, '0') || lpad(to_hex(({0}) // 256), 2, '0'))".format
    return f"hex(encode('{O.SCHEMA_ID}n')) || {low(f'({kind})::BIGINT')} || hex(encode({leaf})) || {low(f'({kids})::BIGINT')} || '000000000000'"


_LOW = " || ".join(f"substr(upper(lpad(to_hex(h), 16, '0')), {i}, 2)" for i in range(15, 0, -2))
_FOLD = f"list_reduce(list_prepend({u64.FNV_BASIS}::UBIGINT, {_byte('hx')}), lambda h, b: xor(((h::UHUGEINT * {u64.FNV_PRIME}) % 18446744073709551616::UHUGEINT)::UBIGINT, b))"
_HASHES = f"""WITH o AS (SELECT c_nationkey AS tree, c_mktsegment AS seg, c_custkey AS cust, o_orderkey AS ord, {_node("4 + ascii(o_orderstatus) % 3", "CASE o_orderpriority WHEN '1-URGENT' THEN 'i' WHEN '2-HIGH' THEN 'l' ELSE 'o' END", "0")} AS hx FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
      oh AS (SELECT tree, seg, cust, ord, {_FOLD} AS h FROM o), c AS (SELECT tree, seg, cust, {_node("3", "'n'", "count(ord)")} || coalesce(string_agg({_LOW}, '' ORDER BY ord) FILTER (ord IS NOT NULL), '') AS hx FROM oh GROUP BY tree, seg, cust),
      ch AS (SELECT tree, seg, cust, {_FOLD} AS h FROM c), s AS (SELECT tree, seg, {_node("2", "'n'", "count(*)")} || string_agg({_LOW}, '' ORDER BY cust) AS hx FROM ch GROUP BY tree, seg),
      sh AS (SELECT tree, seg, {_FOLD} AS h FROM s), r AS (SELECT n_nationkey::BIGINT AS tree, {_node("1", "'n'", "count(seg)")} || coalesce(string_agg({_LOW}, '' ORDER BY length(seg), h) FILTER (seg IS NOT NULL), '') AS hx FROM nation LEFT JOIN sh ON tree = n_nationkey GROUP BY n_nationkey)
      SELECT tree, lpad(lower(to_hex({_FOLD})), 16, '0') AS hash FROM r"""
ORACLE = {
    "tree_hash": _HASHES,
    "kind_counts": f"WITH {_N} SELECT tree, kind, depth, count(*) AS n FROM n GROUP BY ALL",
    "kind_histogram": f"WITH {_N} SELECT tree, kind, sum((9223372036854775808::HUGEINT >> depth))::HUGEINT::VARCHAR AS weight FROM n GROUP BY tree, kind",
    "productions": f"""WITH {_N} SELECT a.tree, b.kind || '>' || a.kind AS production, count(*) AS n FROM n a JOIN n b ON a.tree = b.tree AND a.parent = b.node GROUP BY 1, 2
      UNION ALL SELECT a.tree, c.kind || '>' || b.kind || '>' || a.kind, count(*) FROM n a JOIN n b ON a.tree = b.tree AND a.parent = b.node JOIN n c ON c.tree = b.tree AND b.parent = c.node GROUP BY 1, 2""",
    "smallest_cover": """WITH o AS (SELECT o_custkey, o_orderpriority, (epoch(o_orderdate)::BIGINT // 86400) AS day, strftime(o_orderdate, '%Y-%m') AS m FROM orders),
      c AS (SELECT m || '/' || o_orderpriority AS cover, min(day) AS a, max(day) AS b FROM o GROUP BY o_orderpriority, m), t AS (SELECT o_custkey || '/' || m AS target, min(day) AS a, max(day) AS b FROM o GROUP BY o_custkey, m)
      SELECT target, cover FROM (SELECT target, cover, row_number() OVER (PARTITION BY target ORDER BY c.b - c.a, cover) AS n FROM t JOIN c ON c.a <= t.a AND c.b >= t.b) WHERE n = 1""",
}
