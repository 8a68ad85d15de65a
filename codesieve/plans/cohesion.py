"""Cohesion and size: orders as types and line items as methods; customers as traits and orders as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohesion as O
from . import read

CC, LOC = 40, 60


def _methods(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("type"), F.col("l_linenumber").alias("method"), F.col("l_quantity").cast("bigint").alias("cc"), F.floor(F.col("l_extendedprice") / 1000).alias("loc"), "l_partkey", "l_suppkey", "l_returnflag")


def wmc_rollup(spark, d):
    return O.wmc(_methods(spark, d)).select("type", F.col("wmc").cast("bigint").alias("wmc"))


def brain_methods(spark, d):
    return O.brain_methods(_methods(spark, d), CC, LOC).select("type", "method", "cc", "loc")


def foreign_reach(spark, d):
    m = _methods(spark, d).select("type", F.col("l_suppkey").alias("path"), (F.col("l_returnflag") == "R").alias("from_expansion"))
    return O.foreign_reach(m)


def _entity_methods(spark, d):
    """By customer: orders are methods; their parts modulo 400 are fields, and an order calls the name of its status and priority."""
    o, l = read(spark, d, "orders"), read(spark, d, "lineitem")
    fields = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 400)).alias("fields"))
    name = F.concat_ws("-", "o_orderstatus", "o_orderpriority")
    return o.join(fields, "o_orderkey", "left").select(F.col("o_custkey").alias("type"), F.col("o_orderkey").alias("method"), name.alias("name"), F.coalesce("fields", F.array().cast("array<bigint>")).alias("fields"),
                                                       F.when(F.col("o_totalprice") > 400000, F.array(F.lit("O-1-URGENT"))).otherwise(F.array().cast("array<string>")).alias("calls"))


def lcom4_components(spark, d):
    _checkpoints(spark)
    return O.lcom4(_entity_methods(spark, d))


def _checkpoints(spark):
    """Lineage is cut in the folder that the session names for it."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder)


def type_disposition(spark, d):
    """Customers are types and their orders methods, as for ``lcom4_components``."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("type"), F.col("o_orderkey").alias("method"), F.floor(F.col("o_totalprice") / 5000).alias("cc"), F.floor(F.col("o_totalprice") / 2000).alias("loc"))
    m = O.type_metrics(o, CC, LOC, lcom4=lcom4_components(spark, d))
    return m.select("type", "wmc", "n_brain", "lcom4", O.type_disposition(F.col("wmc"), F.col("n_brain"), F.col("lcom4"), 120, 1000, brain_deny=12, lcom_deny=12).alias("decision"))


def _traits(spark, d):
    o = read(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "required").when(F.col("o_orderstatus") == "O", "default").otherwise("other")
    return O.trait_metrics(o.select(F.col("o_custkey").alias("trait"), kind.alias("kind"), F.floor(F.col("o_totalprice") / 50000).alias("cc")))


def trait_metrics(spark, d):
    return _traits(spark, d)


def trait_disposition(spark, d):
    t = _traits(spark, d)
    return t.select("trait", "n_methods", "default_cc", O.trait_disposition(F.col("n_methods"), F.col("default_cc"), 10, 15, 20).alias("decision"))


def cognitive_scores(spark, d):
    """Events by user in order: purchases open a level that ends with their eight events, clicks add the nesting depth, views are structural, the rest fundamental; small values are a macro's."""
    from pyspark.sql import Window

    mine = Window.partitionBy("method").orderBy("at")
    e = read(spark, d, "events").select(F.col("user_id").alias("method"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("t"), (F.col("value") < 10).alias("from_expansion")).withColumn("seq", F.row_number().over(mine) - 1)
    kind = F.when(F.col("t") == "purchase", "push").when(F.col("t") == "view", "structural").when(F.col("t") == "click", "nesting").otherwise("fundamental")
    pops = e.filter("t = 'purchase'").select("method", (F.floor(F.col("seq") / 8) * 8 + 7.5).alias("seq"), F.lit("pop").alias("kind"), "from_expansion")
    return O.cognitive(e.select("method", F.col("seq").cast("double"), kind.alias("kind"), "from_expansion").unionByName(pops))


QUERIES = {f.__name__: f for f in (wmc_rollup, brain_methods, foreign_reach, lcom4_components, type_disposition, trait_metrics, trait_disposition, cognitive_scores)}
_M = "m AS (SELECT l_orderkey AS type, l_linenumber AS method, l_quantity::BIGINT AS cc, floor(l_extendedprice / 1000)::BIGINT AS loc, l_suppkey, l_returnflag FROM lineitem)"
_F = "SELECT type, count(DISTINCT l_suppkey) AS foreign_reach FROM m WHERE l_returnflag <> 'R' GROUP BY type"
_T = """t AS (SELECT o_custkey AS trait, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS n_methods, count(*) FILTER (o_orderstatus = 'F') AS n_required, count(*) FILTER (o_orderstatus = 'O') AS n_default,
  coalesce(sum(floor(o_totalprice / 50000)) FILTER (o_orderstatus = 'O'), 0)::BIGINT AS default_cc FROM orders GROUP BY 1)"""
ORACLE = {
    "wmc_rollup": f"WITH {_M} SELECT type, sum(cc)::BIGINT AS wmc FROM m GROUP BY type",
    "brain_methods": f"WITH {_M} SELECT type, method, cc, loc FROM m WHERE cc >= {CC} AND loc >= {LOC}",
    "foreign_reach": f"WITH {_M} {_F}",
    "trait_metrics": f"WITH {_T} SELECT *, n_required AS burden FROM t",
    "trait_disposition": f"WITH {_T} SELECT trait, n_methods, default_cc, CASE WHEN n_methods >= 15 THEN 'deny' WHEN n_methods >= 10 AND default_cc >= 20 THEN 'warn' ELSE 'pass' END AS decision FROM t",
    "lcom4_components": """WITH RECURSIVE f AS (SELECT DISTINCT o_custkey AS t, o_orderkey AS m, l_partkey % 400 AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
      e AS (SELECT DISTINCT a.t, a.m AS a, b.m AS b FROM f a JOIN f b ON a.t = b.t AND a.x = b.x AND a.m <> b.m
        UNION SELECT o.o_custkey, o.o_orderkey, p.o_orderkey FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey AND o.o_orderkey <> p.o_orderkey AND o.o_totalprice > 400000 AND p.o_orderstatus || '-' || p.o_orderpriority = 'O-1-URGENT'
        UNION SELECT o.o_custkey, p.o_orderkey, o.o_orderkey FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey AND o.o_orderkey <> p.o_orderkey AND o.o_totalprice > 400000 AND p.o_orderstatus || '-' || p.o_orderpriority = 'O-1-URGENT'),
      r(t, m, x) AS (SELECT o_custkey, o_orderkey, o_orderkey FROM orders UNION SELECT r.t, r.m, e.b FROM r JOIN e ON e.t = r.t AND e.a = r.x),
      c AS (SELECT t, m, min(x) AS root FROM r GROUP BY 1, 2) SELECT t AS type, count(DISTINCT root) AS lcom4 FROM c GROUP BY t""",
    "cognitive_scores": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
      x AS (SELECT *, coalesce(count(*) FILTER (event_type = 'purchase' AND NOT value < 10) OVER (PARTITION BY user_id, seq // 8 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM e)
      SELECT user_id AS method, coalesce(sum(CASE event_type WHEN 'click' THEN depth WHEN 'purchase' THEN 0 ELSE 1 END) FILTER (NOT value < 10), 0)::BIGINT AS score FROM x GROUP BY user_id""",
}
ORACLE["type_disposition"] = f"""WITH x AS (SELECT o_custkey AS type, sum(floor(o_totalprice / 5000))::BIGINT AS wmc, count(*) FILTER (floor(o_totalprice / 5000) >= {CC} AND floor(o_totalprice / 2000) >= {LOC}) AS n_brain FROM orders GROUP BY 1)
  SELECT type, wmc, n_brain, lcom4, CASE WHEN wmc >= 1000 OR n_brain >= 12 OR lcom4 >= 12 THEN 'deny' WHEN wmc >= 120 AND n_brain >= 1 AND lcom4 >= 2 THEN 'warn' ELSE 'pass' END AS decision FROM x JOIN ({ORACLE["lcom4_components"]}) USING (type)"""
