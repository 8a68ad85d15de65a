"""Findings and regions over ``lineitem``, ``nation`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as O
from . import read

_KEYS = ["part", "flag", "day"]


def _results(spark, d):
    """Line items as findings: the key has nulls where an item is of status F with quantity below 5; runs are line numbers."""
    l = read(spark, d, "lineitem")
    keyless = (F.col("l_linestatus") == "F") & (F.col("l_quantity") < 5)
    return l.select((F.col("l_linenumber") % 3).alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("tool"), (F.col("l_linenumber") % 3).cast("string")).alias("tool"),
                    F.when(~keyless, F.col("l_partkey").cast("string")).alias("part"), F.col("l_returnflag").alias("flag"), F.date_format("l_shipdate", "yyyy-MM").alias("day"))


def findings_dedup(spark, d):
    return O.keep_first(_results(spark, d), _KEYS, ["ord"]).select("ord", "part", "flag", "day")


def runs_merge(spark, d):
    return O.merge_runs(_results(spark, d), _KEYS).select("run", "ord", "part", "flag", "day", "tool")


def rules_union(spark, d):
    c = read(spark, d, "customer").select((F.col("c_nationkey") % 4).alias("run"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("id"), F.col("c_name").alias("name"))
    return O.union_rules(c)


def region_lines(spark, d):
    """Region of the text from its middle byte's character on to its last one; line and byte columns."""
    t = read(spark, d, "documents").select("doc_id", "text", F.octet_length("text").cast("bigint").alias("size")).filter("size > 0")
    half = F.floor(F.col("size") / 2)
    start = F.when(O.is_boundary(F.col("text"), half), half).otherwise(half - 1)
    t = t.withColumn("start", start).filter(O.range_error(F.col("text"), F.col("start"), F.col("size")).isNull())
    r = t.select("doc_id", O.region(F.col("text"), F.col("start"), F.col("size")).alias("r"))
    span = O.compact_span(F.col("r.start_line"), F.col("r.start_column"), F.col("r.end_line"), F.col("r.end_column"))
    return r.select("doc_id", "r.byte_offset", "r.byte_length", span.alias("span"))


QUERIES = {f.__name__: f for f in (findings_dedup, runs_merge, rules_union, region_lines)}
_R = """r AS (SELECT l_linenumber % 3 AS run, l_orderkey * 10 + l_linenumber AS ord, 'tool' || (l_linenumber % 3) AS tool, CASE WHEN NOT (l_linestatus = 'F' AND l_quantity < 5) THEN l_partkey::VARCHAR END AS part, l_returnflag AS flag, strftime(l_shipdate, '%Y-%m') AS day FROM lineitem)"""
_SPLIT = "SELECT *, row_number() OVER (PARTITION BY part, flag, day ORDER BY {}) AS n FROM r"
ORACLE = {
    "findings_dedup": f"WITH {_R} SELECT ord, part, flag, day FROM ({_SPLIT.format('ord')}) WHERE part IS NULL OR n = 1",
    "runs_merge": f"WITH {_R} SELECT run, ord, part, flag, day, (SELECT arg_min(tool, ord) FROM r WHERE run = 0) AS tool FROM ({_SPLIT.format('run, ord')}) WHERE part IS NULL OR n = 1",
    "rules_union": "SELECT run, ord, id, name FROM (SELECT c_nationkey % 4 AS run, c_custkey AS ord, c_mktsegment AS id, c_name AS name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey % 4, c_custkey) AS n FROM customer) WHERE n = 1",
    "region_lines": r"""WITH t AS (SELECT doc_id, text, strlen(text) AS size, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 0),
      s AS (SELECT *, CASE WHEN (instr('0123456789ABCDEF', substr(h, (size // 2) * 2 + 1, 1)) - 1) // 4 <> 2 OR size // 2 = size THEN size // 2 ELSE size // 2 - 1 END AS a FROM t),
      p AS (SELECT doc_id, size, a, text, decode(unhex(substr(h, 1, a * 2))) AS before, left(text, length(text) - 1) AS upto FROM s WHERE a < size),
      c AS (SELECT *, length(before) - length(replace(before, chr(10), '')) + 1 AS sl, length(upto) - length(replace(upto, chr(10), '')) + 1 AS el, string_split(before, chr(10))[-1] AS bt, string_split(upto, chr(10))[-1] AS ut FROM p)
      SELECT doc_id, a AS byte_offset, size - a AS byte_length, sl || ':' || (length(bt) + 1) || '-' || el || ':' || (length(ut) + 1) AS span FROM c""",
}
