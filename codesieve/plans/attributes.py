"""Attribute texts over ``part``: what modules begin with, and cfg predicates of nested lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import meta as M
from . import read

#: What a module begins with, and what that is.
HEADS = (
    ("//! docs", "doc"), ('#![doc = "x"]', "doc"), ('#! [ doc = "x"]', "doc"), ('#![cfg_attr(test, doc = "x")]', "doc"), ('#![cfg_attr(all(a, b), allow(x), doc = "y")]', "doc"), ("#![cfg_attr(doc, allow(x))]", "missing"),
    ('#![Doc = "x"]', "missing"), ('#![cfg_attr(test, DOC = "x")]', "missing"), ("#[cfg(test)]", "misordered"), ("#![allow(dead_code)]", "missing"), ("#![allow(dead_code)]\n//! late", "misordered"), ('#![allow(a)] #![doc = "x"]', "misordered"),
    ("// plain", "missing"), ('/* block */ #![doc = "x"]', "missing"), ("", "missing"), ('#![cfg_attr(a, cfg_attr(b, doc = "x"))]', "doc"), ('#![allow(a)]\n  #![cfg_attr(x,\n doc = "y")]', "missing"), ('#![allow(é)] // #![doc = "x"]', "misordered"),
)
SPACES = ("", " ", "\n\t", "  ")
LISTS, LEAVES = ("all", "any", "not", "x::not"), ("test", "doctest", "unix", 'feature = "test"', "a::test")


def _at(values, place):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (place % len(values) + 1).cast("int"))


def _spread(spark, d):
    """Parts dealt to tasks: the table is a small file or few, read by as few tasks, while each text takes a scan. A number of tasks is named, since few bytes would go to one."""
    return read(spark, d, "part").select("p_partkey", "p_size", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def leading_contents(spark, d):
    p = _spread(spark, d)
    text = F.concat(_at(SPACES, F.col("p_size")), _at([h for h, _ in HEADS], F.col("p_partkey")), F.lit("\nfn "), F.col("p_name"))
    return p.select("p_partkey", M.leading_content(text).alias("x")).select("p_partkey", "x.*")


def _predicate(shift):
    k = F.col("p_partkey") + shift
    leaf = lambda n: _at(LEAVES, F.floor(k / n))
    return F.concat(_at(LISTS, k), F.lit("("), leaf(4), F.lit(", "), _at(LISTS, F.col("p_size")), F.lit("("), leaf(20), F.lit(", "), _at(LISTS, F.floor(F.col("p_size") / 4)), F.lit("("), leaf(3), F.lit(")))"))


def cfg_predicates(spark, d):
    """Whether predicates ask for test, with and without passing negation on, alone and as condition and attribute of a wrapper."""
    a, b = _predicate(0), _predicate(7)
    wrapped = F.concat(F.lit("cfg_attr("), a, F.lit(", allow(x), cfg("), b, F.lit("))"))
    return _spread(spark, d).select("p_partkey", M.cfg_contains_test(a).alias("asks"), M.cfg_contains_test(a, propagate=False).alias("asks_afresh"), M.is_cfg_test(F.concat(F.lit("cfg("), a, F.lit(")"))).alias("direct"), M.is_cfg_test(wrapped).alias("wrapped"))


QUERIES = {f.__name__: f for f in (leading_contents, cfg_predicates)}


def _q(value: str) -> str:
    out = "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace(" ", "' || chr(8195) || '") + "'"
    return f"({out})"


def _pick(values, place: str) -> str:
    return f"([{', '.join(_q(v) for v in values)}])[({place}) % {len(values)} + 1]"


def _asks(shift: int) -> str:
    """Columns of a predicate's lists and leaves, then its value by parity of negations."""
    k = f"(p_partkey + {shift})"
    names = [_pick(LISTS, k), _pick(LISTS, "p_size"), _pick(LISTS, "p_size // 4")]
    leaves = [_pick(LEAVES, f"{k} // {n}") for n in (4, 20, 3)]
    nots = [f"({n} = 'not')::INT" for n in names]
    test = [f"{leaf} IN ('test', 'doctest')" for leaf in leaves]
    turned = " OR ".join(f"({t} AND ({' + '.join(nots[: i + 1])}) % 2 = 0)" for i, t in enumerate(test))
    afresh = " OR ".join(f"({t} AND {n} = 0)" for t, n in zip(test, nots))
    return f"({turned}) AS asks{shift}, ({afresh}) AS afresh{shift}"


ORACLE = {
    "leading_contents": f"""WITH h AS (SELECT unnest([{', '.join(_q(h) for h, _ in HEADS)}]) AS head, unnest([{', '.join(_q(k) for _, k in HEADS)}]) AS kind, unnest(range({len(HEADS)})) AS k)
      SELECT p_partkey, kind, CASE WHEN kind = 'misordered' THEN strlen({_pick(SPACES, 'p_size')})::INT END AS "offset", CASE WHEN kind = 'misordered' THEN strlen(string_split(head, chr(10))[1])::INT END AS length FROM part JOIN h ON k = p_partkey % {len(HEADS)}""",
    "cfg_predicates": f"WITH t AS (SELECT p_partkey, {_asks(0)}, {_asks(7)} FROM part) SELECT p_partkey, asks0 AS asks, afresh0 AS asks_afresh, asks0 AS direct, asks0 AND asks7 AS wrapped FROM t",
}
