"""Attribute scanners against plain recursion."""

import random

from pyspark.sql import functions as F

from codesieve.functions import meta
from codesieve.plans.attributes import HEADS, SPACES


def _values(spark, texts, **columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r for r in df.select("i", *(f(F.col("t")).alias(n) for n, f in columns.items())).collect()}


def test_leading_contents(spark):
    texts = [(s + h, k, len(s.encode()), len(h.split("\n")[0].encode())) for s in SPACES for h, k in HEADS] + [("", "missing", 0, 0), (" \n", "missing", 0, 0), ("#![doc", "doc", 0, 0), ("#!", "missing", 0, 0), ("#![allow(x)]\r\n//! y", "misordered", 0, 12)]
    got = _values(spark, [t[0] for t in texts] + [None], x=meta.leading_content)
    for i, (t, kind, offset, length) in enumerate(texts):
        assert tuple(got[i].x) == ((kind, offset, length) if kind == "misordered" else (kind, None, None)), t
    assert got[len(texts)].x is None


def test_entries_are_cut_outside_of_parentheses(spark):
    def cut(s):
        out, depth, cur = [], 0, ""
        for c in s:
            depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
            if c == "," and not depth:
                out.append(cur)
                cur = ""
            else:
                cur += c
        return out + [cur]

    r = random.Random(2)
    texts = ["".join(r.choice("a(),😀 b") for _ in range(r.randint(0, 14))) for _ in range(200)]
    got = _values(spark, texts, x=meta.entries)
    assert [got[i].x for i in range(len(texts))] == [cut(t) for t in texts]


def test_cfg_predicates_equal_recursion(spark):
    r = random.Random(4)

    def make(depth):
        if depth and r.random() < 0.7:
            return r.choice(("all", "any", "not", "x::not", "feature")), [make(depth - 1) for _ in range(r.randint(0, 3))]
        return r.choice(("test", "doctest", "unix", 'feature = "not(test)"', "a::test")), None

    def text(x):
        return x[0] if x[1] is None else f"{x[0]}({r.choice((', ', ','))[:2].join(map(text, x[1]))})"

    def asks(x, positive=True):
        return (x[0] in ("test", "doctest") and positive) if x[1] is None else any(asks(y, positive != (x[0] == "not")) for y in x[1])

    def afresh(x, positive=True):
        return (x[0] in ("test", "doctest") and positive) if x[1] is None else any(afresh(y, x[0] != "not") for y in x[1])

    trees = [make(4) for _ in range(300)]
    got = _values(spark, [text(x) for x in trees], a=meta.cfg_contains_test, b=lambda c: meta.cfg_contains_test(c, propagate=False), d=lambda c: meta.is_cfg_test(F.concat(F.lit("cfg("), c, F.lit(")"))), w=lambda c: meta.is_cfg_test(F.concat(F.lit("cfg_attr(test, x, cfg_attr("), c, F.lit(", cfg(not(unix), test)))"))))
    for i, x in enumerate(trees):
        assert (got[i].a, got[i].b, got[i].d, got[i].w) == (asks(x), afresh(x), asks(x), asks(x)), text(x)
    odd = _values(spark, ["cfg_attr(unix, cfg(test))", "cfg_attr(test)", "cfg", "cfg(test", "allow(test)", "", ")))test((("], d=meta.is_cfg_test, a=meta.cfg_contains_test)
    assert [odd[i].d for i in range(7)] == [False] * 7 and odd[6].a
