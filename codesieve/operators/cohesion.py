"""Cohesion and size of types and traits, and the decisions over them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..session import staged


def wmc(methods: DataFrame, key: str = "type") -> DataFrame:
    return methods.groupBy(key).agg(F.sum("cc").alias("wmc"))


def is_brain(cc: Column, loc: Column, cc_least: int, loc_least: int) -> Column:
    return (cc >= cc_least) & (loc >= loc_least)


def brain_methods(methods: DataFrame, cc_least: int, loc_least: int, key: str = "type") -> DataFrame:
    return methods.filter(is_brain(F.col("cc"), F.col("loc"), cc_least, loc_least))


def type_metrics(methods: DataFrame, cc_least: int, loc_least: int, lcom4: DataFrame | None = None, reach: DataFrame | None = None, key: str = "type") -> DataFrame:
    """wmc, brain methods, lcom4 and foreign reach by type; what is missing counts 0."""
    out = methods.groupBy(key).agg(F.sum("cc").cast("bigint").alias("wmc"), F.count_if(is_brain(F.col("cc"), F.col("loc"), cc_least, loc_least)).alias("n_brain"))
    for df, name in ((lcom4, "lcom4"), (reach, "foreign_reach")):
        out = out.withColumn(name, F.lit(0).cast("bigint")) if df is None else out.join(df.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


def type_disposition(wmc: Column, n_brain: Column, lcom4: Column, warn: int = 60, deny: int = 100, brain_warn: int = 1, brain_deny: int = 2, lcom_warn: int = 2, lcom_deny: int = 3) -> Column:
    return F.when((wmc >= deny) | (n_brain >= brain_deny) | (lcom4 >= lcom_deny), "deny").when((wmc >= warn) & (n_brain >= brain_warn) & (lcom4 >= lcom_warn), "warn").otherwise("pass")


def foreign_reach(uses: DataFrame, key: str = "type", path: str = "path", macro: str = "from_expansion") -> DataFrame:
    """Different foreign paths that aren't a macro's."""
    return uses.filter(~F.col(macro)).groupBy(key).agg(F.countDistinct(path).alias("foreign_reach"))


def trait_metrics(items: DataFrame, key: str = "trait") -> DataFrame:
    """Items by kind (required, default, other) and the default methods' cc; the burden is what is required."""
    method = F.col("kind").isin("required", "default")
    return items.groupBy(key).agg(
        F.count_if(method).alias("n_methods"), F.count_if(F.col("kind") == "required").alias("n_required"), F.count_if(F.col("kind") == "default").alias("n_default"),
        F.coalesce(F.sum(F.when(F.col("kind") == "default", F.col("cc"))), F.lit(0)).cast("bigint").alias("default_cc"),
    ).withColumn("burden", F.col("n_required"))


def trait_disposition(n_methods: Column, total_cc: Column, warn: int = 20, deny: int = 30, cc_least: int = 40) -> Column:
    return F.when(n_methods >= deny, "deny").when((n_methods >= warn) & (total_cc >= cc_least), "warn").otherwise("pass")


def cohesion_edges(methods: DataFrame, key: str = "type") -> DataFrame:
    """(key, a, b): a field's methods to its first one, and callers to the methods of the called name. ``methods``: key, method, name, fields, calls."""
    fields = methods.select(key, "method", F.explode("fields").alias("field"))
    first = fields.groupBy(key, "field").agg(F.min("method").alias("a"))
    shared = fields.join(first, [key, "field"]).select(key, "a", F.col("method").alias("b"))
    calls = methods.select(key, F.col("method").alias("a"), F.explode("calls").alias("name"))
    called = calls.join(methods.select(key, "name", F.col("method").alias("b")), [key, "name"]).select(key, "a", "b")
    return shared.unionByName(called).filter("a <> b").distinct()


def _spread_labels(methods: DataFrame, key: str, rounds: int | None) -> DataFrame:
    """Least labels spread along edges, with shortcuts, until nothing changes; an error if ``rounds`` end before."""
    edges = cohesion_edges(methods, key)
    both = edges.unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).persist()
    labels = methods.select(key, F.col("method").alias("a"), F.col("method").alias("label")).distinct()
    before, turn = None, 0
    while True:
        if turn == rounds:
            both.unpersist()
            raise RuntimeError(f"labels still change after {rounds} rounds")
        turn += 1
        near = both.join(labels.select(key, F.col("a").alias("b"), "label"), [key, "b"]).groupBy(key, "a").agg(F.min("label").alias("m"))
        labels = labels.join(near, [key, "a"], "left").select(key, "a", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = labels.select(key, F.col("a").alias("label"), F.col("label").alias("up"))
        labels = labels.join(jump, [key, "label"], "left").select(key, "a", F.least("label", F.coalesce("up", "label")).alias("label")).transform(staged)
        now = labels.agg(F.sum(F.xxhash64(key, "a", "label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    both.unpersist()
    return labels.groupBy(key).agg(F.countDistinct("label").alias("lcom4"))


def _components(group: dict, callers: set) -> int:
    """Components of methods (method: its (name, fields)): a field links its methods, a called name its callers (method, name) and its bearers."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    called = {n for _, n in callers}
    for m, facts in group.items():
        for name, fields in facts:
            for f in fields or ():
                if f is not None:
                    up[root((0, f))] = root((2, m))
            if name in called:
                up[root((1, name))] = root((2, m))
    borne = {name for facts in group.values() for name, _ in facts}
    for m, n in callers:
        if n in borne:
            up[root((1, n))] = root((2, m))
    return len({root((2, m)) for m in group})


def _counted(key: str, schema: pa.Schema):
    """Components of types whose rows stand together; one type is held at a time."""

    def run(batches):
        begun, now, group, callers = False, None, {}, set()
        for b in batches:
            out = []
            for t, m, name, fields, calls in zip(*(b.column(c).to_pylist() for c in (key, "method", "name", "fields", "calls"))):
                if not begun or t != now:
                    if begun:
                        out.append((now, _components(group, callers)))
                    begun, now, group, callers = True, t, {}, set()
                if m is not None:
                    # a null key meets nothing
                    group.setdefault(m, []).append((name, fields) if t is not None else (None, ()))
                    callers.update((m, c) for c in (calls if t is not None else None) or () if c is not None)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], schema.types[0]), pa.array([o[1] for o in out], pa.int64())], schema=schema)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.types[0]), pa.array([_components(group, callers)], pa.int64())], schema=schema)

    return run


def lcom4(methods: DataFrame, key: str = "type", rounds: int | None = None, most: int = 100_000) -> DataFrame:
    """Connected components of each type's methods.

    Types of at most ``most`` methods, fields and calls are counted in the task that their rows meet in; larger ones, and all where ``rounds``
    is given, by labels that spread through joins, with an error if the rounds end before nothing changes.
    """
    if rounds is not None:
        return _spread_labels(methods, key, rounds)
    m = methods.select(key, "method", "name", "fields", "calls").transform(staged)
    size = 1 + F.greatest(F.size("fields"), F.lit(0)) + F.greatest(F.size("calls"), F.lit(0))
    large = m.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(size).alias("n")).filter(F.col("n") > most).select(key).transform(staged)
    schema = StructType([m.schema[key], StructField("lcom4", LongType())])
    found = m.join(large, key, "left_anti").repartition(key).sortWithinPartitions(key).mapInArrow(_counted(key, to_arrow_schema(schema)), schema)
    return found if large.isEmpty() else found.unionByName(_spread_labels(m.join(large, key, "left_semi"), key, None))


def cognitive(events: DataFrame, key: str = "method") -> DataFrame:
    """Score of an event log (key, seq, kind, from_expansion); a pop undoes its own push, an unbalanced log is an error.

    Brackets of one level take turns, so the event before a pop among those of its level is its push. Running sums give
    levels and depths; a method's rows stream through a window.
    """
    by = Window.partitionBy(key).orderBy("seq")
    turn = F.when(F.col("kind") == "push", 1).when(F.col("kind") == "pop", -1).otherwise(0)
    e = events.select(key, "seq", "kind", F.coalesce("from_expansion", F.lit(False)).alias("macro")).withColumn("level", F.sum(turn).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    bracket = F.when(F.col("kind") == "push", F.col("level")).when(F.col("kind") == "pop", F.col("level") + 1)
    e = e.withColumn("bracket", bracket).withColumn("pushed", F.lag("macro").over(Window.partitionBy(key, "bracket").orderBy("seq")))
    deeper = F.when((F.col("kind") == "push") & ~F.col("macro"), 1).when((F.col("kind") == "pop") & ~F.col("pushed"), -1).otherwise(0)
    e = e.withColumn("depth", F.sum(deeper).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    score = F.when(F.col("kind").isin("push", "pop") | F.col("macro"), 0).when(F.col("kind") == "nesting", F.col("depth")).otherwise(1)
    out = e.groupBy(key).agg(F.sum(score).cast("long").alias("score"), F.min("level").alias("least"), F.sum(turn).alias("open"))
    wrong = F.when(F.col("least") < 0, F.raise_error(F.lit("pop without a push"))).when(F.col("open") > 0, F.raise_error(F.lit("push without a pop")))
    return out.select(key, F.coalesce(wrong.cast("long"), "score").alias("score"))
