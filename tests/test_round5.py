"""Findings of round 3: steps that read few files, counts that move once, hot ancestors."""

import random

from pyspark.sql import functions as F

from codesieve.functions import meta
from codesieve.operators import cohesion, nested, rules
from codesieve.plans import attributes, streams
from codesieve.streaming import incremental


def test_part_texts_are_dealt_to_tasks(spark, tmp_path):
    parts = spark.range(200).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit("x y").alias("p_name"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for query in (attributes.cfg_predicates, attributes.leading_contents):
        found = query(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        assert found.count() == 200 and found.select("task").distinct().count() > 1


def test_entries_are_scanned_by_token(spark):
    one = spark.range(1).select(meta.entries(F.lit("a(b, c)" + "x" * 50_000 + ",d")).alias("x"), meta.balanced_arguments(F.lit(" (a(b,c), d) e")).alias("y"), meta.balanced_arguments(F.lit("(a")).alias("z"), meta.arguments(F.lit("x")).alias("w")).first()
    assert (one.x, one.y, one.z, one.w) == (["a(b, c)" + "x" * 50_000, "d"], ["a(b,c)", " d"], None, None)


def test_running_rows_move_once(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 7 > 2, F.col("id")).alias("v"))
    found = nested.running(rows, ["k"], ["id"], {"v": "s"})
    # rows used to move again, to a window by partition and key
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i in range(400):
        own = [j for j in range(i + 1) if j % 3 == i % 3 and j % 7 > 2]
        want[i] = sum(own) if own else None
    assert {r.id: r.s for r in found.collect()} == want


def test_streamed_keys_stay_in_the_jvm(spark, tmp_path, monkeypatch):
    events = spark.range(5000).select((F.col("id") % 900).alias("user_id"), F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("event_type"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.col("id").alias("event_id"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    # a call for each key of a batch
    monkeypatch.setattr(incremental, "first_seen", None)
    found = streams.streamed_first_seen(spark, str(tmp_path))
    assert found.count() == found.distinct().count() == events.select("user_id", "event_type").distinct().count()


def test_small_types_need_no_rounds(spark, monkeypatch):
    draw = random.Random(7)
    rows = [(t if t < 8 else None, i, draw.choice("abcd"), [draw.choice((None, *range(12))) for _ in range(draw.randrange(3))], [draw.choice("abcdxy")] if draw.random() < 0.2 else None) for t in range(9) for i in range(draw.randrange(1, 25))]
    df = spark.createDataFrame(rows, "type int, method int, name string, fields array<int>, calls array<string>")
    want = {r.type: r.lcom4 for r in cohesion.lcom4(df, rounds=40).collect()}
    assert {r.type: r.lcom4 for r in cohesion.lcom4(df, most=20).collect()} == want and len(set(want.values())) > 2
    monkeypatch.setattr(cohesion, "cohesion_edges", None)
    assert {r.type: r.lcom4 for r in cohesion.lcom4(df).collect()} == want


def test_what_lies_below_a_root_stays_where_it_is(spark, monkeypatch):
    nodes = spark.createDataFrame([("r", None)] + [(f"c{i}", "r") for i in range(5)] + [(f"o{i}", f"c{i % 5}") for i in range(40)] + [("x", "gone")], "node string, parent string")
    met = rules._met(nodes.select("node", "parent"), spark.createDataFrame([("r",), ("c1",)], "middle string"))
    assert met.count() == 2
    items = spark.createDataFrame([("r", "main", ["allow"]), ("c1", "f", ["test"])], "node string, name string, attributes array<string>")
    want = {(f"o{i}", f"c{i % 5}", 1) for i in range(40)} | {(f"o{i}", "r", 2) for i in range(40)} | {(f"c{i}", "r", 1) for i in range(5)} | {("x", "gone", 1)} | {(r.node, r.node, 0) for r in nodes.collect()}
    for most in (100_000, 0):
        monkeypatch.setattr(rules, "MOST_BROADCAST", most)
        monkeypatch.setattr(rules, "MOST_BELOW", most)
        up = rules.enclosing(nodes)
        assert {tuple(r) for r in up.collect()} == want
        told = rules.context(nodes.select("node"), up, items).collect()
        assert {r.node for r in told if r.in_main} == {r.node for r in nodes.collect()} - {"x"}
        assert {r.node for r in told if r.in_test} == {"c1"} | {f"o{i}" for i in range(1, 40, 5)}
