"""Findings of round 4: gaps of a signal, whole brands, blocks in files."""

import datetime
import random
from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from codesieve.operators import advice, similar_trees
from codesieve.plans import advice as plans_advice, clones, facts, signal as plans_signal


def _oracle(sql, folder, *tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_smoothing_spans_lines_without_events(spark, tmp_path):
    at = lambda slot: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=6 * slot + 1)
    rows = [(1, at(0)), (1, at(0)), (1, at(0)), (1, at(4)), (2, at(7)), (2, None), (3, None), (None, at(1)), (None, at(3))]
    spark.createDataFrame(rows, "user_id long, ts timestamp").withColumn("event_id", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/events.parquet")
    got = plans_signal.signal_smooth(spark, str(tmp_path)).orderBy("entity", "line").collect()
    assert [r.smoothed for r in got if r.entity == 1] == [1.5, 1.0, 0.0, 0.333333, 0.5]
    assert [r.smoothed for r in got if r.entity == 2] == [1.0]
    assert [r.smoothed for r in got if r.entity is None] == [0.5, 0.666667, 0.5]
    want = _oracle(plans_signal.ORACLE["signal_smooth"].replace("user_id AS entity", "coalesce(user_id, -1) AS entity"), tmp_path, "events")
    assert sorted((-1 if r.entity is None else r.entity, r.line, r.smoothed) for r in got) == want


def test_parts_of_a_brand_all_meet(spark, tmp_path):
    rows = [(i, f"red bolt {i % 3}", f"Brand#{i % 2}", "SMALL", 7 + i % 2, 900.0 + 50 * i) for i in range(24)] + [(90, "red bolt 1", None, "SMALL", 7, 900.0), (91, None, "Brand#1", "SMALL", 7, 900.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in plans_advice.similarity_edges(spark, str(tmp_path)).collect()}
    assert len(got) == 2 * 12 * 11 / 2 and len({s for s, *_ in got}) == 2  # parts used to meet those of their key modulo 8 alone
    assert sorted(got) == _oracle(plans_advice.ORACLE["similarity_edges"], tmp_path, "part")
    both = {tuple(r) for r in facts.adjacency(spark, str(tmp_path)).collect()}
    assert both == {(s, a, b, w) for s, a, b, w in got} | {(s, b, a, w) for s, a, b, w in got}
    assert sorted(both) == _oracle(facts.ORACLE["adjacency"], tmp_path, "part")


def test_rows_between_tasks_do_not_grow_with_blocks(spark, monkeypatch):
    v = spark.range(300).select((F.col("id") % 2).cast("string").alias("subject"), F.format_string("m%03d", "id").alias("method"), F.lit("f").alias("feature"), F.lit(3).cast("bigint").alias("weight"))
    want = {tuple(r) for r in advice.edges(v).collect()}
    found = advice.edges(v, block=8)
    assert {tuple(r) for r in found.collect()} == want and len(want) == 2 * 150 * 149 / 2
    # the last step reads pairs of block numbers, not rows copied for each block
    assert "method" not in found._jdf.queryExecution().executedPlan().toString()


def test_accepted_pairs_tell_every_texts_links(spark, tmp_path):
    draw = random.Random(5)
    words = [draw.choice("abcdefghijklmnop") + str(draw.randrange(40)) for _ in range(120)]
    text, other = " ".join(words), " ".join(reversed(words))
    near = " ".join(words[:-1] + ["tail"])
    renamed = " ".join("x" + w for w in words)  # another text of the same T2 set
    rows = list(enumerate([text, other, near, text, renamed, text, near, None, "a b"], 1))
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = clones.accepted_pairs(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == _oracle(clones.ORACLE["accepted_pairs"], tmp_path, "documents")
    sets = {(r.profile, r.doc_id): set(r.hashes) for r in clones.S.signed_sets(spark.createDataFrame(rows, "doc_id long, text string"), clones.K, clones.WINDOW).collect()}
    for profile, (n, d) in (("T1", clones.TYPE1), ("T2", clones.TYPE2)):
        own = {k: x for (p, k), x in sets.items() if p == profile}
        want = {(a, b) for a, b in combinations(sorted(own), 2) if d * len(own[a] & own[b]) >= n * len(own[a] | own[b])}
        mine = [r for r in got if r.profile == profile]
        first = {r.right: r.left for r in mine if r.intersection == r.union}
        linked = {(r.left, r.right) for r in mine}
        assert {(a, b) for a, b in combinations(sorted(own), 2) if first.get(a, a) == first.get(b, b) or tuple(sorted((first.get(a, a), first.get(b, b)))) in linked} == want
        assert {(1, 3), (1, 4), (3, 7), (4, 6), (6, 7)} <= want and ((1, 5) in want) == (profile == "T2")
    found = clones.run0(spark, str(tmp_path))
    assert found.count() == len(got) and found.select("fragment").distinct().count() == len(got)


def test_distances_side_by_side_and_in_many_tasks(spark):
    draw = random.Random(11)

    def tree(n):
        rows, stack = [], []
        for i in range(n):
            left = i
            for _ in range(draw.randrange(min(3, len(stack)) + 1) if i < n - 1 else len(stack)):
                left = stack.pop()
            rows.append((draw.choice("abc"), left))
            stack.append(left)
        return rows

    def plain(a, b, memo):
        if not a or not b:
            return sum(1 + plain(t[1], (), memo) for t in a + b)
        if (a, b) not in memo:
            x, y = a[-1], b[-1]
            memo[a, b] = min(plain(a[:-1] + x[1], b, memo) + 1, plain(a, b[:-1] + y[1], memo) + 1, plain(a[:-1], b[:-1], memo) + plain(x[1], y[1], memo) + (x[0] != y[0]))
        return memo[a, b]

    def nested(rows):
        stack = []
        for i, (label, left) in enumerate(rows):
            below = [x for x in stack if x[0] >= left]
            stack = [x for x in stack if x[0] < left] + [(left, (label, tuple(t for _, t in below)))]
        return tuple(t for _, t in stack)

    forest = [tree(n) for n in (9, 1, 6, 8, 2, 7, 1, 9)] + [[]]
    for a in forest:
        assert similar_trees.distances(a, forest) == [plain(nested(a), nested(b), {}) for b in forest] == [similar_trees.distance(a, b) for b in forest]
    nodes = spark.range(40).select((F.col("id") / 2).cast("long").alias("tree"), (F.col("id") % 2).alias("pre"), F.lit(1).cast("long").alias("last"), (F.col("id") % 2).alias("depth"), F.col("id").cast("int").alias("kind"), F.lit(None).cast("string").alias("leaf"))
    pairs = spark.range(20).select(F.col("id").alias("a")).crossJoin(spark.range(20).select(F.col("id").alias("b"))).filter("a < b")
    found = similar_trees.refined(pairs, nodes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan  # pairs used to be in as few tasks as their bytes ask for
    assert {(r.distance, r.status) for r in found.collect()} == {(2, "rejected")} and found.count() == 190


def test_pairs_of_histograms_meet_no_other_table(spark):
    rows = [(t, k, 1) for t in range(30) for k in range(3 + t % 3) for _ in range(2)]
    vectors, members = similar_trees.histograms(spark.createDataFrame(rows, "tree long, kind int, depth int"))
    found = similar_trees.cosine_pairs(vectors, 1, 2, block=2)
    # counts of trees were joined with the pairs, and sent through the driver for it
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    n = {r.vector: r["count"] for r in members.groupBy("vector").count().collect()}
    assert sorted((r.a, r.b, r.n_a, r.n_b) for r in found.collect()) == [(a, b, n[a], n[b]) for a, b in combinations(range(3), 2)]
