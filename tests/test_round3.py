"""Findings of round 3: each test failed before its change."""

import datetime
import random
from itertools import combinations

from pyspark.sql import functions as F

from codesieve.operators import advice, rules, similar_trees
from codesieve.plans import signal as plans_signal


def test_event_seconds_are_rounded(spark, tmp_path):
    at = lambda h, m, s, us: datetime.datetime(2024, 1, 9, h, m, s, us, tzinfo=datetime.timezone.utc)
    rows = [(1, at(17, 59, 59, 816118)), (1, at(18, 0, 1, 0)), (1, at(17, 59, 59, 400000)), (2, at(5, 59, 59, 499999)), (2, at(6, 0, 0, 0))]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = plans_signal._smooth(spark, str(tmp_path)).orderBy("entity", "line").collect()
    six = int(at(18, 0, 0, 0).timestamp()) // 21600
    assert [(r.entity, r.line, r.value) for r in got] == [(1, six - 1, 1.0), (1, six, 2.0), (2, six - 3, 1.0), (2, six - 2, 1.0)]


def test_excluded_paths_need_no_row_numbers(spark):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # rows are dealt again for each use, and uses that read other columns get other partitions
        p = spark.range(20_000).select("id", F.concat(F.lit("app::m"), (F.col("id") % 7).cast("string"), F.lit("::f")).alias("path"), F.sha2(F.col("id").cast("string"), 512).alias("label")).repartition("label")
        kept = rules.excluded(p, spark.createDataFrame([("app::m3",)], "prefix string")).select("id", "path").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.id for r in kept) == [i for i in range(20_000) if i % 7 != 3]


def _wide(spark, subjects, most, seed=5):
    draw = random.Random(seed)
    rows = [(f"s{s}", f"m{i}", [f"d{draw.randrange(4)}"], [f"T{draw.randrange(3)}"]) for s in range(subjects) for i in range(draw.randrange(2, most))]
    df = spark.createDataFrame(rows, "subject string, method string, domains array<string>, local_types array<string>")
    return df.withColumns({c: F.array().cast("array<string>") for c in ("fields", "signature_types")})


def test_edges_meet_in_blocks(spark):
    v = advice.features(_wide(spark, 6, 40)).localCheckpoint()
    found = advice.edges(v, block=7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join Inner" in x and "feature" in x]  # methods met by a join on features, a row for each two
    want = set()
    held: dict = {}
    for r in v.collect():
        held.setdefault(r.subject, {}).setdefault(r.method, {})[r.feature] = r.weight
    for s, ms in held.items():
        for a, b in combinations(sorted(ms), 2):
            dot = sum(w * ms[b].get(f, 0) for f, w in ms[a].items())
            if dot and 25 * dot * dot >= sum(w * w for w in ms[a].values()) * sum(w * w for w in ms[b].values()):
                want.add((s, a, b, dot))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in advice.edges(v).collect()} == want
    big = v.withColumn("weight", F.col("weight") * 100_000_000)  # beyond what doubles hold
    assert {tuple(r) for r in advice.edges(big, block=7).collect()} == {(s, a, b, dot * 10**16) for s, a, b, dot in want}
    labels = v.select("subject", "method").distinct().withColumn("community", F.substring("method", 2, 1))
    of = {(r.subject, r.method): r.community for r in labels.collect()}
    sums: dict = {}
    for s, a, b, dot in want:
        for x, y in ((a, b), (b, a)):
            sums[s, x, of[s, y]] = sums.get((s, x, of[s, y]), 0) + dot
    assert {(r.subject, r.node, r.theirs): r.votes for r in advice.votes(v, labels, block=7).collect()} == sums
    assert {tuple(r) for r in advice.unsettled(advice.votes(v, labels), labels).collect()} == {tuple(r) for r in advice.unstable(found, labels).collect()}


def test_swept_profiles_equal_communities(spark):
    p = _wide(spark, 12, 30, seed=8).localCheckpoint()
    v = advice.features(p).localCheckpoint()
    found = advice.communities(v, advice.edges(v)).localCheckpoint()
    want = {tuple(r) for r in found.collect()}
    rest = {tuple(r) for r in advice.suggestions(v, found).select("subject", "place", "community", "label").collect()}
    for most in (256, 12, 1):
        got = advice.swept(p, most=most).collect()
        assert {(r.subject, r.method, r.community) for r in got} == want and len(got) == len(want)
        told = advice.swept(p, with_features=True, most=most)
        assert {tuple(r) for r in advice.advised(told).select("subject", "place", "community", "label").collect()} == rest
        bad = {(r.subject, r.method) for r in got if r.heaviest is not None and r.heaviest != r.community}
        assert bad == {(r.subject, r.node) for r in advice.unstable(advice.edges(v), found).collect()}


def test_vector_pairs_meet_in_blocks(spark):
    draw = random.Random(3)
    rows = [(i, draw.randrange(3), [draw.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(900, None, [1.0] * 6), (901, 1, None), (902, 1, [1.0, None] * 3), (903, 1, [1.0] * 5)]
    found = similar_trees.vector_pairs(spark.createDataFrame(rows, "id bigint, label int, v array<double>"), 0.35, block=16)
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = {(a[0], b[0]): sum(x * y for x, y in zip(a[2], b[2])) / (norm(a[2]) * norm(b[2])) for a, b in combinations(rows[:150], 2) if a[1] == b[1]}
    got = {(r.left, r.right): r.cosine for r in found.collect()}
    assert got.keys() == {k for k, c in want.items() if c >= 0.35} and all(abs(c - want[k]) < 1e-12 for k, c in got.items())
