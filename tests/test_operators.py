"""Golden values and invariants of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from codesieve.functions import text as X, u64
from codesieve.operators import advice, cohesion, diagnostics, findings, lexer, pairs, rules, signal, sketch, tokens, trees
from codesieve.plans import trees as plans_trees
from codesieve.session import wrapping
from codesieve.sources import documents as sources


def labels(source, profile):
    return " ".join(t[1] for t in lexer.lex(source, profile))


def test_fnv_vectors(spark):
    assert u64.fnv_bytes(b"a") == 0xAF63BD4C8601B7BE and u64.fnv_bytes(b"ab") == 0x08326707B4EB37B8
    with wrapping(spark):
        row = spark.range(1).select(u64.hex16(u64.fnv(F.lit("a"))).alias("a"), u64.hex16(u64.fnv(F.lit("ab"))).alias("b"), u64.hex16(u64.splitmix64(u64.lit64(5))).alias("c"))
    r = row.first()
    assert (r.a, r.b) == ("af63bd4c8601b7be", "08326707b4eb37b8") and r.c == f"{u64._splitmix(5):016x}"


@pytest.mark.parametrize("source,profile,want", [
    ("fn demo(x: i32) { /* note */ x + 1 }\n", "T1", "fn demo ( x : i32 ) { x + 1 }"),
    ("fn demo<'a>(x: i32) { x + 1; let y = 'a; }", "T2", "fn <ID_0> < <ID_0> > ( <ID_1> : <ID_2> ) { <ID_1> + <NUM> ; let <ID_3> = <ID_0> ; }"),
    ("fn alpha(total: i32) { total + 1 }", "T2", "fn <ID_0> ( <ID_1> : <ID_2> ) { <ID_1> + <NUM> }"),
    ("#!/usr/bin/env rustc\nfn main() { let x = 1; }", "T1", "fn main ( ) { let x = 1 ; }"),
    ("r#match r#foo foo", "T1", "match foo foo"),
    ("'c' b'x' \"s\" b\"t\" r#\"u\"# 1.5", "T2", "<CHAR> <BYTE> <STR> <BYTE_STR> <STR> <NUM>"),
])
def test_lexer(source, profile, want):
    assert labels(source, profile) == want


@pytest.mark.parametrize("source,kind,start,end", [("let value =  ;", "UnsupportedToken", 12, 14), ("let value = /* open", "UnterminatedBlockComment", 12, 19), ('let value = "open', "UnterminatedLiteral", 12, 17)])
def test_lexer_errors(source, kind, start, end):
    with pytest.raises(lexer.LexError) as e:
        lexer.lex(source)
    assert (e.value.kind, e.value.start, e.value.end) == (kind, start, end)


def test_lexer_range():
    assert lexer.lex("fn demo() { value + 1 }", "T1")[5][2:] == (12, 17)


def test_lexed_frame(spark):
    df = spark.createDataFrame([("a", "T2", "fn a() {}"), ("b", "T2", "/* x"), ("c", None, None)], "fragment_id string, profile string, source_text string")
    r = {x.fragment_id: x for x in lexer.lexed(df).collect()}
    assert len(r["a"].tokens) == 6 and r["b"].tokens is None and "UnterminatedBlockComment" in r["b"].error and r["c"].tokens == []


def _prints(spark, hashes):
    return spark.createDataFrame([(1, i, h) for i, h in enumerate(hashes)], "doc_id long, pos int, hash long")


@pytest.mark.parametrize("hashes,window,want", [([9, 4, 4, 7], 3, [(2, 4)]), ([8, 3], 5, [(1, 3)]), ([5], 1, [(0, 5)]), ([-1, 2], 2, [(1, 2)])])
def test_winnow(spark, hashes, window, want):
    assert sorted((r.pos, r.hash) for r in tokens.winnow(_prints(spark, hashes), window).collect()) == want


def test_sketch_invariants():
    a = sketch.sketch([5, 7, 11, 13])
    assert (a == sketch.sketch([13, 11, 7, 5, 5])).all() and (a != sketch.sketch([1, 2])).any()
    with pytest.raises(ValueError, match="Empty"):
        sketch.sketch([])


@pytest.mark.parametrize("bands,rows", [(0, 4), (4, 0), (3, 42), (8, 8)])
def test_band_config(bands, rows):
    with pytest.raises(ValueError):
        sketch.check_bands(bands, rows)


def test_candidates_and_acceptance(spark):
    df = spark.createDataFrame([("alpha", [1, 2]), ("beta", [1, 2]), ("gamma", [1, 3])], "doc_id string, hashes array<long>")
    c = sketch.candidates(sketch.signatures(df))
    assert ("alpha", "beta") in {tuple(r) for r in c.collect()}
    s = pairs.scored(spark.createDataFrame([("alpha", "beta"), ("alpha", "gamma")], "left string, right string"), df)
    assert {(r.right, r.score) for r in s.collect()} == {("beta", "1.000000"), ("gamma", "0.333333")}
    assert [r.right for r in pairs.accepted(s, "T2").collect()] == ["beta"]
    assert pairs.accepted(s, "T2", type2=(1, 3)).count() == 2
    with pytest.raises(Exception, match="missing fragment"):
        pairs.scored(spark.createDataFrame([("alpha", "zeta")], "left string, right string"), df).collect()
    with pytest.raises(ValueError):
        pairs.check_threshold(0, 1)


def test_findings(spark):
    df = spark.createDataFrame([(1, "f", "u", 10), (2, "f", "u", 10), (3, "g", "u", 10), (4, None, "u", 1), (5, None, "u", 1)], "ord int, fp string, uri string, line int")
    assert sorted(r.ord for r in findings.keep_first(df, ["fp", "uri", "line"], ["ord"]).collect()) == [1, 3, 4, 5]
    t = spark.createDataFrame([("fn alpha() {\n    value();\n}\n", 13, 27), ("aáb", 0, 2), ("fn a() {}\n", 9, 12)], "text string, a int, b int")
    error = findings.range_error(F.col("text"), F.col("a"), F.col("b"))
    assert [x.e for x in t.select(error.alias("e")).collect()] == [None, "InvalidUtf8Boundary", "InvalidFingerprintRange"]
    r = t.filter(error.isNull()).select(findings.region(F.col("text"), F.col("a"), F.col("b")).alias("r")).first().r
    assert (r.start_line, r.start_column, r.end_line, r.end_column) == (2, 1, 3, 1)


def test_signal(spark):
    lines = spark.createDataFrame([(1, x) for x in range(10, 15)], "f int, line int")
    seg = spark.createDataFrame([(1, 10, 12, 1.0), (1, 12, 14, 2.0)], "f int, start int, end int, value double")
    assert [r.value for r in signal.raster(lines, seg, "f").orderBy("line").collect()] == [1, 1, 3, 2, 2]
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 0.0, 3.0, 0.0, 0.0])], "f int, line int, value double")
    assert [r.smoothed for r in signal.smooth(s, "f").orderBy("line").collect()] == [0, 1, 1, 1, 0]
    b = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 3.0, 3.2, 0.0, 3.1, 3.0, 0.0])], "f int, line int, smoothed double")
    assert signal.bumps(b, "f", 3.0, 2).count() == 2
    assert signal.settings(-1, 2).window == 3 and signal.settings(-1, 2).threshold == 2.5
    for w in (0, 2):
        with pytest.raises(ValueError):
            signal.check_window(w)


def test_cohesion(spark):
    rows = [("a", 1, "parse", ["input"], []), ("a", 2, "render", ["output"], []), ("b", 1, "a", ["x"], []), ("b", 2, "b", ["x", "y"], []), ("b", 3, "c", ["y"], []), ("c", 1, "p", [], ["q"]), ("c", 2, "q", [], []), ("c", 3, "r", [], ["r"])]
    df = spark.createDataFrame(rows, "type string, method long, name string, fields array<string>, calls array<string>")
    assert {r.type: r.lcom4 for r in cohesion.lcom4(df).collect()} == {"a": 2, "b": 1, "c": 2}
    d = spark.createDataFrame([(30, 0, 1), (60, 1, 2), (80, 0, 1), (30, 2, 1), (30, 0, 3)], "w int, b int, l int")
    assert [r[0] for r in d.select(cohesion.type_disposition(F.col("w"), F.col("b"), F.col("l"))).collect()] == ["pass", "warn", "pass", "deny", "deny"]
    ev = [("m", i, k, m) for i, (k, m) in enumerate([("structural", False), ("nesting", False), ("push", False), ("structural", False), ("nesting", False), ("pop", False)])]
    ev += [("x", i, k, m) for i, (k, m) in enumerate([("push", True), ("structural", False), ("nesting", False), ("pop", False)])]
    e = spark.createDataFrame(ev, "method string, seq int, kind string, from_expansion boolean")
    assert {r.method: r.score for r in cohesion.cognitive(e).collect()} == {"m": 3, "x": 1}


def test_advice(spark):
    assert advice.propagate(["beta", "alpha", "delta", "charlie"], [[(1, 5)], [(0, 5)], [(3, 5)], [(2, 5)]], 3)[0] == [1, 1, 3, 3]
    assert advice.propagate(["gamma", "alpha", "beta"], [[(1, 5), (2, 5)], [(0, 5)], [(0, 5)]], 1)[0] == [1, 1, 1]
    df = spark.createDataFrame([("s", "parse_tokens", ["grammar"]), ("s", "parse_nodes", ["grammar"]), ("s", "build_render", [])], "subject string, method string, fields array<string>")
    df = df.withColumns({c: F.array().cast("array<string>") for c in ("domains", "signature_types", "local_types")})
    v = advice.features(df)
    assert {r.method: r.norm2 for r in advice.norms(v).collect()} == {"parse_tokens": 44, "parse_nodes": 44}
    assert [(r.a, r.b, r.dot) for r in advice.edges(v).collect()] == [("parse_nodes", "parse_tokens", 40)]
    words = spark.range(1).select(X.keywords(F.lit("getHTTPServer_nameId")).alias("w")).first().w
    assert words == ["http", "server", "name", "id"]


def test_trees(spark):
    rows = [(1, 1, None, 0, 0, 1, None), (1, 2, 1, 0, 1, 2, "ident"), (1, 3, 1, 1, 1, 3, None), (1, 4, 3, 0, 2, 2, "ident"), (1, 5, 3, 1, 2, 4, "lit")]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, ordinal long, depth int, kind int, leaf string")
    assert {(r.kind, r.weight) for r in trees.histogram(df).collect()} >= {(1, str(2**63)), (2, str(2**62 + 2**61)), (4, str(2**61))}
    p = {r.production: r.n for r in trees.productions(df).collect()}
    assert p["1>2"] == p["3>4"] == p["1>3>2"] == 1 and "1>2>4" not in p
    swapped = df.withColumn("ordinal", -F.col("ordinal"))
    h = [trees.hashes(x).first().hash for x in (df, df, swapped, df.withColumn("leaf", F.upper("leaf")))]
    assert h[0] == h[1] != h[2] and h[3] != h[0]
    c = spark.createDataFrame([(0, 0, 10), (1, 2, 6), (2, 3, 7), (3, 9, 1)], "cover int, start long, end long")
    t = spark.createDataFrame([(1, 3, 6), (2, 8, 20)], "target int, start long, end long")
    assert [(r.target, r.cover) for r in trees.smallest_cover(t, c, 4).collect()] == [(1, 1)]


def test_lcom4_says_when_rounds_end(spark):
    rows = [("a", i, f"m{i}", [f"f{i}", f"f{i + 1}"], []) for i in range(30)]
    df = spark.createDataFrame(rows, "type string, method long, name string, fields array<string>, calls array<string>")
    assert [r.lcom4 for r in cohesion.lcom4(df).collect()] == [1]
    with pytest.raises(RuntimeError):
        cohesion.lcom4(df, rounds=1)


def test_tree_hash_of_large_trees(spark):
    """A tree beyond the node budget has a hash, the one that folding it in one piece gives."""
    n = trees.MOST_NODES + 5
    rows = [(t, "r", None, 0, 0, 1, None) for t in (1, 2, 3)] + [(t, f"k{i}", "r", i, 1, 2 + i % 3, "ident" if t == 3 and i == 7 else "y") for t in (1, 2, 3) for i in range(n)]
    df = spark.createDataFrame(rows, "tree long, node string, parent string, ordinal long, depth int, kind int, leaf string")
    head = lambda kind, leaf, kids: b"tree-1n" + kind.to_bytes(2, "little") + leaf + kids.to_bytes(8, "little")
    h = u64.fnv_bytes(head(1, b"n", n))
    for i in range(n):
        h = u64.fnv_bytes(u64.fnv_bytes(head(2 + i % 3, b"o", 0)).to_bytes(8, "little"), h)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(plans_trees, "_nodes", lambda spark, d: df)
        got = {r.tree: r.hash for r in plans_trees.tree_hash(spark, "").collect()}
    assert got[1] == got[2] == f"{h:016x}" and got[3] not in (None, got[1])
    assert {r.tree for r in trees.over_budget(df).collect()} == {1, 2, 3}


def test_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.is_test_attribute(F.lit("std::prelude::rust_2024::test"))) and not one(X.is_test_attribute(F.lit("core::prelude::test"))) and not one(X.is_test_attribute(F.lit("alloc::prelude::v1::test")))
    for text, want in (("# Examples", "heading"), ("# Examples:\nx", "heading"), ("   ```\nx", "fence"), ("~~~rust", "fence"), ("Heading\n# Example", None), ("inline `ticks`", None)):
        assert one(X.example_violation(F.lit(text))) == want
    p = spark.createDataFrame([("my_app::legacy_io",), ("my_app::legacy_io::reader",), ("my_app::legacy_io_utils",), ("my_app",)], "path string")
    kept = rules.excluded(p, spark.createDataFrame([("my_app::legacy_io",)], "prefix string"))
    assert sorted(r.path for r in kept.collect()) == ["my_app", "my_app::legacy_io_utils"]
    assert one(X.duration_text(F.lit(3723004))) == "1h 2m 3.004s" and one(X.ratio_text(F.lit(2), F.lit(3))) == "0.666666" and one(X.ratio_text(F.lit(0), F.lit(0))) == "0.000000"
    assert one(X.branch_phrase(F.lit(3), F.lit("cy"))) == "tair cangen"


def test_sources(spark, tmp_path):
    log = '{"$schema":"x","version":"2.1.0","runs":[{"tool":{"driver":{"name":"t","rules":[]}},"results":[{"ruleId":"R","message":{"text":"m"},"locations":[]}]}]}'
    (tmp_path / "a.json").write_text(log)
    r = sources.read_logs(spark, str(tmp_path / "a.json"))
    assert r.first().tool == "t" and "locations" not in sources.to_json(r).first().value
    with pytest.raises(ValueError):
        sources.parse_toml_manifest('[[package]]\nname="a"\n[[package]]\nname="a"\n')
    f = tmp_path / "m.json"
    assert sources.record_metrics(str(f), {"n": 1}) == ({"n": 1}, False)
    f.write_text("{broken")
    assert sources.record_metrics(str(f), {"n": 2}) == ({"n": 2}, True)
    libs = sources.libraries(spark.createDataFrame([("/x/liba@nightly.so",), ("/x/readme",)], "path string"))
    assert [(x.toolchain, x.crates) for x in libs.collect()] == [("nightly", ["a"])]


def test_ancestors(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "node long, parent long")
    got = {(r.node, r.ancestor, r.distance) for r in rules.enclosing(n).collect()}
    assert (4, 1, 3) in got and (3, 3, 0) in got and len(got) == 10


@pytest.mark.parametrize("profile", ["T1", "T2"])
def test_fingerprints_equal_windows(spark, profile):
    """One pass within each text gives what the relational operators give."""
    r = random.Random(4)
    texts = ["", None, "fn", "fn f ( x )", "été _a1 १२ 3.14 😀 ǅ", *(" ".join(r.choice(["fn", "x", "y", "z1", "42", "(", "é"]) for _ in range(r.randint(1, 40))) for _ in range(25))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    toks = tokens.tokens(df)
    toks = tokens.canonical(toks) if profile == "T2" else toks
    want = tokens.winnow(tokens.shingles(tokens.coded(toks), 3), 4)
    got = tokens.fingerprints(df, 3, 4, profile)
    key = lambda x: sorted((y.doc_id, y.pos, y.hash) for y in x.collect())
    assert key(got) == key(want) and got.count() > 50
    with pytest.raises(ValueError):
        tokens.fingerprints(df, 0, 4)
    with pytest.raises(ValueError):
        tokens.fingerprints(df, 3, 4, "T3")


def test_metrics_of_many_writers(tmp_path):
    """No update is lost, and a held lock is waited for in vain only for so long."""
    import fcntl
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "m.json")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: sources.record_metrics(path, {"n": 1, f"k{i % 3}": 2}), range(60)))
    assert sources.record_metrics(path, {}) == ({"n": 60, "k0": 40, "k1": 40, "k2": 40}, False)
    with open(f"{path}.lock", "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        with pytest.raises(TimeoutError):
            sources.record_metrics(path, {"n": 1}, patience=0.1)


def test_diagnostic_texts(spark):
    rows = [("Foo", 25, 1, 0, []), ("Foo", 118, 3, 0, [("parse", 31, 140)]), ("Foo", 118, 3, 5, [("parse", 31, 140), ("emit", 30, 90)])]
    df = spark.createDataFrame(rows, "name string, wmc int, lcom4 int, reach int, brain array<struct<name:string,cc:int,loc:int>>")
    c = F.col
    got = [r[0] for r in df.select(diagnostics.type_message(c("name"), c("wmc"), c("lcom4"), c("reach"), c("brain"))).collect()]
    assert got == [
        "`Foo` has WMC=25 and LCOM4=1.",
        "`Foo` has WMC=118, LCOM4=3, and a brain method `parse` (CC=31, LOC=140).",
        "`Foo` has WMC=118, LCOM4=3, foreign reach=5, and 2 brain methods: `parse` (CC=31, LOC=140), `emit` (CC=30, LOC=90).",
    ]
    helps = [r[0] for r in df.select(diagnostics.type_help(c("lcom4"), c("reach"), F.size("brain"))).collect()]
    assert helps[0] == diagnostics.TYPE_ADVICE and helps[2] == "Consider " + ", ".join(diagnostics.TYPE_HELP) + "."
    t = spark.createDataFrame([("Parser", 25, 15, 10, 40), ("Bare", 0, 0, 0, 0)], "name string, total int, required int, default int, cc int")
    got = [r[0] for r in t.select(diagnostics.trait_message(c("name"), c("total"), c("required"), c("default"), c("cc"))).collect()]
    assert got == ["`Parser` has 25 methods (15 required, 10 default) with default method complexity CC=40.", "`Bare` has 0 methods (0 required, 0 default)."]
    assert [r[0] for r in t.select(diagnostics.trait_help(c("total"), c("required"), c("cc"))).collect()][1] == diagnostics.TRAIT_ADVICE


def test_messages_and_order(spark):
    text = "struct<primary:string,note:string,help:string>"
    rows = spark.createDataFrame([("cy", "a", ("p", "⁨n⁩", "h")), ("cy", "b", ("p", "n", "h")), (None, "a", ("p", "n", "h"))], f"locale string, key string, fallback {text}")
    cat = spark.createDataFrame([("cy", "a", "P", None, "H"), ("cy", "b", "⁨P⁩!", "N", "H")], "locale string, key string, primary string, note string, help string")
    got = {(r.locale, r.key): (tuple(r.message), r.localized) for r in diagnostics.resolved(rows, cat).collect()}
    assert got == {("cy", "a"): (("p", "n", "h"), False), ("cy", "b"): (("P!", "N", "H"), True), (None, "a"): (("p", "n", "h"), False)}
    f = spark.createDataFrame([("B", None, "x"), ("A", "f", "y"), ("A", None, "z"), ("A", "f", "x")], "rule_id string, fragment string, message string")
    assert [tuple(r) for r in diagnostics.in_order(f).collect()] == [("A", None, "z"), ("A", "f", "x"), ("A", "f", "y"), ("B", None, "x")]
    p = spark.createDataFrame([("a::b::c",), ("a::b-x",), ("a::b",), ("a",)], "prefix string")
    assert [r.prefix for r in rules.ordered_prefixes(p).collect()] == ["a", "a::b", "a::b::c", "a::b-x"]
    inv = spark.createDataFrame([("t", "b"), ("t", "a")], "toolchain string, crate string")
    assert [tuple(r) for r in diagnostics.merged_inventory(inv, inv.filter("crate = 'b'")).collect()] == [("t", "a"), ("t", "b"), ("t", "b")]


ITEMS = "id string, parent string, name string, kind string, ordinal int, lo int, hi int, from_expansion boolean, is_test boolean"


@pytest.mark.parametrize("inner,generated,want", [
    ([("const", rules.HARNESS_DESCRIPTOR, 0, 1, 2)], False, True),
    ([("fn", "t", 0, 1, 2), ("const", "t", 5, 1, 2)], True, True),
    ([("fn", "t", 0, 1, 2), ("const", "t", 5, 1, 2)], False, False),
    ([("fn", "t", 0, 1, 2), ("const", "t", 1, 3, 4)], True, False),
    ([("fn", "t", 0, 1, 2), ("const", "t", 1, 3, 4), ("extern_crate", "test", 9, 0, 0)], True, True),
    ([("fn", "t", 0, 1, 2), ("const", "t", 2, 3, 4), ("extern_crate", "test", 9, 0, 0)], True, False),
    ([("fn", "t", 0, 1, 2), ("const", "u", 1, 1, 2)], True, False),
    ([], True, False),
])
@pytest.mark.parametrize("parent", [None, "outer"])
def test_companions(spark, inner, generated, want, parent):
    rows = [("f", parent, "case", "fn", 0, 9, 9, False, False), ("m", parent, "case", "mod", 1, 9, 9, generated, False), ("g", parent, "other", "fn", 2, 9, 9, False, False), ("h", "far", "case", "fn", 0, 0, 0, False, True)]
    rows += [(f"i{n}", "m", name, kind, o, lo, hi, False, False) for n, (kind, name, o, lo, hi) in enumerate(inner)]
    assert {r.id for r in rules.companions(spark.createDataFrame(rows, ITEMS)).collect()} == ({"f", "h"} if want else {"h"})


def test_statement_segments(spark):
    """Conditions, bodies, else arms and match arms; a let condition and macros give no predicate."""
    cols = "fn int, kind string, from_expansion boolean, test_start int, test_end int, test_is_let boolean, branches int, body_start int, body_end int, else_start int, else_end int"
    rows = [(1, "if", False, 1, 1, False, 3, 2, 3, 4, 6), (2, "if", False, 1, 1, True, 1, 2, 3, None, None), (3, "match_arm", False, None, None, None, None, 2, 3, None, None), (4, "while", True, 1, 1, False, 2, 2, 3, None, None), (5, "loop", False, None, None, None, None, 7, 8, None, None)]
    got = sorted(tuple(r) for r in signal.segments(spark.createDataFrame(rows, cols)).collect())
    assert got == [(1, 1, 1, 1.5), (1, 2, 3, 1.0), (1, 4, 6, 1.0), (2, 2, 3, 1.0), (3, 2, 3, 0.5), (3, 2, 3, 1.0), (5, 7, 8, 1.0)]


def test_arguments_spans_and_slots(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    atom = lambda kind, name, ok: tuple(one(rules.argument_atom(F.lit(kind), F.lit(name), F.lit(ok), F.array(F.lit("db")))))
    assert atom("local", "db", True) == ("fixture_local", "db") and atom("local", "x", True) == ("unsupported", None) and atom("const", "a::B", True) == ("const", "a::B")
    assert atom("literal", "1", False) == ("unsupported", None) and atom("call", "f", True) == ("unsupported", None)
    frame = lambda s, m: F.struct(F.lit(s).alias("span"), F.lit(m).alias("from_expansion"))
    outer = F.array(F.array(frame("out", False)), F.array(frame("in", False)), F.array(frame("macro", True)))
    assert one(rules.recovered_span(F.array(frame("c", True)), outer)) == "in" and one(rules.recovered_span(F.array(frame("c", False)), outer)) == "c"
    assert one(rules.recovered_span(F.array(frame("c", True)), F.array(F.array(frame("m", True))))) is None
    names = spark.createDataFrame([(1, 0, "user"), (1, 1, "cache"), (1, 2, "user"), (2, 0, "cache")], "p int, at int, name string")
    assert {tuple(r) for r in rules.local_slots(names, "p", "at", "name").collect()} == {(1, "user", 0), (1, "cache", 1), (2, "cache", 0)}
    e = spark.createDataFrame([("s", "a", "b", 5), ("s", "a", "c", 1)], "subject string, a string, b string, dot long")
    lab = spark.createDataFrame([("s", "a", "x"), ("s", "b", "x"), ("s", "c", "y")], "subject string, method string, community string")
    assert [tuple(r) for r in advice.unstable(e, lab).collect()] == [("s", "c", "y", "x")]
    err = lambda *v: one(advice.edge_error(*(F.lit(x) for x in v)))
    assert [err(1, 1, 1, 3), err(0, 3, 0, 3), err(0, 1, 0, 3), err(0, 1, 2, 3)] == ["NonCanonicalEdge", "EndpointOutOfRange", "ZeroWeight", None]


def test_run_emission(spark):
    """Byte ranges of tokens; messages, fingerprints and order of findings, each pair once."""
    import hashlib

    df = spark.createDataFrame([(1, "fn a(x) {\n  y }", 1), (2, "é a b c", 1), (3, "a b", 1), (4, None, 0), (5, "a b c", None)], "doc_id long, text string, first long")
    assert {r.doc_id: (r.start, r.end) for r in tokens.token_ranges(df, 3).collect()} == {1: (3, 6), 2: (3, 8), 3: (None, None), 4: (None, None), 5: (None, None)}
    t = spark.createDataFrame([(2, 1, "T2", "CLONE002"), (1, 2, "T1", "CLONE001"), (1, 2, "T1", "CLONE001")], "left long, right long, profile string, rule_id string")
    region = findings.region(F.lit("x\na b c"), F.lit(2), F.lit(5))
    hashes = pairs.token_hash(pairs.both_hashes(F.array(F.lit(-1), F.lit(5)).cast("array<long>"), F.array(F.lit(5), F.lit(7)).cast("array<long>")))
    rows = t.select("*", F.lit("0.950000").alias("score"), hashes.alias("token_hash"), *(F.concat(F.lit("d/"), F.col(c).cast("string")).alias(f"{s}_uri") for s, c in (("l", "left"), ("r", "right"))), region.alias("l_region"), region.alias("r_region"))
    got = findings.emitted(rows, 3, 4).collect()
    assert [r.message for r in got] == ["Type-1 clone: d/1:2:1-2:3 <-> d/2:2:1-2:3 (sim = 0.950000)", "Type-2 clone: d/2:2:1-2:3 <-> d/1:2:1-2:3 (sim = 0.950000)"]
    assert got[0].fragment == hashlib.sha256(b"1\x002\x00T1").hexdigest() and got[0].related_message == "Peer clone fragment: 2" and got[0].properties.jaccard == 0.95
    assert {r.token_hash for r in got} == {hashlib.sha256(b"".join(x.to_bytes(8, "big") for x in (5, 7, 2**64 - 1))).hexdigest()}


def test_acceptance_rejects_mixed_profiles(spark):
    """Pairs in any order come once, from the lesser key, sorted; other profiles, unknown keys and pairs of one key are errors."""
    rows = [(1, "T1", [1, 2, 3, 4]), (2, "T1", [1, 2, 3, 4]), (3, "T1", [1, 2, 9]), (4, "T2", [1, 2, 3, 4]), (5, "T2", [1, 2, 3])]
    fragments = spark.createDataFrame(rows, "doc_id long, profile string, hashes array<long>")
    at = lambda *p: spark.createDataFrame(list(p), "left long, right long")
    got = pairs.accept(at((5, 4), (2, 1), (1, 2), (1, 3), (4, 5)), fragments, (3, 4), (3, 4)).collect()
    assert [(r.left, r.right, r.profile, r.rule_id, r.intersection, r.union, r.score) for r in got] == [(1, 2, "T1", "CLONE001", 4, 4, "1.000000"), (4, 5, "T2", "CLONE002", 3, 4, "0.750000")]
    for bad, text in (((1, 4), "mixed profiles of pair 1,4"), ((1, 9), "missing fragment"), ((3, 3), "pair of one fragment 3,3")):
        with pytest.raises(Exception, match=text):
            pairs.accept(at(bad), fragments).collect()
    with pytest.raises(ValueError):
        pairs.accept(at((1, 2)), fragments, (3, 2))


def test_signed_sets_equal_the_steps(spark):
    """Both profiles in one pass have the sets, first places and lanes that fingerprints, hash sets and signatures give one by one."""
    docs = spark.createDataFrame([(1, "fn add(a, b) { return a + b + 10; } fn sub(x, y) { return x - y; }"), (2, "fn add(c, d) { return c + d + 7; } fn sub(x, y) { return x - y; }"), (3, "one two"), (4, None), (5, "fn add(a, b) { return a + b + 10; } fn sub(x, y) { return x - y; }")], "doc_id long, text string")
    signed = sketch.signed_sets(docs.repartition(2), 4, 3)
    got = {(r.doc_id, r.profile): (r.hashes, r.lanes, r.first) for r in signed.collect()}
    for p in ("T1", "T2"):
        prints = tokens.fingerprints(docs, 4, 3, p)
        first = {r.doc_id: r.m for r in prints.groupBy("doc_id").agg(F.min("pos").alias("m")).collect()}
        want = {(r.doc_id, p): (r.hashes, r.lanes, first[r.doc_id]) for r in sketch.signatures(sketch.hash_sets(prints)).collect()}
        assert {k: v for k, v in got.items() if k[1] == p} == want and len(want) == 3
    kept = sketch.first_of_each(signed).collect()
    assert sorted((r.doc_id, r.profile, r.copies) for r in kept) == [(1, "T1", 2), (1, "T2", 2), (2, "T1", 1), (2, "T2", 1)] or sorted((r.doc_id, r.profile, r.copies) for r in kept) == [(1, "T1", 2), (1, "T2", 3), (2, "T1", 1)]
    near = sketch.candidates(sketch.first_of_each(signed), within=("profile",)).collect()
    assert all(r.left < r.right for r in near)


def test_sites_are_listed_in_source_order(spark):
    calls = spark.createDataFrame([("h", "t2", 9, 10, 1, "a"), ("h", "t1", 3, 4, 1, "b"), ("h", "t1", 3, 4, 1, "a"), ("h", "t3", 3, 5, 0, "c"), ("g", "t1", 1, 2, 1, "a"), ("g", "t1", 5, 6, 1, "a")], "callee string, test string, lo long, hi long, id long, shape string")
    got = [tuple(r) for r in rules.listed_sites(calls).orderBy("callee", "place").collect()]
    assert got == [("h", 1, 3, 4, 1, "t1", "a"), ("h", 2, 3, 5, 0, "t3", "c"), ("h", 3, 9, 10, 1, "t2", "a")]


def test_paths_of_a_long_chain_and_of_a_circle(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(21)] + [("x", "gone")], "node string, parent string")
    got = {(r.node, r.ancestor, r.distance) for r in rules.enclosing(chain).collect()}
    assert got == {(f"n{i}", f"n{j}", i - j) for i in range(21) for j in range(i + 1)} | {("x", "x", 0), ("x", "gone", 1)}
    with pytest.raises(ValueError, match="circle"):
        rules.enclosing(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"), rounds=4)
