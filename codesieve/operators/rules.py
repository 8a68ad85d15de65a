"""Rule predicates over tables of facts, and the registry of rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import meta, text as X
from ..session import staged
from .nested import running

#: Rows that a broadcast may have, and nodes below an ancestor that meets them by a join.
MOST_BROADCAST, MOST_BELOW = 100_000, 100_000

#: Name of the constant that marks a generated test module, and attribute paths; fixed values.
HARNESS_DESCRIPTOR = "RSTEST_HARNESS_DESCRIPTOR"
TEST_MARKERS = ("rstest", "rstest::rstest")
FIXTURE_MARKERS = ("fixture", "rstest::fixture")


def enclosing(nodes: DataFrame, node: str = "node", parent: str = "parent", rounds: int = 32) -> DataFrame:
    """(node, ancestor, distance); a node is its own ancestor at distance 0, and the shortest of several paths counts.

    Only the frontier doubles: the ancestors at exactly 2^k steps lead to what was found from there. A round joins one row a node with
    the rows of an ancestor; after ``rounds`` of them, 2^32 steps with the default, the parents run in a circle, which is an error.
    """
    own = nodes.select(F.col(node).alias("node")).distinct()
    step = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).filter("ancestor is not null").distinct().transform(staged)
    absent = step.select(F.col("ancestor").alias("node")).distinct().join(own, "node", "left_anti").transform(staged)
    reach = own.unionByName(absent).select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")).transform(staged)
    turn = 0
    while not step.isEmpty():
        if turn == rounds:
            raise ValueError("parents run in a circle")
        far = step.withColumnRenamed("ancestor", "middle")
        middles = far.select("middle").distinct().transform(staged)
        longer = far.join(_met(reach, middles), "middle").select("node", "ancestor", (F.col("distance") + (1 << turn)).alias("distance"))
        reach = reach.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")).transform(staged)
        step = far.join(_met(step, middles), "middle").select("node", "ancestor").distinct().transform(staged)
        turn += 1
    return reach.join(absent, "node", "left_anti").withColumn("distance", F.col("distance").cast("int"))


def _met(rows: DataFrame, middles: DataFrame) -> DataFrame:
    """``rows`` by ``middle``, of the asked-for middles alone. Few are broadcast: what lies below a root then stays where it is, not in the root's task."""
    found = rows.withColumnRenamed("node", "middle").join(middles, "middle", "left_semi").transform(staged)
    return F.broadcast(found) if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else found


def context(sites: DataFrame, ancestors: DataFrame, items: DataFrame) -> DataFrame:
    """Sites with ``in_test`` and ``in_main``: whether an enclosing item has a test attribute, or is ``main``. ``items``: node, name, attributes (array of paths)."""
    flags = items.select(F.col("node").alias("ancestor"), F.exists("attributes", lambda a: X.is_test_attribute(a)).alias("t"), (F.col("name") == "main").alias("m")).filter("t or m")
    # ancestors of very many nodes meet them by a broadcast; there is at most one of them for each MOST_BELOW rows
    hot = ancestors.filter("distance > 0").groupBy("ancestor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_BELOW).select("ancestor").transform(staged)
    top = ancestors.join(F.broadcast(flags.join(F.broadcast(hot), "ancestor", "left_semi")), "ancestor")
    rest = ancestors.join(F.broadcast(hot), "ancestor", "left_anti").join(flags, "ancestor")
    found = top.unionByName(rest).groupBy("node").agg(F.bool_or("t").alias("in_test"), F.bool_or("m").alias("in_main"))
    return sites.join(found, "node", "left").fillna(False, ["in_test", "in_main"])


def closure_panics(ancestors: DataFrame, calls: DataFrame) -> DataFrame:
    """(node, panics, interpolated_only) of closures from the calls below them. ``calls``: node, path, interpolated."""
    # a node's calls are one row before they meet its ancestors
    p = calls.filter(X.path_is(F.col("path"), *X.PANIC_PATHS)).groupBy("node").agg(F.bool_and("interpolated").alias("interpolated"))
    return ancestors.join(p, "node").groupBy(F.col("ancestor").alias("node")).agg(F.bool_and("interpolated").alias("interpolated_only")).select("node", F.lit(True).alias("panics"), "interpolated_only")


def panic_is_flagged(panics: Column, doctest: Column, in_test: Column, interpolated_only: Column, in_main: Column, allow_in_main: bool = False) -> Column:
    return panics & ~doctest & ~(in_test & interpolated_only) & ~(in_main & F.lit(allow_in_main))


def expect_is_flagged(method: Column, receiver: Column, in_test: Column, doctest: Column, path: Column) -> Column:
    return (method == "expect") & X.is_option_or_result(receiver) & ~in_test & ~doctest & ~X.is_integration_root(path)


def std_fs_sites(sites: DataFrame, excluded_crates: DataFrame, excluded_paths: DataFrame) -> DataFrame:
    """Sites (crate, path, label) of std::fs outside of the excluded crates and path prefixes."""
    hit = sites.filter(X.is_std_fs(F.col("label"))).join(excluded_crates, "crate", "left_anti")
    good = excluded_paths.filter(F.col("prefix").rlike(r"^[^:\s]+(::[^:\s]+)*$"))
    return excluded(hit, good)


def excluded(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows whose ``path`` starts with no prefix (on segment boundaries): each path meets its own prefixes by equality."""
    own = paths.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(X.segments(F.col("path"))), F.lit(1))), lambda n: F.array_join(F.slice(X.segments(F.col("path")), F.lit(1), n), "::"))).alias("prefix"))
    gone = own.join(prefixes.select(F.array_join(X.segments(F.col("prefix")), "::").alias("prefix")), "prefix", "left_semi").select("path").distinct()
    return paths.join(gone, "path", "left_anti").select(*paths.columns)


def misordered(attributes: DataFrame, key: str, order: str, is_doc: Column) -> DataFrame:
    """(key, pos): the first doc attribute behind one that isn't."""
    w = Window.partitionBy(key)
    first = F.min(F.when(~is_doc, F.col(order))).over(w)
    return attributes.withColumn("_first", first).filter(is_doc & (F.col(order) > F.col("_first"))).groupBy(key).agg(F.min(order).alias("pos"))


def long_modules(modules: DataFrame, limit: int = 400) -> DataFrame:
    return modules.filter((F.col("n_lines") > limit) & ~F.col("from_expansion"))


def branches(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(root, branches): leaves of conditions; and/or add, not/drop_temps/block/if are transparent. ``nodes``: node, root, kind, has_children."""
    leaf = nodes.filter(~F.col("kind").isin("and", "or", "not", "drop_temps", "block", "if"))
    inner = nodes.filter(~F.col("kind").isin("and", "or", "not", "drop_temps", "block", "if")).select(F.col("node").alias("ancestor"))
    below = ancestors.filter("distance > 0").join(inner, "ancestor", "left_semi").select("node").distinct()
    return leaf.join(below, "node", "left_anti").groupBy("root").agg(F.count(F.lit(1)).alias("branches"))


def over_branched(counts: DataFrame, most: int = 2) -> DataFrame:
    return counts.filter(F.col("branches") > max(1, most))


def parameter_kind(is_identifier: Column, provider: Column) -> Column:
    return F.when(~is_identifier, "unsupported_pattern").when(provider, "provider").otherwise("fixture_local")


def editable_span(frames: Column) -> Column:
    """struct(kind, span) of the first frame (span, from_expansion) that isn't a macro's."""
    own = F.get(F.filter(frames, lambda f: ~f["from_expansion"]), F.lit(0))
    return F.when(own.isNull(), F.struct(F.lit("macro_only").alias("kind"), F.lit(None).cast("string").alias("span"))).otherwise(
        F.struct(F.when(F.get(frames, F.lit(0))["from_expansion"], "recovered").otherwise("direct").alias("kind"), own["span"].alias("span"))
    )


def call_sites(calls: DataFrame, min_calls: int = 2, min_tests: int = 2) -> DataFrame:
    """Helpers by callee: each location once, in source order. ``calls``: callee, test, lo, hi, id, shape."""
    each = calls.dropDuplicates(["callee", "lo", "hi", "id"])
    out = each.groupBy("callee").agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("test").alias("n_tests"), F.min(F.struct("lo", "hi", "id")).alias("first"))
    return out.filter((F.col("n_calls") >= max(2, min_calls)) & (F.col("n_tests") >= max(2, min_tests)))


def listed_sites(calls: DataFrame, min_calls: int = 2, min_tests: int = 2) -> DataFrame:
    """(callee, place, lo, hi, id, test, shape): the sites of ``call_sites``' helpers, each location once with the first test by name, in source order from 1; a callee's sites need no one task."""
    each = calls.groupBy("callee", "lo", "hi", "id").agg(F.min(F.struct("test", "shape")).alias("x")).select("callee", "lo", "hi", "id", "x.test", "x.shape")
    kept = each.join(call_sites(calls, min_calls, min_tests).select("callee"), "callee")
    out = running(kept.withColumn("_one", F.lit(1).cast("long")), ["callee"], ["lo", "hi", "id"], {"_one": "place"})
    return out.select("callee", "place", "lo", "hi", "id", "test", "shape")


def argument_shape(atoms: Column) -> Column:
    """Kinds of the arguments without their values."""
    return F.array_join(F.transform(atoms, lambda a: a["tag"]), ",")


def harness_functions(functions: DataFrame, constants: DataFrame) -> DataFrame:
    """Functions with a constant of the same name and span."""
    c = constants.select("name", "lo", "hi", F.col("id").alias("_other"))
    return functions.alias("f").join(c.alias("c"), (F.col("f.name") == F.col("c.name")) & (F.col("f.lo") == F.col("c.lo")) & (F.col("f.hi") == F.col("c.hi")) & (F.col("f.id") != F.col("c._other")), "left_semi")


def companions(items: DataFrame) -> DataFrame:
    """``id`` of functions that have a test attribute or, in the same module, a qualifying module of their name.

    ``items``: id, parent (null at the top), name, kind (fn, mod, const, extern_crate), ordinal, lo, hi, from_expansion, is_test;
    modules of any depth are rows, so each level is matched alike. A module qualifies if it holds a constant named
    HARNESS_DESCRIPTOR, or if it comes from a macro and holds a function and a constant of one name that share a span, or
    stand next to each other where the module imports the test crate.
    """
    fns, consts = items.filter("kind = 'fn'"), items.filter("kind = 'const'")
    marker = consts.filter(F.col("name") == HARNESS_DESCRIPTOR).select("parent")
    imports = items.filter("kind = 'extern_crate' and name = 'test'").select(F.col("parent").alias("_p")).distinct()
    c = consts.join(imports, F.col("parent") == F.col("_p"), "left").select("parent", "name", F.col("ordinal").alias("_ordinal"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("_p").isNotNull().alias("_imports"))
    near = ((F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))) | (F.col("_imports") & (F.abs(F.col("ordinal") - F.col("_ordinal")) == 1))
    paired = fns.join(c, ["parent", "name"]).filter(near).select("parent")
    modules = items.filter("kind = 'mod'")
    good = modules.join(marker.select(F.col("parent").alias("id")), "id", "left_semi").unionByName(modules.filter("from_expansion").join(paired.select(F.col("parent").alias("id")), "id", "left_semi"))
    m = good.select(F.col("parent").alias("_parent"), F.col("name").alias("_name")).distinct()
    beside = fns.join(m, F.col("parent").eqNullSafe(F.col("_parent")) & (F.col("name") == F.col("_name")), "left_semi")
    return beside.select("id").unionByName(fns.filter("is_test").select("id")).distinct()


def expect_violations(sites: DataFrame, ancestors: DataFrame, items: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Sites (node, method, receiver, doctest, path) of ``expect`` outside of tests; ``marked``: ids of functions that the harness marks."""
    s = context(sites, ancestors, items)
    if marked is not None:
        inside = ancestors.join(marked.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("node").distinct()
        s = s.join(inside, "node", "left_anti")
    return s.filter(expect_is_flagged(F.col("method"), F.col("receiver"), F.col("in_test"), F.col("doctest"), F.col("path")))


def panic_violations(sites: DataFrame, ancestors: DataFrame, items: DataFrame, calls: DataFrame, allow_in_main: bool = False) -> DataFrame:
    """Closures (node, doctest) of ``unwrap_or_else`` that panic against the policy; ``calls`` as for ``closure_panics``."""
    s = context(sites, ancestors, items).join(closure_panics(ancestors, calls), "node")
    return s.filter(panic_is_flagged(F.col("panics"), F.col("doctest"), F.col("in_test"), F.col("interpolated_only"), F.col("in_main"), allow_in_main))


def split_attributes(attributes: Column) -> Column:
    """struct(docs, rest) of an array of (path, inner)."""
    is_doc = lambda a: X.path_is(a["path"], "doc")
    return F.struct(F.filter(attributes, is_doc).alias("docs"), F.filter(attributes, lambda a: ~is_doc(a)).alias("rest"))


def outer_attributes(attributes: Column) -> Column:
    return F.filter(attributes, lambda a: ~a["inner"])


def has_marker(attributes: Column, candidates: tuple[str, ...], trace: Column | None = None) -> Column:
    """Whether an attribute's path is a candidate or, where a trace (array of paths) is given, one of the trace's is."""
    found = F.exists(attributes, lambda a: X.path_is(a["path"], *candidates))
    return found if trace is None else found | F.coalesce(F.exists(trace, lambda p: X.path_is(p, *candidates)), F.lit(False))


def argument_atom(kind: Column, name: Column, editable: Column, locals_: Column) -> Column:
    """struct(tag, value) of an argument: a fixture's local, a constant's path, a literal; all else stays as ``unsupported``."""
    atom = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.alias("value"))
    plain = (kind == "local") & F.array_contains(locals_, name)
    taken = F.when(plain, atom("fixture_local", name)).when(kind == "const", atom("const", name)).when(kind == "literal", atom("literal", name))
    return F.coalesce(F.when(editable, taken), atom("unsupported", F.lit(None).cast("string")))


def recovered_span(frames: Column, enclosing_frames: Column) -> Column:
    """The span that a user can edit: the call's own or that of the innermost enclosing closure that has one; null without any."""
    fallback = F.filter(F.transform(F.reverse(enclosing_frames), lambda x: editable_span(x)["span"]), lambda x: x.isNotNull())
    return F.coalesce(editable_span(frames)["span"], F.get(fallback, F.lit(0)))


def local_slots(names: DataFrame, paragraph: str, order: str, name: str) -> DataFrame:
    """(paragraph, name, slot): numbers of a paragraph's locals by first appearance, from 0."""
    first = names.groupBy(paragraph, name).agg(F.min(order).alias("_first"))
    return first.select(paragraph, name, (F.row_number().over(Window.partitionBy(paragraph).orderBy("_first", name)) - 1).alias("slot"))


def ordered_prefixes(prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Path prefixes by their segments, so that a module comes before what lies in it."""
    return prefixes.orderBy(X.segments(F.col(prefix)))


#: Rule name to what it reports.
REGISTRY: dict[str, Callable] = {
    "no_expect_outside_tests": expect_violations, "no_unwrap_or_else_panic": panic_violations, "no_std_fs_operations": std_fs_sites,
    "function_attrs_follow_docs": misordered, "test_must_not_have_example": X.example_violation, "module_must_have_inner_docs": meta.leading_content,
    "module_max_lines": long_modules, "conditional_max_n_branches": over_branched, "rstest_helper_should_be_fixture": call_sites,
}
