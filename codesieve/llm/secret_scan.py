"""Secret scans by a trigram inverted index; DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over the trigrams that every match must
hold (in lower case). The index has a posting (gram, doc_id) for each gram of the queries and document
that holds it. Postings are met per document and the queries decide which rules a document may match;
only those are verified with the regular expression. Rules without a mandatory trigram scan every text.

Spans are code points, end exclusive, of leftmost non-overlapping matches: matches and the text between
them come from one pattern by ``regexp_extract_all`` and ``split``, and positions are running lengths.

Cases: null text is the empty text and has no span; rows that repeat a doc_id share its postings and are
verified each; a null doc_id has its own postings (null-safe join); an empty table gives no row; other
columns are ignored, or kept by ``redact``. Very many matches in one text cost the square of their count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from . import shared

#: Ids of candidate documents are broadcast up to this count (16 MB), beyond it they are joined by shuffle.
MOST_BROADCAST = 1_000_000
MOST_STRINGS = 64
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length ``least`` bounds
    least: int = 1


#: The first three are the base; runs of one class are written with their least length, which gives the same matches.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 30),
)
BASE = 3

#: A query is True (any text), a gram, or ("and" | "or", queries).
Query = object


def _both(op: str, parts: list) -> Query:
    """Simplified and/or of queries."""
    if op == "and":
        parts = list(dict.fromkeys(p for p in parts if p is not True))
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    sets = [grams(p) if isinstance(p, str) or p[0] == "and" and all(isinstance(q, str) for q in p[1]) else None for p in parts]
    weak = {i for i, x in enumerate(sets) if x is not None and any(y is not None and y < x for y in sets)}  # another part holds wherever this does
    parts = [p for i, p in enumerate(parts) if i not in weak]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """One of the strings is in the text."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _exact(items) -> set[str] | None:
    """The strings that a parsed sequence matches, in lower case, if they are few."""
    out = {""}
    for op, arg in items:
        name, these = str(op), None
        if name == "LITERAL":
            these = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            these = {chr(a).lower() for _, a in arg}
        elif name == "BRANCH":
            parts = [_exact(p) for p in arg[1]]
            these = set().union(*parts) if all(p is not None for p in parts) else None
        elif name == "SUBPATTERN":
            these = _exact(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 4 and (one := _exact(arg[2])) is not None:
            these = set()
            for n in range(arg[0], arg[1] + 1):
                if len(one) ** n > MOST_STRINGS:
                    return None
                these |= {"".join(p) for p in product(one, repeat=n)}
        elif name == "AT":
            these = {""}
        if these is None or len(out) * len(these) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in these}
    return out


def _query(items) -> Query:
    """What every match of a parsed sequence holds."""
    parts, run = [], {""}

    def flush():
        nonlocal run
        parts.append(_of_strings(run))
        run = {""}

    for item in items:
        name, arg = str(item[0]), item[1]
        exact = _exact([item])
        if exact is not None:
            if len(run) * len(exact) > MOST_STRINGS:
                flush()
            run = {a + b for a in run for b in exact}
            continue
        flush()
        if name == "BRANCH":
            parts.append(_both("or", [_query(p) for p in arg[1]]))
        elif name == "SUBPATTERN":
            parts.append(_query(arg[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            parts.append(_query(arg[2]))
    flush()
    return _both("and", parts)


def trigram_query(pattern: str) -> Query:
    """Boolean query of lower-case trigrams that a text with a match satisfies; True if there is none."""
    return _query(list(re._parser.parse(pattern)))


def grams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(grams(q) for q in query[1]))


def satisfied(query: Query, held: Column) -> Column:
    """Whether a document with the grams ``held`` (an array) satisfies the query."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [satisfied(q, held) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """The inverted index: (gram, doc_id), in parts by document, each sorted by gram."""
    each = F.array(*(F.lit(g) for g in sorted(wanted)))
    held = F.transform(F.array(F.lower("text")), lambda t: F.filter(each, lambda g: F.contains(t, g)))[0]  # lower() once a text
    rows = docs.select("doc_id", F.explode(held).alias("gram"))
    return shared.staged(rows.sortWithinPartitions("gram", "doc_id"), "postings")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, hit): the indexed rules, by place, that a document may match."""
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q is not True}
    index = postings(docs, set().union(*(grams(q) for q in indexed.values())))
    met = index.groupBy("doc_id").agg(F.collect_set("gram").alias("held"))  # as many grams as the rules have, at most
    hit = F.array_compact(F.array(*(F.when(satisfied(q, F.col("held")), F.lit(i)) for i, q in indexed.items())))
    return shared.staged(met.select("doc_id", hit.alias("hit")).filter(F.size("hit") > 0), "candidates")


def _spans(rule: Rule, place: int) -> Column:
    """The rule's spans in ``text``."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    group = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["gap"])
        end = first + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct(first.alias("start"), F.lit(place).alias("kind"), end.alias("end"))
        fits = F.coalesce(F.length(x["group"]) >= rule.least, F.lit(False))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.when(fits, F.array(span)).otherwise(none).cast(SPAN)).cast(SPAN).alias("out"))

    zipped = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), whole.alias("whole"), group.alias("group"))
    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(F.col("text").rlike(rule.pattern), found).otherwise(none)


def _located(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``docs`` (doc_id, text and at most a column ``row``) with ``found``."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    hits = candidates(docs.select("doc_id", "text"), rules)
    small = hits.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    hits = hits.select(F.col("doc_id").alias("_hit_id"), F.col("hit").alias("_hit"))
    joined = docs.join(F.broadcast(hits) if small else hits, F.col("doc_id").eqNullSafe(F.col("_hit_id")), "left")
    indexed = [trigram_query(r.pattern) is not True for r in rules]
    none = F.array().cast(SPAN)
    each = [F.when(F.array_contains("_hit", i), _spans(r, i)).otherwise(none) if indexed[i] else _spans(r, i) for i, r in enumerate(rules)]
    return joined.withColumn("found", F.array_sort(F.concat(*each))).drop("_hit_id", "_hit")


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and ``found``: all rules' spans (start, kind, end), by start, then kind; an empty array where there is none."""
    return _located(docs.select("doc_id", "text"), rules)


def _said(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(place: int):
    return lambda s: s["kind"] == place


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    out = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rules)
    counts = [F.size(F.filter("found", _of_kind(i))).cast("long").alias(f"n_{rules[i].kind}") for i in range(base)]
    first = F.filter("found", lambda s: s["kind"] < base)
    return out.select("doc_id", *counts, F.sha2(_said(first, rules), 256).alias("base_sha256"), _said(F.col("found"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each found secret replaced by its kind in brackets; ``n_chars`` follows where it exists."""
    columns = docs.columns
    names = F.array(*(F.lit(f"[{r.kind}]") for r in rules))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]  # a span within one that is out already adds nothing
        kept = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), names[s["kind"]])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, kept).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    # the row's columns stand in a struct, where no name of theirs can clash
    out = _located(docs.select("doc_id", "text", F.struct("*").alias("row")), rules).select("row", F.when(F.size("found") > 0, text).alias("new"))
    changed = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema["n_chars"].dataType if "n_chars" in columns else "long")}
    old = F.col("row")
    return out.select(*(F.coalesce(changed[c], old[c]).alias(c) if c in changed else old[c].alias(c) for c in columns))
