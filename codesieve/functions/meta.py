"""Attribute texts as column expressions: meta lists, cfg predicates, what a module begins with.

Scanners are folds over tokens whose state is a depth or a stack; attributes nested in attributes
are unfolded a level at a time. Null texts give null, empty ones are ``missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space of any script.
WS = r"(?U)\s"
_TOKEN = r'"(?:[^"\\]|\\.)*"|[\w:]+|[(),]'


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+", "")


def identifier(text: Column) -> Column:
    """The ASCII identifier that ``text`` begins with behind white space; empty without one."""
    return F.regexp_extract(trimmed(text), r"^[A-Za-z_][A-Za-z0-9_]*", 0)


def _behind(text: Column) -> Column:
    """What follows the leading identifier."""
    return F.regexp_replace(trimmed(text), r"^[A-Za-z_][A-Za-z0-9_]*", "")


def entries(content: Column) -> Column:
    """The parts of a list between commas outside of parentheses; a stray closing one counts for nothing."""
    chars = F.regexp_extract_all(content, F.lit(r"[^(),]+|[(),]"), 0)
    state = lambda depth, cur, done: F.struct(depth.cast("int").alias("depth"), cur.alias("cur"), done.alias("done"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c == "(", s["depth"] + 1).when(c == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cut = (c == ",") & (s["depth"] == 0)
        return state(depth, F.when(cut, F.lit("")).otherwise(F.concat(s["cur"], c)), F.when(cut, F.array_append(s["done"], s["cur"])).otherwise(s["done"]))

    return F.aggregate(chars, state(F.lit(0), F.lit(""), F.array().cast("array<string>")), step, lambda s: F.array_append(s["done"], s["cur"]))


def arguments(tail: Column) -> Column:
    """Entries of ``( .. )`` up to the last closing parenthesis; null where ``tail`` isn't of that form."""
    return _let(trimmed(tail), lambda t: F.when(t.rlike(r"(?s)^\(.*\)"), entries(F.regexp_extract(t, r"(?s)^\((.*)\)", 1))))


def balanced_arguments(tail: Column) -> Column:
    """Entries of ``( .. )`` up to the parenthesis that closes the first one; null where there is none."""
    state = lambda depth, cur, closed: F.struct(depth.cast("int").alias("depth"), cur.alias("cur"), closed.alias("closed"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c == "(", s["depth"] + 1).when(c == ")", s["depth"] - 1).otherwise(s["depth"])
        open_ = s["depth"] > 0
        ends = open_ & (depth == 0)
        return F.when(s["closed"], s).otherwise(state(depth, F.when(open_ & ~ends, F.concat(s["cur"], c)).otherwise(s["cur"]), ends))

    def closed(t: Column) -> Column:
        done = F.aggregate(F.regexp_extract_all(t, F.lit(r"[^()]+|[()]"), 0), state(F.lit(0), F.lit(""), F.lit(False)), step)
        return F.when(t.startswith("("), _let(done, lambda d: F.when(d["closed"], entries(d["cur"]))))

    return _let(trimmed(tail), closed)


def _unfolded(attribute: Column, inner) -> Column:
    """The attributes that nested ``cfg_attr`` wrappers lead to; ``inner`` gives a wrapper's entries to follow."""
    rounds = F.sequence(F.lit(1), F.size(F.regexp_extract_all(attribute, F.lit("cfg_attr"), 0)))
    rounds = F.when(attribute.contains("cfg_attr"), rounds).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<string>")
    return F.aggregate(rounds, F.array(attribute), lambda found, _: F.flatten(F.transform(found, lambda a: F.when(identifier(a) == "cfg_attr", F.coalesce(inner(a), none)).otherwise(F.array(a)))))


def _rest(listed: Column) -> Column:
    """Entries behind the first."""
    return _let(listed, lambda x: F.when(F.size(x) > 1, F.slice(x, F.lit(2), F.size(x) - 1)))


def names_doc(attribute: Column) -> Column:
    """Whether an attribute is ``doc``, or a ``cfg_attr`` with one behind its condition."""
    return F.exists(_unfolded(attribute, lambda a: _rest(arguments(_behind(a)))), lambda a: identifier(a) == "doc")


def misspelt_doc(attribute: Column) -> Column:
    """Whether an attribute is ``doc`` in other case, or a ``cfg_attr`` with one behind its condition."""
    return F.exists(_unfolded(attribute, lambda a: _rest(balanced_arguments(_behind(a)))), lambda a: (F.lower(identifier(a)) == "doc") & (identifier(a) != "doc"))


def inner_attribute(rest: Column) -> Column:
    """The body of ``#![ .. ]`` up to the first closing bracket or the end; null elsewhere."""
    return F.when(rest.rlike(rf"^#!{WS}*\["), F.regexp_extract(rest, rf"^#!{WS}*\[([^\]]*)", 1))


def is_inner_doc(rest: Column) -> Column:
    """Whether ``rest`` begins with an inner doc comment or attribute."""
    return rest.startswith("//!") | F.coalesce(names_doc(inner_attribute(rest)), F.lit(False))


def has_inner_doc(rest: Column) -> Column:
    """Whether a line begins with an inner doc, or one stands elsewhere behind ``#!``; an attribute at a line's begin ends with the line."""
    lines = F.exists(F.split(rest, "\n"), lambda line: is_inner_doc(trimmed(line)))
    parts = F.split(rest, "#!", -1)
    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))

    def elsewhere(i: Column) -> Column:
        before = F.array_join(F.slice(parts, F.lit(1), i), "#!")
        leads = F.regexp_extract(before, r"(?s)([^\n]*)$", 1).rlike(rf"^{WS}*$")
        return ~leads & is_inner_doc(F.concat(F.lit("#!"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "#!")))

    return lines | F.exists(places, elsewhere)


def leading_content(text: Column) -> Column:
    """struct(kind, offset, length) of what a module begins with: ``doc``, ``missing``, or ``misordered`` with the bytes of the attribute's line."""
    rest = trimmed(text)
    offset = (F.octet_length(text) - F.octet_length(rest)).cast("int")
    length = F.octet_length(F.regexp_extract(rest, r"^[^\r\n]*", 0)).cast("int")
    body = inner_attribute(rest)
    bare = F.coalesce((identifier(body) == "cfg_attr") & ~names_doc(body), F.lit(False))
    missing = ~rest.startswith("#") | F.coalesce(misspelt_doc(body), F.lit(False)) | bare | ~has_inner_doc(rest)
    kind = F.when(rest == "", "missing").when(is_inner_doc(rest), "doc").when(rest.startswith("#["), "misordered").when(missing, "missing").otherwise("misordered")
    at = lambda c: F.when(kind == "misordered", c)
    return F.when(text.isNotNull(), F.struct(kind.alias("kind"), at(offset).alias("offset"), at(length).alias("length")))


def cfg_contains_test(meta: Column, propagate: bool = True) -> Column:
    """Whether a cfg predicate asks for ``test`` or ``doctest``. With ``propagate`` a ``not`` turns what is nested in it; without, nested lists start positive again."""
    state = lambda stack, last, found: F.struct(stack.alias("stack"), last.alias("last"), found.alias("found"))

    def step(s: Column, t: Column) -> Column:
        top = F.element_at(s["stack"], -1)
        turned = F.when(s["last"] == "not", ~top if propagate else F.lit(False)).otherwise(top if propagate else F.lit(True))
        stack = F.when(t == "(", F.array_append(s["stack"], turned)).when((t == ")") & (F.size(s["stack"]) > 1), F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(s["stack"])
        return state(stack, t, s["found"] | (t.isin("test", "doctest") & top))

    return F.aggregate(F.regexp_extract_all(meta, F.lit(_TOKEN), 0), state(F.array(F.lit(True)), F.lit(""), F.lit(False)), step, lambda s: s["found"])


def is_cfg_test(attribute: Column) -> Column:
    """Whether ``cfg(..)`` asks for test, or ``cfg_attr(..)`` has such a condition and behind it an attribute that does."""

    def inner(a: Column) -> Column:
        return _let(arguments(_behind(a)), lambda listed: F.when(cfg_contains_test(F.element_at(listed, 1)), _rest(listed)))

    return F.exists(_unfolded(attribute, inner), lambda a: (identifier(a) == "cfg") & F.coalesce(F.exists(arguments(_behind(a)), lambda e: cfg_contains_test(e)), F.lit(False)))
