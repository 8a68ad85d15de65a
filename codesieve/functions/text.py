"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that say nothing about a method's subject; fixed values.
STOP_WORDS = ("build", "create", "do", "get", "handle", "make", "process", "render", "run", "set", "update")
#: Paths of attributes that mark tests; fixed values.
TEST_PATHS = ("test", "tokio::test", "async_std::test", "gpui::test", "rstest", "rstest::rstest", "rstest_parametrize", "rstest::rstest_parametrize", "case", "rstest::case")
#: Paths of functions that panic; fixed values.
PANIC_PATHS = (
    "core::panicking::panic", "core::panicking::panic_fmt", "core::panicking::panic_nounwind", "core::panicking::panic_str",
    "core::panicking::panic_any", "core::panicking::begin_panic", "core::panicking::panic_display",
    "std::panicking::panic", "std::panicking::panic_fmt", "std::panicking::panic_any", "std::panicking::begin_panic", "std::panicking::panic_display",
    "std::panic::panic_any", "std::rt::panic_fmt", "std::rt::panic_display", "std::rt::begin_panic", "std::rt::begin_panic_fmt",
)


def segments(path: Column) -> Column:
    """Path segments between ``::``, empty ones left out."""
    return F.filter(F.split(path, "::"), lambda s: s != "")


def path_is(path: Column, *candidates: str) -> Column:
    """Whether the segments equal those of one of the candidates."""
    return F.array_join(segments(path), "::").isin(*candidates)


def is_test_attribute(path: Column, extra: tuple[str, ...] = ()) -> Column:
    s = segments(path)
    prelude = (F.size(s) == 4) & F.get(s, F.lit(0)).isin("core", "std") & (F.get(s, F.lit(1)) == "prelude") & (F.get(s, F.lit(3)) == "test")
    return path_is(path, *TEST_PATHS, *extra) | F.coalesce(prelude, F.lit(False))


def is_std_fs(label: Column) -> Column:
    t = F.trim(label)
    return t.rlike(r"^std::fs($|::)") & ~t.rlike(r"[\s()]")


def is_option_or_result(path: Column) -> Column:
    return F.coalesce(F.element_at(F.when(F.size(segments(path)) > 0, segments(path)), -1).isin("Option", "Result"), F.lit(False))


def starts_with_path(path: Column, prefix: Column) -> Column:
    """Prefix on segment boundaries."""
    p = segments(prefix)
    return (F.size(p) > 0) & (F.slice(segments(path), F.lit(1), F.greatest(F.size(p), F.lit(1))) == p)


def is_integration_root(path: Column) -> Column:
    """``tests/x.rs`` or ``tests/x/main.rs``."""
    return F.regexp_replace(path, r"\\", "/").rlike(r"(^|/)tests/([^/]+\.rs|[^/]+/main\.rs)$")


def keywords(identifier: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of an identifier: cut at other signs and at humps; repeats stay."""
    cut = F.regexp_replace(identifier, r"[^\p{L}\p{N}]+", " ")
    cut = F.regexp_replace(cut, r"(\p{Ll})(\p{Lu})", "$1 $2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(cut), " "), lambda w: (w != "") & ~w.isin(*stop_words))


def ratio_text(part: Column, whole: Column) -> Column:
    """Six decimals, cut off, not rounded; an empty whole is 0.000000."""
    p, w = part.cast("bigint"), F.when(whole == 0, F.lit(1)).otherwise(whole).cast("bigint")
    div = lambda a: F.call_function("div", a, w)
    text = F.format_string("%d.%06d", div(p), div((p % w) * F.lit(1_000_000).cast("bigint")))
    return F.when(whole == 0, F.lit("0.000000")).otherwise(text)


def duration_text(ms: Column) -> Column:
    """``Hh Mm S.mmms``, leading zero parts left out."""
    m = ms.cast("bigint")
    h, mi = F.floor(m / 3_600_000), F.floor(m / 60_000) % 60
    s = F.format_string("%d.%03ds", F.floor(m / 1000) % 60, m % 1000)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), mi.cast("string"), F.lit("m "), s)).when(mi > 0, F.concat(mi.cast("string"), F.lit("m "), s)).otherwise(s)


def library_parts(file_name: Column, prefix: str = "lib", suffix: str = ".so") -> Column:
    """struct(crate, toolchain) of ``<prefix>crate@toolchain<suffix>``; null where it isn't one."""
    import re

    pattern = f"^{re.escape(prefix)}([^@]+)@(.+){re.escape(suffix)}$"
    return F.when(file_name.rlike(pattern), F.struct(F.regexp_extract(file_name, pattern, 1).alias("crate"), F.regexp_extract(file_name, pattern, 2).alias("toolchain")))


def checksum(text: Column) -> Column:
    """The SHA-256 token at a text's start in lower case; null where there is none."""
    t = F.regexp_extract(F.trim(text), r"^([0-9a-fA-F]{64})(\s|$)", 1)
    return F.when(t != "", F.lower(t))


def example_violation(text: Column) -> Column:
    """``heading`` or ``fence``, whichever line comes first; null for neither."""
    lines = F.split(text, r"\r?\n")
    kind = lambda x: F.when(x.rlike(r"(?i)^\s*#+\s*examples:?\s*$"), F.lit("heading")).when(x.rlike(r"^\s*(```|~~~)"), F.lit("fence"))
    return F.get(F.filter(F.transform(lines, kind), lambda k: k.isNotNull()), F.lit(0))


def branch_phrase(count: Column, locale: Column) -> Column:
    """"branch" in the number that the language has for a count."""
    n = count.cast("string")
    language = F.split_part(locale, F.lit("-"), F.lit(1))
    welsh = (
        F.when(count == 0, "dim canghennau").when(count == 1, "un gangen").when(count == 2, "dwy gangen").when(count == 3, "tair cangen").when(count == 6, "chwe changen")
        .when(count.isin(4, 5), F.concat(n, F.lit(" cangen"))).otherwise(F.concat(n, F.lit(" canghennau")))
    )
    gaelic = F.when(count == 1, "1 meur").otherwise(F.concat(n, F.lit(" meuran")))
    english = F.when(count == 1, "1 branch").otherwise(F.concat(n, F.lit(" branches")))
    return F.when(language == "cy", welsh).when(language == "gd", gaelic).otherwise(english)


def pick_locale(supported: tuple[str, ...], *choices: Column, fallback: str = "en-GB") -> Column:
    """The first choice that is supported; blank and unknown ones are passed over."""
    return F.coalesce(*(F.when(F.trim(c).isin(*supported), F.trim(c)) for c in choices), F.lit(fallback))
