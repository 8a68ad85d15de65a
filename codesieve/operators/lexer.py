"""Exact lexing of Rust source into normalised tokens with byte ranges."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, types as T

from ..functions.u64 import fnv_bytes
from .tokens import KEYWORDS

TOKEN_TYPE = T.StructType([T.StructField("tag", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
#: Signs that stand for themselves; fixed values.
SIGNS = ";,.(){}[]@#~?:$=!<>-&|+*/^%"
_PARTS = re.compile(
    r"""(?P<space>[\t\n\v\f\r \x85‎‏  ]+)
    |(?P<line>//[^\n]*)
    |(?P<block>/\*)
    |(?P<rawstr>b?r(?P<h>\#*)")
    |(?P<bytes>b")|(?P<byte>b')|(?P<str>c?")
    |(?P<rawid>r\#[^\W\d]\w*)
    |(?P<id>[^\W\d]\w*)
    |(?P<num>0[xX][0-9a-fA-F_]+\w*|0[oO][0-7_]+\w*|0[bB][01_]+\w*|[0-9][0-9_]*(?:\.(?![._a-zA-Z])[0-9_]*)?(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*)
    |(?P<char>'(?:\\(?:u\{[^}']*\}|x..|.)|[^'\\\n])')
    |(?P<life>'[^\W\d]\w*)
    |(?P<quote>')
    |(?P<sign>[;,.(){}\[\]@\#~?:$=!<>\-&|+*/^%])""",
    re.X | re.S,
)


class LexError(ValueError):
    def __init__(self, kind: str, start: int, end: int, literal: str | None = None):
        super().__init__(f"{kind} at byte range {start}..{end}")
        self.kind, self.start, self.end, self.literal = kind, start, end, literal


def _closed(source: str, at: int, quote: str) -> int:
    """Place after the closing quote; -1 without one."""
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == quote:
            return at + 1
        else:
            at += 1
    return -1


def lex(source: str, profile: str = "T2") -> list[tuple[str, str, int, int]]:
    """(tag, label, start byte, end byte); raises LexError. T1 keeps texts, T2 numbers names and classes literals."""
    at = 0
    if source.startswith("#!") and not re.match(r"#!\s*\[", source):
        at = source.find("\n") if "\n" in source else len(source)
    size = lambda a, b: len(source[a:b].encode("utf-8", "surrogatepass"))
    offset, out = size(0, at), []
    names: dict[str, int] = {}
    lifetimes: dict[str, int] = {}
    while at < len(source):
        m = _PARTS.match(source, at)
        kind = m.lastgroup if m else None
        if m and m["rawstr"]:
            kind = "rawstr"
        end = m.end() if m else at + 1
        literal = None
        if kind is None:
            raise LexError("UnsupportedToken", offset, offset + size(at, end))
        if kind == "block":
            depth, i = 1, end
            while depth and i < len(source):
                two = source[i : i + 2]
                depth += (two == "/*") - (two == "*/")
                i += 2 if two in ("/*", "*/") else 1
            end = i
            if depth:
                raise LexError("UnterminatedBlockComment", offset, offset + size(at, end))
        elif kind in ("str", "bytes", "byte", "rawstr", "quote"):
            literal = {"str": ("<STR>", "string"), "bytes": ("<BYTE_STR>", "byte string"), "byte": ("<BYTE>", "byte"), "quote": ("<CHAR>", "character")}.get(kind)
            if kind == "rawstr":
                literal = ("<BYTE_STR>", "byte string") if source[at] == "b" else ("<STR>", "string")
                stop = source.find('"' + m["h"], end)
                stop = stop + 1 + len(m["h"]) if stop >= 0 else -1
            else:
                stop = _closed(source, end, "'" if kind in ("byte", "quote") else '"')
            end = stop if stop >= 0 else len(source)
            if stop < 0:
                raise LexError("UnterminatedLiteral", offset, offset + size(at, end), literal[1])
        elif kind in ("num", "char"):
            literal = ("<NUM>", "number") if kind == "num" else ("<CHAR>", "character")
        text, stop = source[at:end], offset + size(at, end)
        if literal:
            out.append(("v", text if profile == "T1" else literal[0], offset, stop))
        elif kind in ("id", "rawid"):
            name = text[2:] if kind == "rawid" else text
            if kind == "id" and name in KEYWORDS:
                out.append(("a", name, offset, stop))
            else:
                out.append(("i", name if profile == "T1" else f"<ID_{names.setdefault(name, len(names))}>", offset, stop))
        elif kind == "life":
            out.append(("l", text if profile == "T1" else f"<ID_{lifetimes.setdefault(text, len(lifetimes))}>", offset, stop))
        elif kind == "sign":
            out.append(("a", text, offset, stop))
        at, offset = end, stop
    return out


def code(tag: str, label: str) -> int:
    return fnv_bytes((tag + label).encode("utf-8", "surrogatepass"))


def lexed(fragments: DataFrame, mode: str = "permissive") -> DataFrame:
    """``fragments`` (fragment_id, profile, source_text) with ``tokens`` and ``error``; ``strict`` raises at the first error."""
    schema = T.StructType([T.StructField("fragment_id", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN_TYPE)), T.StructField("error", T.StringType())])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, profile, source in zip(pdf.fragment_id, pdf.profile, pdf.source_text):
                try:
                    rows.append((i, [dict(zip(("tag", "label", "start", "end"), t)) for t in lex(source or "", profile or "T2")], None))
                except LexError as e:
                    if mode == "strict":
                        raise
                    rows.append((i, None, str(e)))
            yield pd.DataFrame(rows, columns=["fragment_id", "tokens", "error"])

    return fragments.select("fragment_id", "profile", "source_text").mapInPandas(run, schema)
