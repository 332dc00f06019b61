"""Tokens of Go source text, with the semicolons that line ends stand for.

Source bytes are read as Latin-1, so offsets count bytes; names are decoded as UTF-8 when they are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
TOKEN = re.compile(
    r"""
    (?P<space>[ \t\r]+) | (?P<line>\n) | (?P<comment>//[^\n]*) | (?P<block>/\*.*?\*/)
    | (?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)
    | (?P<number>0[xX](?:[0-9a-fA-F_]|\.|[pP][+-]?)+i? | (?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?(?:[bBoO][0-9_]+)?i?)
    | (?P<raw>`[^`]*`) | (?P<string>"(?:[^"\\\n]|\\.)*") | (?P<rune>'(?:[^'\\\n]|\\.)[^'\n]*')
    | (?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^~<>=!()\[\]{},;.:])
    """,
    re.S | re.X,
)
ENDING_WORDS = frozenset("break continue fallthrough return".split())
ENDING_OPS = frozenset(("++", "--", ")", "]", "}"))


class GoSyntaxError(ValueError):
    """What a source text can't be read on from, and where."""

    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


@dataclass(slots=True)
class Token:
    kind: str  # name, keyword, number, string, rune, op, bad, end
    text: str
    at: int
    end: int


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at = 0

    def line_end(where: int) -> None:
        if out:
            last = out[-1]
            if last.kind in ("name", "number", "string", "rune") or last.kind == "keyword" and last.text in ENDING_WORDS or last.kind == "op" and last.text in ENDING_OPS:
                out.append(Token("op", ";", where, where))

    n = len(source)
    while at < n:
        found = TOKEN.match(source, at)
        if not found:  # no token of the language: whoever meets it stops there
            out.append(Token("bad", source[at], at, at + 1))
            at += 1
            continue
        kind, text, at = found.lastgroup, found[0], found.end()
        if kind in ("space", "comment"):
            continue
        if kind == "line" or kind == "block":
            if "\n" in text:
                line_end(found.start())
            continue
        if kind == "name" and text in KEYWORDS:
            kind = "keyword"
        out.append(Token("string" if kind == "raw" else kind, text, found.start(), at))
    line_end(n)
    out.append(Token("end", "", n, n))
    return out


class Lines:
    """Line and column, from 1 and in bytes, of an offset."""

    def __init__(self, source: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1
