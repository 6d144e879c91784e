"""A small scanner for languages with braces: tokens with lines, comments and strings set apart."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, comment, sign
    text: str
    start: int  # place in the source
    line: int


def scanner(*, strings: str, line_comments: str, variables: bool = False, between: str = r"(?!)") -> re.Pattern[str]:
    """between: what stands between pieces of code; it counts as a comment."""
    word = r"\$?[^\W\d]\w*" if variables else r"[^\W\d]\w*"
    return re.compile(rf"(?P<comment>/\*.*?\*/|(?:{line_comments})[^\n]*|{between})|(?P<string>{strings})|(?P<word>{word})|(?P<number>\d[\w.]*)|(?P<sign>::|->|=>|\?->|\.\.\.|<-|:=|[^\s\w])", re.S)


def tokens(pattern: re.Pattern[str], source: str, at: int = 0) -> list[Token]:
    out, line, last = [], source.count("\n", 0, at) + 1, at
    for m in pattern.finditer(source, at):
        line += source.count("\n", last, m.start())
        last = m.start()
        out.append(Token(m.lastgroup or "sign", m[0], m.start(), line))
    return out


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def matching(toks: list[Token], i: int) -> int:
    """Place of the bracket that closes the one at i; the last token if there is none."""
    depth = 0
    for j in range(i, len(toks)):
        if toks[j].kind == "sign":
            depth += toks[j].text in OPEN
            depth -= toks[j].text in CLOSE
            if depth == 0:
                return j
    return len(toks) - 1


def split_top(toks: list[Token], sep: str = ",") -> list[list[Token]]:
    """Runs of tokens between separators outside brackets; empty runs are left out."""
    out, run, depth = [], [], 0
    for t in toks:
        if t.kind == "sign":
            depth += t.text in OPEN
            depth -= t.text in CLOSE
        if t.text == sep and t.kind == "sign" and depth == 0:
            out.append(run)
            run = []
        else:
            run.append(t)
    return [r for r in [*out, run] if r]


def text_of(toks: list[Token], source: str) -> str:
    """The source from the first to the last token, blanks squeezed."""
    return " ".join(source[toks[0].start : toks[-1].start + len(toks[-1].text)].split()) if toks else ""


def end_line(t: Token) -> int:
    return t.line + t.text.count("\n")
