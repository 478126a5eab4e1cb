"""Tokens of Rust, JavaScript and TypeScript sources, with their brackets matched, for what looks at declarations and calls.

Comments, and texts within strings, are no tokens.  A source with errors still has tokens: a bracket that is never
closed ends with the source, one that was never opened closes nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Token:
    """kind: name, string, number or mark (text is then one of "::", "->", "=>", "?.", "..." or a single character)."""

    kind: str
    text: str
    row: int
    end_row: int


_MARK = r"(?P<mark>::|->|=>|\?\.|\.\.\.|[^\s\w])"
_RUST = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hash>\#*)")|(?P<string>[bc]?"(?:[^"\\]|\\.)*(?:"|\Z))|(?P<char>b?'(?:\\(?:u\{[^}']*\}|x..|.)|[^'\\\n])')|(?P<life>'\w+)|(?P<number>\d[\w]*(?:\.\d[\w]*)?)|(?P<name>(?:r\#)?[^\W\d]\w*)|""" + _MARK, re.S)
_SCRIPT = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<template>`)|(?P<string>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))|(?P<number>\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|""" + _MARK, re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: After these a slash starts a regular expression, not a division.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => return typeof case in of delete void throw new else do".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _block_end(source: str, at: int, nested: bool) -> int:
    """Behind the block comment that starts at `at`."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m.group() == "/*" and (nested or not depth) else -1 if m.group() == "*/" else 0
        if not depth:
            return m.end()
    return len(source)


def tokens(source: str, rust: bool) -> list[Token]:
    out: list[Token] = []
    pattern, at, row = (_RUST if rust else _SCRIPT), 0, 0
    templates: list[int] = []  # open braces within each template's ${ }
    braces = 0
    while at < len(source):
        m = pattern.match(source, at)
        kind, text = (m.lastgroup, m.group()) if m else ("mark", source[at])
        end = m.end() if m else at + 1
        if kind == "hash":
            kind = "raw"
        if kind == "block":
            end = _block_end(source, at, rust)
        elif kind == "raw":
            close = source.find('"' + m.group("hash"), end)
            end = len(source) if close < 0 else close + 1 + len(m.group("hash"))
        elif kind == "mark" and text == "/" and not rust and (not out or out[-1].text in _BEFORE_REGEX and out[-1].kind != "string") and (r := _REGEX.match(source, at)):
            end, kind = r.end(), "string"
        elif kind == "template" or (kind == "mark" and text == "}" and templates and braces == templates[-1]):
            if kind == "mark":
                templates.pop()
                out.append(Token("mark", ")", row, row))
                kind = "template"
            end = _TEMPLATE.match(source, end).end()
            if source.startswith("${", end):
                end += 2
                templates.append(braces)
                out.append(Token("mark", "(", row, row))
            else:
                end += 1
        rows = source.count("\n", at, end)
        if kind in ("name", "number"):
            out.append(Token(kind, text.removeprefix("r#") if rust else text, row, row))
        elif kind in ("string", "raw", "char", "life"):
            out.append(Token("string", source[at:end], row, row + rows))
        elif kind == "mark":
            braces += (text == "{") - (text == "}")
            out.append(Token("mark", text, row, row))
        row += rows
        at = end
    return out


def matched(found: list[Token]) -> tuple[list[int], list[int]]:
    """For each token: where its bracket closes (itself if it opens none), and where the bracket around it opens (-1: none)."""
    close, around, open_ = list(range(len(found))), [-1] * len(found), []
    for k, t in enumerate(found):
        if t.kind == "mark" and t.text in ")]}":
            # A closing bracket closes the nearest open one of its kind, and those left open inside of it.
            for i in range(len(open_) - 1, -1, -1):
                if _PAIRS[found[open_[i]].text] == t.text:
                    for inner in open_[i:]:
                        close[inner] = k
                    del open_[i:]
                    break
        around[k] = open_[-1] if open_ else -1
        if t.kind == "mark" and t.text in "([{":
            open_.append(k)
    for k in open_:
        close[k] = len(found) - 1
    return close, around
