"""Symbols and call candidates of source files.

Python goes through the standard library's parser; Rust, JavaScript and TypeScript are scanned token by token with
their brackets matched.  Of a Python source that doesn't parse, declarations are found by indentation: those that parse
and classes around them are kept.  A symbol's range starts at the doc and attribute lines right above
it.  The calls of a function are those in its lines, so a function within it shares its own with it.  parse(source,
language) can be swapped for a full parser with the same result type.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from .chunk import lines_of
from .tokens import matched, tokens


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    start: int
    end: int


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    calls: list[tuple[int, str]] = field(default_factory=list)  # (place of the caller in symbols, callee)


# What doc and attribute lines start with.
_DOC = {
    "rust": ("//", "#[", "#![", "/*", "*"),
    "python": ("#", "@"),
    "javascript": ("//", "/*", "*", "@"),
    "typescript": ("//", "/*", "*", "@"),
}


def widened(lines: list[str], row: int, language: str) -> int:
    """The first of the doc and attribute lines right above row (from 0), or row."""
    while row > 0 and (above := lines[row - 1].lstrip()) and above.startswith(_DOC[language]):
        row -= 1
    return row


def defines(symbols: list[Symbol]) -> list[tuple[int, int]]:
    """(outer, inner) places: a class or module and each other symbol whose range lies within its own."""
    return [(i, j) for i, o in enumerate(symbols) if o.kind in ("class", "module") for j, s in enumerate(symbols) if i != j and o.start <= s.start and s.end <= o.end]


_HEADER = re.compile(r"\s*(?:async\s+)?(def|class)\s+(\w+)")
_STATEMENT = re.compile(r"(?:@|(?:async\s+)?def\s|class\s|import\s|from\s)")


def _tree(source: str) -> ast.AST | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _python(source: str, lines: list[str]) -> Parsed:
    out = Parsed()

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            kind = "function" if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) else "class" if isinstance(child, ast.ClassDef) else "import" if isinstance(child, ast.Import | ast.ImportFrom) else None
            if kind:
                name = child.name if kind != "import" else ((child.module or ".") if isinstance(child, ast.ImportFrom) else child.names[0].name)
                out.symbols.append(Symbol(name, kind, widened(lines, child.lineno - 1, "python") + 1, child.end_lineno or child.lineno))
                if kind == "function":
                    place, seen = len(out.symbols) - 1, dict.fromkeys(_called(child))
                    out.calls += [(place, x) for x in seen if x != name]
            visit(child)

    def recover(first: int, end: int) -> None:
        """Declarations of the lines from first to end, none of which may parse as a whole, by indentation."""
        full = [k for k in range(first, end) if lines[k].strip()]
        if not full:
            return
        depth = min(len(lines[k]) - len(lines[k].lstrip()) for k in full)
        starts = [k for k in full if len(lines[k]) - len(lines[k].lstrip()) == depth and _STATEMENT.match(lines[k].lstrip())]
        starts = [k for k in starts if not (k and k - 1 in starts and lines[k - 1].lstrip().startswith("@"))]
        for a, b in zip(starts, [*starts, end][1:], strict=False):
            if (tree := _tree("\n".join(x[depth:] if not x[:depth].strip() else x for x in lines[a:b]))) is not None:
                visit(ast.increment_lineno(tree, a))
                continue
            head = next((k for k in range(a, b) if _HEADER.match(lines[k])), None)
            if head is None:
                continue
            # What doesn't parse reaches as far as what is indented below it; of a class, its first line is enough.
            last = head
            for k in range(head + 1, b):
                if lines[k].strip():
                    if len(lines[k]) - len(lines[k].lstrip()) <= depth:
                        break
                    last = k
            kind, name = _HEADER.match(lines[head]).groups()
            if kind == "class":
                out.symbols.append(Symbol(name, kind, widened(lines, head, "python") + 1, last + 1))
            recover(head + 1, last + 1)

    if (whole := _tree(source)) is not None:
        visit(whole)
    else:
        recover(0, len(lines))
    return out


def _called(function: ast.AST):
    for node in ast.walk(function):
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Attribute):
                yield f.attr
            elif isinstance(f, ast.Name):
                yield f.id


_RUST_MODIFIERS = {"pub", "async", "unsafe", "const", "extern", "default"}
#: Before an item of Rust, or a statement of the others.
_ITEM_BEFORE = {"{", "}", ";", "]"}
#: What makes a function or class that follows a part of an expression.
_EXPRESSION_BEFORE = set("= ( , : ? => return new typeof void await yield ! & | + - * / % < > [ in of case throw delete ... extends".split())
_TYPE_BEFORE = {":", "|", "&", "=>", "<", ",", "is", "extends", "keyof", "typeof", "infer", "readonly"}
_NOT_CALLED = set("pub if for while match switch return fn function catch loop in await typeof super let const else move async self Self crate where as use impl dyn ref mut yield void delete case do with constructor".split())


class _Scan:
    """Declarations and calls in the tokens of a source."""

    def __init__(self, source: str, lines: list[str], language: str):
        self.lines, self.language, self.rust = lines, language, language == "rust"
        self.found = tokens(source, self.rust)
        self.close, self.around = matched(self.found)
        self.out = Parsed()
        self.text = [t.text if t.kind != "string" else "" for t in self.found]
        self.classes: set[int] = set()  # braces of class bodies
        self.skipped = self._unparsed() if self.rust else set()

    def _at(self, k: int) -> str:
        return self.text[k] if 0 <= k < len(self.text) else ""

    def _name(self, k: int) -> bool:
        return k < len(self.found) and self.found[k].kind == "name"

    def _unparsed(self) -> set[int]:
        """Tokens of macros' arguments and of attributes, which nothing is declared or called in."""
        out: set[int] = set()
        k = 0
        while k < len(self.found):
            at = None
            if self.text[k] == "#" and self._at(k + 1 + (self._at(k + 1) == "!")) == "[":
                at = k + 1 + (self._at(k + 1) == "!")
            elif self.text[k] == "!" and k and self.found[k - 1].kind == "name":
                at = k + 1 + self._name(k + 1)
                at = at if self._at(at) in ("(", "[", "{") and self._at(at) else None
            if at is not None:
                out.update(range(at, self.close[at] + 1))
                k = self.close[at]
            k += 1
        return out

    def _to(self, k: int, stops: set[str], types: bool = False) -> int:
        """The first of `stops` from k on outside of other brackets, or where the brackets around end; types: braces of a
        type aren't the body's."""
        while k < len(self.found):
            t = self.text[k]
            if t in stops and not (types and t == "{" and self._at(k - 1) in _TYPE_BEFORE):
                return k
            if t and t in ")]}":
                return k
            k = self.close[k] + 1 if t and t in "([{" else k + 1
        return len(self.found)

    def _add(self, name: str, kind: str, first: int, last: int, body: int | None = None) -> None:
        """A declaration of the tokens from first to last; body: where calls start, of a function."""
        last = min(last, len(self.found) - 1)
        self.out.symbols.append(Symbol(name, kind, widened(self.lines, self.found[first].row, self.language) + 1, self.found[last].end_row + 1))
        if kind == "function":
            seen = dict.fromkeys(self._called(first if body is None else body, last))
            self.out.calls += [(len(self.out.symbols) - 1, x) for x in seen if x != name]

    def _called(self, first: int, last: int):
        for k in range(first, last):
            if self.found[k].kind != "name" or k in self.skipped or self.text[k] in _NOT_CALLED:
                continue
            after = k + 1
            if self.rust and self._at(after) == "::" and self._at(after + 1) == "<":
                after = self._generic_end(after + 1)
            elif self.language == "typescript" and self._at(after) == "<":
                end = self._generic_end(after)
                after = end if all(self.found[i].kind in ("name", "string") or self.text[i] in "<>,.[]|&" for i in range(after, end)) else after
            if self._at(after) != "(":
                continue
            before = k - 1
            while self._at(before) in (".", "::", "?.") and self._name(before - 1):
                before -= 2
            if self._at(k - 1) in ("fn", "function") or self._at(before) == "new" or (self._at(k - 1) == "*" and self._at(k - 2) == "function"):
                continue
            if not self.rust and self._method(k, self.close[after]):
                continue
            yield self.text[k]

    def _method(self, k: int, end: int) -> bool:
        """Whether name( ) is a method that is being declared."""
        if self._at(end + 1) == "{":
            return True
        marked = self._at(k - 1) in ("{", "}", ";", "*", "#") or self._at(k - 1) in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract")
        return self.around[k] in self.classes and (marked or self.found[k - 1].end_row < self.found[k].row and self._at(k - 1) not in _EXPRESSION_BEFORE)

    def _generic_end(self, k: int) -> int:
        """Behind the type arguments that open at k."""
        depth = 0
        while k < len(self.found):
            depth += (self.text[k] == "<") - (self.text[k] == ">")
            k += 1
            if not depth:
                return k
        return k

    def _starts_statement(self, k: int) -> bool:
        before = self._at(k - 1)
        if k == 0 or before in ("{", "}", ";", ")", "else", "do"):
            return self.around[k] < 0 or self.text[self.around[k]] == "{"
        return before not in _EXPRESSION_BEFORE and before not in (".", "?.", "import") and self.found[k - 1].end_row < self.found[k].row

    def rust_items(self) -> None:
        for k in range(len(self.found)):
            if k in self.skipped or self.found[k].kind != "name":
                continue
            word, first = self.text[k], k
            while first and (self._at(first - 1) in _RUST_MODIFIERS or self.found[first - 1].kind == "string" and self._at(first - 2) == "extern" or self._at(first - 1) == ")" and self._visibility(first - 1) is not None):
                first = self._visibility(first - 1) if self._at(first - 1) == ")" else first - 1
            item = first == 0 or self._at(first - 1) in _ITEM_BEFORE or self._at(first - 1) == "}"
            if word == "fn" and self._name(k + 1):
                body = self._to(k + 2, {"{", ";"})
                if self._at(body) == "{":
                    self._add(self.text[k + 1], "function", first, self.close[body], body)
            elif word == "struct" and self._name(k + 1) and item:
                body = self._to(k + 2, {"{", ";"})
                self._add(self.text[k + 1], "class", first, self.close[body] if self._at(body) == "{" else body)
            elif word == "impl" and item:
                body = self._to(k + 1, {"{", ";"})
                if self._at(body) == "{":
                    self._add("<anonymous>", "class", first, self.close[body])
            elif word == "mod" and self._name(k + 1) and item:
                body = k + 2
                self._add(self.text[k + 1], "module", first, self.close[body] if self._at(body) == "{" else body)
            elif word == "use" and item:
                end = k + 1
                while end < len(self.found) and self.text[end] != ";":
                    end += 1
                self._add(_joined(self.text[k + 1 : end]), "import", first, end)

    def _visibility(self, k: int) -> int | None:
        """Where pub( ) that closes at k starts."""
        for opens in range(k - 1, max(-1, k - 12), -1):
            if self._at(opens) == "(" and self.close[opens] == k:
                return opens - 1 if self._at(opens - 1) == "pub" else None
        return None

    def script_items(self) -> None:
        todo = [k for k in range(len(self.found)) if self.found[k].kind == "name" and self.text[k] in ("function", "class", "import")]
        for k in todo:  # class bodies first: they tell methods from calls
            if self.text[k] == "class" and self._at(k - 1) not in (".", "?."):
                self.classes.add(self._to(k + 1, {"{"}))
        for k in todo:
            first = k
            while first and self._at(first - 1) in ("export", "default", "async", "abstract", "declare"):
                first -= 1
            if not self._starts_statement(first) and first == k:
                continue
            own = k - 1 if self._at(k - 1) in ("async", "abstract") else k
            if self.text[k] == "function":
                name = k + 1 + (self._at(k + 1) == "*")
                params = self._to(name + 1, {"("})
                if not self._name(name) or self._at(params) != "(":
                    continue
                body = self.close[params] + 1
                while body < len(self.found) and self._at(body) not in ("{", ";") or self._at(body) == "{" and self._at(body - 1) in _TYPE_BEFORE:
                    if self._at(body) in ("function", "class", "export", "import", "}", ")"):
                        break
                    body = self.close[body] + 1
                if self._at(body) == "{":
                    self._add(self.text[name], "function", own, self.close[body])
            elif self.text[k] == "class" and self._name(k + 1) and self._at(k + 1) != "extends":
                body = self._to(k + 2, {"{"})
                if self._at(body) == "{":
                    self._add(self.text[k + 1], "class", own, self.close[body])
            elif self.text[k] == "import" and self._at(k + 1) not in ("(", "."):
                end = k + 1
                while end < len(self.found) and self.found[end].kind != "string" and self._at(end) != ";":
                    end = self.close[end] + 1
                if end < len(self.found) and self.found[end].kind == "string":
                    last = end + 1 if self._at(end + 1) == ";" else end
                    self._add(self.found[end].text.strip("'\""), "import", k, last)


def _joined(words: list[str]) -> str:
    """A path as it is written: spaces stand only where two names meet, behind commas and around braces' insides no."""
    out = ""
    for w in words:
        out += (" " if out and (out[-1].isalnum() or out[-1] in "_*}") and (w[:1].isalnum() or w[:1] in "_*{") else " " if out.endswith(",") else "") + w
    return out


def _scanned(source: str, lines: list[str], language: str) -> Parsed:
    scan = _Scan(source, lines, language)
    scan.rust_items() if scan.rust else scan.script_items()
    return scan.out


def parse(source: str, language: str | None) -> Parsed:
    """Symbols and calls of a source, none for a language that isn't parsed or where nothing parses."""
    if language is None:
        return Parsed()
    lines = lines_of(source)
    return _python(source, lines) if language == "python" else _scanned(source, lines, language)
