"""Rule lists in gitignore style, as regular expressions that the JVM and Python read alike.

A bare pattern puts a path into the set, one that starts with ! takes it out again, the last match wins.  A slash
inside or in front anchors a pattern at the root, a slash at the end means directories only, ** crosses
directories.  A path belongs to the set if it or any directory above it does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ancestors

# The shipped rule lists.
EXCLUDE_DEFAULTS = (
    ".git/", "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.snap", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml",
    "**/Cargo.lock", "**/poetry.lock", "**/Gemfile.lock", "**/composer.lock",
)
VENDOR_DEFAULTS = (
    "**/node_modules/**", "**/vendor/**", "vendor/", "**/.venv/**", "**/venv/**", "**/site-packages/**", "**/target/**", "**/dist/**",
    "**/build/**", "**/.tox/**", "**/__pycache__/**",
)


@dataclass(frozen=True)
class Rule:
    regex: str
    takes_out: bool
    directories_only: bool


def _translate(glob: str) -> str:
    """The regular expression of a glob without its anchor and end."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.+")
            i += 3
        elif c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] not in ("!", "^") else i + 3)
            if end < 0:
                raise ValueError(f"unclosed class in {glob!r}")
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^/" + body[1:] if body[:1] in "!^" else body) + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c) if c != "/" else "/")
            i += 1
    return "".join(out)


def compile_rule(pattern: str) -> Rule:
    """Compiles one rule; ValueError if it is empty, a bare !, holds NUL or an unclosed class."""
    p = pattern.strip()
    takes_out = p.startswith("!")
    p = p[1:] if takes_out else p
    if not p or "\0" in p:
        raise ValueError("empty or invalid glob")
    directories_only = p.endswith("/")
    p = p[:-1] if directories_only else p
    anchored = "/" in p
    p = p.removeprefix("/")
    if not p:
        raise ValueError("empty or invalid glob")
    return Rule("^" + ("" if anchored else "(?:.*/)?") + _translate(p) + "$", takes_out, directories_only)


def compile_rules(patterns: list[str] | tuple[str, ...], strict: bool = True) -> list[Rule]:
    """Compiles a list.  Lenient lists skip blank and invalid entries, strict ones raise and name the place."""
    out = []
    for k, p in enumerate(patterns):
        try:
            out.append(compile_rule(p))
        except ValueError as e:
            if strict:
                raise ValueError(f"rule {k}: {e}") from None
    return out


def member(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """Verdict on one path alone."""
    verdict = False
    for r in rules:
        if (is_dir or not r.directories_only) and re.match(r.regex, path):
            verdict = not r.takes_out
    return verdict


def verdict(path: Column, is_dir: bool, rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        if is_dir or not r.directories_only:
            out = F.when(path.rlike(r.regex), F.lit(not r.takes_out)).otherwise(out)
    return out


def contains(path: Column, rules: list[Rule], is_dir: bool = False) -> Column:
    """Whether a relative path or a directory above it is in the set."""
    if not rules:
        return F.lit(False)
    return verdict(path, is_dir, rules) | F.exists(ancestors(path), lambda a: verdict(a, True, rules))


def classify(path: Column, exclude: list[Rule], vendor: list[Rule]) -> Column:
    """drop, tier2 or tier1: exclusion wins, Git's own directory is always dropped."""
    git = F.array_contains(F.split(path, "/"), ".git")
    return F.when(git | contains(path, exclude), "drop").when(contains(path, vendor), "tier2").otherwise("tier1")
