"""Path expressions: ancestors, languages, joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of the languages that are parsed.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def ancestors(path: Column) -> Column:
    """Directories above a relative path, the nearest last: a/b/c.rs -> [a, a/b]."""
    p = parts(path)
    return F.when(F.size(p) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda n: F.array_join(F.slice(p, 1, n), "/")))


def language(path: Column) -> Column:
    """Language by extension, null for others.  Case counts, and a name that is nothing but a dot and letters has none."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for e, name in LANGUAGES.items():
        out = out.when(ext == e, F.lit(name))
    return out


def under_root(root: Column | str, path: Column) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return F.concat_ws("/", F.rtrim(root, F.lit("/")), path)
