"""The symbol graph: one-hop queries, edge resolution by name, and updates.  Two tables, no graph library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import RELATIONS

# Query words -> relation and direction.
QUERIES = {
    "callers": ("calls", True), "callees": ("calls", False), "imports": ("imports", False),
    "defines": ("defines", False), "inheritors": ("inherits_from", True), "inherits": ("inherits_from", False),
}


def related(symbols: DataFrame, edges: DataFrame, name: str, query: str) -> DataFrame:
    """Symbols one edge away from those of a name, by path, line and id.  The name filter reaches the scan."""
    if query not in QUERIES:
        raise ValueError(f"unknown relation: {query}")
    relation, incoming = QUERIES[query]
    here, there = ("dst", "src") if incoming else ("src", "dst")
    start = symbols.where(F.col("name") == name).select(F.col("chunk_id").alias("start"))
    hop = edges.where(F.col("relation") == relation).select(F.col(here).alias("start"), F.col(there).alias("chunk_id"))
    ids = hop.join(start, "start", "left_semi").select("chunk_id").distinct()
    return symbols.join(ids, "chunk_id", "left_semi").orderBy("file_path", "start_line", "chunk_id")


#: Candidates of one name that a task joins with its definitions; a name with more is dealt to several.
HOT_NAME = 100_000


def resolved(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst, relation, to_name, file_path of candidates (src, file_path, to_name, relation).

    A name resolves to all symbols of that name in the caller's own file, or, if it has none, to all there are.  Names
    are looked for in the own file first, by name and file; only what is left meets all definitions of its name.
    """
    targets = symbols.select(F.col("name").alias("to_name"), F.col("chunk_id").alias("dst"), F.col("file_path").alias("there"))
    own = candidates.select("src", "file_path", "to_name", "relation").distinct()
    local = own.join(targets.withColumnRenamed("there", "file_path"), ["to_name", "file_path"])
    named = targets.select("to_name", F.col("there").alias("file_path")).distinct()
    rest = own.join(named, ["to_name", "file_path"], "left_anti")
    # Names that much calls are dealt to several tasks, and their definitions to each of them; there are few such names.
    hot = F.broadcast(rest.groupBy("to_name").agg(F.count("*").alias("n")).where(F.col("n") > HOT_NAME).select("to_name", F.ceil(F.col("n") / HOT_NAME).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rest.join(hot, "to_name", "left").withColumn("part", F.pmod(F.xxhash64("src", "relation"), parts).cast("int")).drop("parts")
    spread = targets.join(hot, "to_name", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts", "there")
    columns = ["src", "dst", "relation", "to_name", "file_path"]
    return local.select(*columns).unionByName(dealt.join(spread, ["to_name", "part"]).select(*columns)).where(F.col("relation").isin(*RELATIONS)).distinct()


def resolve(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst, relation of candidates, by name: see resolved."""
    return distinct_edges(resolved(candidates, symbols))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "relation").where(F.col("relation").isin(*RELATIONS)).distinct()


def first_symbols(symbols: DataFrame) -> DataFrame:
    """The first symbol (by ord) of each file and start line."""
    w = Window.partitionBy("file_path", "start_line").orderBy("ord")
    return symbols.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def link_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Graph nodes: each chunk that starts on a symbol's line is a node of the first symbol there."""
    s = first_symbols(symbols).select("file_path", "start_line", "name", "kind", F.col("end_line").alias("symbol_end"))
    return chunks.select(F.col("id").alias("chunk_id"), "file_path", "start_line").join(s, ["file_path", "start_line"]).select("chunk_id", "name", "kind", "file_path", "start_line", F.col("symbol_end").alias("end_line"))


def containment(symbols: DataFrame) -> DataFrame:
    """outer, inner (ord) pairs per file: a class or module and each other symbol within its lines, ends included."""
    outer = symbols.where(F.col("kind").isin("class", "module")).select("file_path", F.col("ord").alias("outer"), F.col("start_line").alias("s0"), F.col("end_line").alias("e0"))
    inner = symbols.select("file_path", F.col("ord").alias("inner"), "start_line", "end_line")
    return outer.join(inner, "file_path").where("s0 <= start_line AND end_line <= e0 AND outer <> inner").select("file_path", "outer", "inner")


def delete_files(symbols: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of the files (column file_path) and the edges at them."""
    gone = symbols.join(paths.select("file_path"), "file_path", "left_semi").select("chunk_id")
    kept = symbols.join(paths.select("file_path"), "file_path", "left_anti")
    left = edges.join(gone.withColumnRenamed("chunk_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("chunk_id", "dst"), "dst", "left_anti")
    return kept, left.select("src", "dst", "relation")


def upsert_nodes(symbols: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes replace those of the same chunk."""
    return symbols.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def upsert_edges(edges: DataFrame, new: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with new ones added whose two ends are nodes."""
    ids = symbols.select("chunk_id")
    fits = new.join(ids.withColumnRenamed("chunk_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("chunk_id", "dst"), "dst", "left_semi")
    return distinct_edges(edges.select("src", "dst", "relation").unionByName(fits.select("src", "dst", "relation")))


def name_map(symbols: DataFrame, per_file: bool = False) -> DataFrame:
    """name (and file) -> the smallest chunk id of it."""
    return symbols.groupBy(*(["file_path"] if per_file else []), "name").agg(F.min("chunk_id").alias("chunk_id"))


def patched(edges: DataFrame, candidates: DataFrame, symbols: DataFrame, changed_files: DataFrame, affected_names: DataFrame) -> DataFrame:
    """Edges (as of resolved) after a change, recomputed only for candidates of changed files or with affected names.

    Equals a full resolve.
    """
    files, names = changed_files.select("file_path"), affected_names.select(F.col("name").alias("to_name"))
    again = candidates.join(files, "file_path", "left_semi").unionByName(candidates.join(files, "file_path", "left_anti").join(names, "to_name", "left_semi").select(*candidates.columns))
    kept = edges.join(files, "file_path", "left_anti").join(names, "to_name", "left_anti")
    return kept.select("src", "dst", "relation", "to_name", "file_path").unionByName(resolved(again, symbols)).distinct()


def patch(edges: DataFrame, candidates: DataFrame, symbols: DataFrame, changed_files: DataFrame, affected_names: DataFrame) -> DataFrame:
    """src, dst, relation of patched."""
    return distinct_edges(patched(edges, candidates, symbols, changed_files, affected_names))
