"""Queries over the driver's tables, at least one per operator of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import ConstantBackend
from ..functions.paths import language, under_root
from ..functions.stem import stem
from ..functions.text import STEMMED, lines_of
from ..operators import graph, indexing, inventory, knowledge, policy, registry, search, text_index, vector_index, versions
from ..operators import usage as usage_log
from ..schema import violations
from ..sources.shared import shared_folder
from ..streaming import changes as streams
from . import adapters as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORDS = "the and"
ANCHOR, DAYS = "2024-01-30 00:00:00", 7


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def anchor():
    return F.lit(ANCHOR).cast("timestamp_ntz")


@query
def fulltext_search(s, d):
    return search.fulltext(t.searchable(s, d), WORDS, 20)


@query
def fulltext_indexed(s, d):
    """Over an index written once; half of the texts come in as a later change of it, in place of others."""
    chunks = t.searchable(s, d).where("content IS NOT NULL").select("id", "content")
    later = F.col("id") % 2 == 0
    index = text_index.build(chunks.withColumn("content", F.when(later, "to be replaced, the and").otherwise(F.col("content"))), shared_folder(s, "text-index"))
    return text_index.add(index, chunks.where(later)).search(WORDS, 20)


@query
def fulltext_stemmed(s, d):
    """By stems: "ending" also finds "ended" and "ends"."""
    return search.fulltext(t.searchable(s, d).where("content IS NOT NULL"), "endings of onlookers", 20, STEMMED)


@query
def stems(s, d):
    """How many distinct words of all texts meet at each stem."""
    words = t.read(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))).alias("word")).distinct()
    return words.select(stem(F.col("word")).alias("stem"), "word").groupBy("stem").agg(F.count("*").alias("words"), F.min("word").alias("first"))


@query
def fulltext_no_terms(s, d):
    return search.fulltext(t.searchable(s, d), " .,! ", 20)


@query
def semantic_search(s, d):
    return search.semantic(t.vectors(s, d), t.query_vector(s, d), 20)


def _asked(s, d):
    """The queries of the index: every vector whose id is divisible by 100."""
    return t.vectors(s, d).where(F.col("id") % 100 == 0).select(F.col("id").alias("query"), "embedding")


@query
def semantic_indexed(s, d):
    """The nearest ten to each query, by a written index that goes on to every cell that may hold a better one."""
    index = vector_index.build(t.vectors(s, d), shared_folder(s, "vector-index"), tune=False)
    return vector_index.search(index, _asked(s, d), 10, exact=True)


@query
def semantic_recall(s, d):
    """How many of the nearest ten the nearest cells alone give."""
    index = vector_index.build(t.vectors(s, d), shared_folder(s, "vector-index"))
    near = vector_index.stored(vector_index.search(index, _asked(s, d), 10))
    return vector_index.recall(near, vector_index.search(index, _asked(s, d), 10, exact=True, near=near))


@query
def hybrid_rrf(s, d):
    return search.hybrid(t.searchable(s, d), WORDS, t.query_vector(s, d), 20)


@query
def hybrid_candidates_cap(s, d):
    return search.hybrid(t.searchable(s, d), WORDS, t.query_vector(s, d), 200)


@query
def rrf_single_list(s, d):
    return search.fuse([search.semantic(t.vectors(s, d), t.query_vector(s, d), 30)], 20)


@query
def search_results(s, d):
    c = t.chunks(s, d)
    return search.with_content(search.fulltext(c, WORDS, 20), c, "/work/repo/")


@query
def knowledge_list(s, d):
    return knowledge.listed(t.notes(s, d), "user", 50).select("id", "repo_path", "title", "updated_at")


@query
def knowledge_fulltext(s, d):
    return knowledge.fulltext(t.notes(s, d), WORDS, None, 20)


@query
def knowledge_semantic(s, d):
    return knowledge.semantic(t.notes(s, d), t.query_vector(s, d), None, 20)


@query
def knowledge_hybrid(s, d):
    return knowledge.hybrid(t.notes(s, d), WORDS, t.query_vector(s, d), None, 20)


@query
def usage_total(s, d):
    return usage_log.total(t.usage(s, d), DAYS, anchor())


@query
def usage_by_tool(s, d):
    return usage_log.by_tool(t.usage(s, d), DAYS, anchor())


@query
def usage_checked(s, d):
    return usage_log.checked(t.usage(s, d).withColumn("result_count", F.when(F.col("id") % 3 == 0, F.col("id") % 100))).select("id", "duration_ms", "result_count")


@query
def visible_manifest(s, d):
    return versions.visible(t.base(s, d), t.deltas(s, d).where("checkout_id = 'k1'"))


@query
def visible_all(s, d):
    seen = versions.visible_all(t.base(s, d), t.deltas(s, d), t.checkouts(s))
    return seen.groupBy("checkout_id").agg(F.count("*").alias("files"), F.min("version").alias("least"), F.max("version").alias("most"))


def _k1(s, d):
    return versions.masked_chunks(t.versioned_chunks(s, d), versions.visible(t.base(s, d), t.deltas(s, d).where("checkout_id = 'k1'")))


@query
def masked_fulltext(s, d):
    return search.fulltext(_k1(s, d), WORDS, 20)


@query
def masked_semantic(s, d):
    return search.semantic(_k1(s, d), t.query_vector(s, d), 20)


@query
def masked_hybrid(s, d):
    return search.hybrid(_k1(s, d), WORDS, t.query_vector(s, d), 20)


@query
def checkout_gate(s, d):
    gate = t.checkouts(s).select("checkout_id", F.when(F.col("checkout_id") == "k2", "retired").otherwise("active").alias("state"), F.when(F.col("checkout_id") != "k3", F.lit(ANCHOR)).alias("indexed_at"))
    rows = t.base(s, d)
    return versions.gated(rows, gate, "k1").unionByName(versions.gated(rows, gate, "k2")).unionByName(versions.gated(rows, gate, "k3"))


@query
def minimal_deltas(s, d):
    return versions.minimal_deltas(t.base(s, d), versions.visible(t.base(s, d), t.deltas(s, d).where("checkout_id = 'k1'")))


@query
def base_move_preserve(s, d):
    return versions.move_base(t.base(s, d), t.new_base(s, d), t.deltas(s, d), t.checkouts(s))


def _all_versions(s, d):
    n = F.col("doc_id").cast("string")
    prefixes = F.explode(F.array(*[F.lit(x) for x in ("b", "m", "c1_", "n4_", "old")])).alias("p")
    return t.read(s, d, "documents").select(n.alias("n"), prefixes).select(F.concat("p", "n").alias("id"))


@query
def gc_versions(s, d):
    return versions.unreferenced(_all_versions(s, d), t.base(s, d), t.deltas(s, d))


@query
def protected_cleanup(s, d):
    docs = t.read(s, d, "documents")
    captured = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    in_base = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"))
    readers = docs.where("doc_id % 100 = 1").select(F.array(F.col("doc_id") + 2, F.col("doc_id") + 5).alias("references"))
    work = docs.where("doc_id % 50 = 3").select(F.when(F.col("doc_id") % 100 == 3, "accepted").otherwise("done").alias("state"), F.array(F.col("doc_id") + 6).alias("captured_ids"))
    return versions.deletable(captured, in_base, readers, work)


@query
def content_hash_versions(s, d):
    docs = t.chunks(s, d).select(F.col("file_path").alias("path"), "content_hash", "tier", F.col("content").alias("source"), F.col("id").alias("n"))
    known = docs.where("n % 2 = 0").select("path", "content_hash", "tier", F.when(F.col("n") % 6 == 0, "other").when(F.col("n") % 10 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"), F.concat(F.lit("v"), F.col("n").cast("string")).alias("id"))
    out = versions.assign_versions(docs, known)
    return out.select("path", "content_hash", "is_new", F.when(~F.col("is_new"), F.col("version")).alias("known"))


@query
def embedding_reuse(s, d):
    c = t.chunks(s, d)
    old = c.where("id % 3 = 0").join(t.vectors(s, d), "id").select("id", "file_path", "content_hash", "content", "embedding")
    return versions.reusable_embeddings(c.select("id", "file_path", "content_hash", "content"), old).select("id", F.col("reused").isNotNull().alias("reused"))


@query
def orphan_paths(s, d):
    c = t.chunks(s, d)
    return versions.orphans(c, c.where("id % 4 <> 0").select(F.col("file_path").alias("path")))


@query
def pending_groups(s, d):
    return indexing.pending_groups(t.chunks(s, d)).select("content_hash", "rows")


@query
def backfill_fanout(s, d):
    c = t.chunks(s, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    return indexing.backfill(c, ConstantBackend(8)).groupBy("embedding_state").agg(F.count("*").alias("rows"), F.count("embedding").alias("vectors"))


@query
def coverage_summary(s, d):
    return search.coverage(t.chunks(s, d).join(t.vectors(s, d), "id", "left"))


def _related(query_name: str, table: str, column: str) -> Query:
    def run(s, d):
        return graph.related(t.symbols(s, d), t.edges(s, d), t.some_name(s, d, table, column), query_name).select("chunk_id", "name", "kind", "file_path", "start_line", "end_line")

    run.__name__ = query_name
    return query(run)


for _args in (("callers", "supplier", "s_name"), ("callees", "part", "p_name"), ("defines", "nation", "n_name"), ("inheritors", "region", "r_name"), ("inherits", "nation", "n_name"), ("imports", "supplier", "s_name")):
    _related(*_args)


@query
def edge_resolution_local_first(s, d):
    sym = t.spans(s, d).select(F.concat_ws("/", F.col("file_path").cast("string"), F.col("ord").cast("string")).alias("chunk_id"), "name", (F.col("file_path") % 500).cast("string").alias("file_path"), "ord")
    calls = sym.select(F.concat(F.col("chunk_id"), F.lit("!")).alias("candidate"), F.col("chunk_id").alias("src"), "file_path", F.col("name").alias("to_name"), F.lit("calls").alias("relation"))
    out = graph.resolve(calls, sym.select("name", "chunk_id", "file_path"))
    return out.groupBy("src").agg(F.count("*").alias("targets"), F.min("dst").alias("least"), F.max("dst").alias("most"))


@query
def edge_dedup(s, d):
    e = t.read(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), F.when(F.col("l_linenumber") % 5 == 0, "unknown").otherwise("calls").alias("relation"))
    return graph.distinct_edges(e)


@query
def delete_file_symbols(s, d):
    gone = t.symbols(s, d).where("file_path IN ('Brand#11', 'Brand#12', '3', '4')").select("file_path").distinct()
    nodes, left = graph.delete_files(t.symbols(s, d), t.edges(s, d), gone)
    return nodes.select(F.lit("node").alias("what"), "kind").unionByName(left.select(F.lit("edge").alias("what"), F.col("relation").alias("kind"))).groupBy("what", "kind").agg(F.count("*").alias("n"))


@query
def containment_defines(s, d):
    return graph.containment(t.spans(s, d))


@query
def chunk_symbol_link(s, d):
    sym = t.spans(s, d)
    c = sym.select(F.concat_ws("/", F.col("file_path").cast("string"), F.col("ord").cast("string")).alias("id"), "file_path", "start_line")
    doubled = sym.unionByName(sym.withColumns({"ord": F.col("ord") + 100, "name": F.lit("later")}))
    return graph.link_chunks(c, doubled)


@query
def symbol_name_map(s, d):
    return graph.name_map(t.symbols(s, d), per_file=True)


@query
def graph_upserts(s, d):
    sym, e = t.symbols(s, d), t.edges(s, d)
    new = sym.where("kind = 'class'").withColumn("name", F.upper("name"))
    more = e.where("relation = 'defines'").select("src", "dst", F.lit("imports").alias("relation")).unionByName(e.where("relation = 'inherits_from'").select(F.concat(F.col("src"), F.lit("?")).alias("src"), "dst", "relation"))
    nodes = graph.upsert_nodes(sym, new)
    return graph.upsert_edges(e, more, nodes).groupBy("relation").agg(F.count("*").alias("n"))


@query
def classify_paths(s, d):
    return inventory.classified(t.tree(s, d)).select("path", "decision")


@query
def classify_layered(s, d):
    rules = [x["rule"] for x in inventory.layered(("shipped", ["**/dist/**", "*.snap"]), ("global", ["!web/dist/"]), ("family", ["/src/de/"]))]
    return inventory.classified(t.tree(s, d), rules, ["node_modules/", "!node_modules/pkg/en/"]).select("path", "decision")


@query
def language_detect(s, d):
    return t.tree(s, d).select("path", language(F.col("path")).alias("language"))


def _decided(s, d):
    return inventory.classified(t.tree(s, d))


@query
def tier_totals(s, d):
    return inventory.tiers(_decided(s, d))


@query
def ancestor_costs(s, d):
    return inventory.directory_costs(_decided(s, d))


@query
def largest_files(s, d):
    return inventory.largest_files(_decided(s, d))


@query
def costly_directories(s, d):
    return inventory.costly_directories(_decided(s, d))


@query
def inventory_advice(s, d):
    out = inventory.advice(_decided(s, d), complete=False)
    return out.select("files", "bytes", "largest", F.array_join("reasons", ",").alias("reasons"), "advice")


@query
def nearest_ancestor(s, d):
    roots = t.tree(s, d).select(F.element_at(F.split("path", "/"), 1).alias("a"), F.element_at(F.split("path", "/"), 2).alias("b")).distinct()
    registered = roots.select(F.col("a").alias("root")).unionByName(roots.where("a <> 'src'").select(F.concat_ws("/", "a", "b").alias("root"))).distinct().withColumn("family_id", F.md5("root"))
    return registry.nearest_ancestor(t.tree(s, d).select("path"), registered)


@query
def identity_lookup(s, d):
    fam = t.read(s, d, "customer").select(F.col("c_custkey").alias("family_id"), F.lit("git").alias("identity_kind"), F.col("c_name").cast("binary").alias("identity_key"), F.when(F.col("c_custkey") % 9 == 0, F.lit(ANCHOR)).alias("retired_at"))
    keys = t.read(s, d, "customer").where("c_custkey % 4 = 0").select(F.lit("git").alias("identity_kind"), F.col("c_name").cast("binary").alias("identity_key"))
    return registry.by_identity(fam, keys).select("family_id", F.col("identity_key").cast("string").alias("name"))


@query
def reconcile_checkouts(s, d):
    c = t.read(s, d, "customer")
    name, k = F.concat(F.lit("g"), F.col("c_custkey").cast("string")), F.col("c_custkey")
    stored = c.where("c_custkey % 5 <> 0").select(name.alias("git_dir"), k.cast("string").alias("checkout_id"), F.lit("/r").alias("root"), F.lit(1).alias("incarnation"))
    found = c.where("c_custkey % 7 <> 0").select(name.alias("git_dir"), F.when(k % 11 == 0, "/moved").otherwise("/r").alias("root"), F.when(k % 13 == 0, 2).otherwise(1).alias("incarnation"))
    return registry.reconcile(stored, found)


@query
def live_families(s, d):
    c = t.read(s, d, "customer").select(F.col("c_custkey").alias("family_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit(ANCHOR)).alias("retired_at"))
    return registry.live(c).select("family_id", "name")


@query
def fleet_decision(s, d):
    return t.fleet(s, d).select("family_id", policy.fleet_decision().alias("decision"))


@query
def missing_grace(s, d):
    rows = t.read(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("missing_since"))
    return rows.select("event_id", policy.missing_state(F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("state"))


@query
def policy_impact(s, d):
    k = F.col("c_custkey")
    old, new = (lambda m: F.when(k % m == 0, "a").otherwise("b")), F.lit("b")
    return t.read(s, d, "customer").select(k.alias("family_id"), policy.impact_column((old(7), new), (old(11), new), (old(3), new), (old(2), new)).alias("impact"))


@query
def effective_rules(s, d):
    return policy.rule_table(s, [("shipped", policy.defaults()["index"]["vendor"]), ("global", ["third_party/"]), ("family", ["!vendor/", "gen/**"])])


@query
def receipts_state(s, d):
    c = t.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("receipt_id"), F.when(F.col("c_custkey") % 4 == 0, "finished").otherwise("accepted").alias("state"), (F.col("c_custkey") % 10).alias("progress"), F.lit(None).cast("string").alias("result"))
    orders = t.read(s, d, "orders")
    moved = orders.select(F.col("o_custkey").cast("string").alias("receipt_id"), (F.col("o_orderkey") % 20).alias("to"))
    done = orders.where("o_custkey % 6 = 0").select(F.col("o_custkey").cast("string").alias("receipt_id")).distinct().withColumns({"outcome": F.lit("failed"), "value": F.lit("x")})
    return registry.finished(registry.checkpointed(registry.accept(c, c), moved), done)


@query
def work_cancel(s, d):
    w = t.read(s, d, "customer").select(F.col("c_custkey").alias("work_id"), F.when(F.col("c_custkey") % 3 == 0, "done").otherwise("accepted").alias("state"))
    return registry.cancelled(w, t.read(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("work_id"))).groupBy("state").agg(F.count("*").alias("n"))


@query
def compare_and_swap(s, d):
    w = t.read(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("revision"), F.lit("old").alias("state"))
    return registry.swapped(w, F.col("id") % 2 == 0, F.col("revision") == 3, {"state": F.lit("new"), "revision": F.col("revision") + 1})


@query
def event_window_counts(s, d):
    return streams.repeated(t.read(s, d, "events"), "event_type", 3600)


@query
def change_audit(s, d):
    known = t.changes(s, d).where("event_id % 50 <> 7 AND family_id % 2 = 0").select("path").distinct()
    out = streams.needs_audit(t.changes(s, d).where("kind <> 'access' AND (family_id % 3 <> 0 OR event_id % 50 <> 7)"), known)
    return out.select("family_id", "full_audit", F.size("paths").alias("paths"))


@query
def debounce_batches(s, d):
    return streams.debounced(t.changes(s, d), 6 * 3600 * 1000).select("family_id", "batch", "opened", F.size("paths").alias("paths"))


@query
def rule_violations(s, d):
    c = t.chunks(s, d).join(t.vectors(s, d), "id", "left")
    bad = c.select("id", F.when(F.col("id") % 50 == 0, "").otherwise(F.col("content")).alias("content"), "file_path", F.when(F.col("id") % 40 == 0, 9).otherwise(1).alias("start_line"), F.lit(5).alias("end_line"), F.when(F.col("id") % 30 == 0, "odd").when(F.col("id") % 31 == 0, "pending").otherwise("embedded").alias("embedding_state"), "tier", "embedding")
    return violations(bad, "chunks")


@query
def line_counts(s, d):
    return t.read(s, d, "documents").select("doc_id", F.size(lines_of(F.col("text"))).alias("lines"), F.octet_length("text").alias("bytes"), under_root("/root/", F.col("source")).alias("path"))


@query
def chunk_files(s, d):
    docs = t.read(s, d, "documents").select(F.col("doc_id").cast("string").alias("version"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit(1).alias("tier"), F.col("text").alias("source"))
    return indexing.chunk_files(docs).groupBy("file_version").agg(F.count("*").alias("chunks"), F.max(F.octet_length("content")).alias("largest"), F.max("end_line").alias("last_line"))


def _programs(s, d):
    """A program for every document, in one of four languages: each line of the text as a comment, and under it a
    declaration named after the line's first word.  So the scanners meet whatever the texts hold."""
    line = F.regexp_replace("line", "[\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029]", " ")
    word = F.regexp_extract(F.col("line"), "[a-z]+", 0)
    lines = t.read(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    name = F.concat(F.lit("f"), (F.col("k") + 1).cast("string"), F.lit("_"), word)
    call = F.concat(F.lit("g"), (F.col("k") % 7).cast("string"))
    kinds = [
        ("py", F.concat(F.lit("# "), line, F.lit("\ndef "), name, F.lit("():\n    return "), call, F.lit("()\n\n"))),
        ("js", F.concat(F.lit("// "), line, F.lit("\nfunction "), name, F.lit("() {\n  return "), call, F.lit("('}' + `{${1}`); }\n\n"))),
        ("rs", F.concat(F.lit("// "), line, F.lit("\nfn "), name, F.lit("() {\n    "), call, F.lit("(\"}\", '{'); }\n\n"))),
        ("ts", F.concat(F.lit("// "), line, F.lit("\nclass "), name, F.lit(" {\n  m() { "), call, F.lit("(); } }\n\n"))),
    ]
    at = F.pmod("doc_id", F.lit(4))
    part, suffix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (ending, text) in enumerate(kinds):
        part, suffix = F.when(at == k, text).otherwise(part), F.when(at == k, F.lit(ending)).otherwise(suffix)
    rows = lines.select("doc_id", "k", part.alias("part"), suffix.alias("suffix"))
    parts = rows.groupBy("doc_id").agg(F.first("suffix").alias("suffix"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("source"))
    return parts.select(F.col("doc_id").cast("string").alias("version"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.col("suffix")).alias("path"), F.lit(1).alias("tier"), "source")


@query
def parse_symbols(s, d):
    return indexing.symbols_of(_programs(s, d)).select("file_path", "ord", "name", "kind", "start_line", "end_line")


@query
def parse_calls(s, d):
    return indexing.edge_candidates(_programs(s, d)).where("relation = 'calls'").select("file_path", "from_ord", "from_line", "to_name")
