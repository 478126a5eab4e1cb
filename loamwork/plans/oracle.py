"""SQL for the queries, over the driver's tables; written on its own from what each operator means."""

from __future__ import annotations

_PATH = "lang || '/' || source || '/doc_' || doc_id || '.txt'"
_TF = "regexp_extract_all(lower(content), '[a-z0-9]+')"
_BEST = "ORDER BY score DESC, id LIMIT"


def _ft(rows: str, limit: int) -> str:
    """Full text for the words `the` and `and`."""
    n = lambda w: f"len(list_filter(t, lambda x: x = '{w}'))"
    return f"SELECT id, round(2 + ln({n('and')}) + ln({n('the')}), 6) AS score FROM (SELECT id, {_TF} AS t FROM {rows} WHERE content IS NOT NULL) WHERE {n('and')} > 0 AND {n('the')} > 0 {_BEST} {limit}"


def _sem(rows: str, limit: int, positive: bool = True) -> str:
    cosine = "round(list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
    return f"SELECT id, {cosine} AS score FROM {rows} r, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE r.embedding IS NOT NULL" + (f" AND {cosine} > 0" if positive else "") + f" {_BEST} {limit}"


def _fuse(parts: list[str], limit: int) -> str:
    every = " UNION ALL ".join(f"SELECT id, 1.0::DOUBLE / (59 + row_number() OVER (ORDER BY score DESC, id)) AS c FROM ({p})" for p in parts)
    return f"SELECT id, round(sum(c), 9) AS score FROM ({every}) GROUP BY id {_BEST} {limit}"


_SEARCHABLE = "(SELECT coalesce(doc_id, vec_id) AS id, text AS content, embedding FROM documents FULL JOIN embeddings ON doc_id = vec_id)"
_VECTORS = "(SELECT vec_id AS id, embedding FROM embeddings)"
_NOTES = "(SELECT c.*, embedding FROM (SELECT conv_id * 1000 + turn AS id, role AS repo_path, substr(text, 1, 40) AS title, text AS body, conv_id * 1000 + turn AS updated_at, substr(text, 1, 40) || ' ' || text AS content FROM conversations) c LEFT JOIN embeddings ON id = vec_id)"
_TIER = "CASE WHEN quality = 0 THEN 2 ELSE 1 END"
_CHUNKS = f"""(SELECT d.doc_id AS id, {_PATH.replace('doc_id', 'd.doc_id')} AS file_path, 1 AS start_line, len(string_split(text, chr(10))) AS end_line, text AS content, {_TIER} AS tier,
 CASE WHEN {_TIER} = 2 AND d.doc_id % 2 = 0 THEN 'pending' WHEN d.doc_id % 97 = 0 THEN 'absent' ELSE 'embedded' END AS embedding_state, sha256(text) AS content_hash
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_BASE = f"(SELECT {_PATH} AS path, 'b' || doc_id AS version FROM documents WHERE doc_id % 10 <> 9)"
_NEW_BASE = f"(SELECT {_PATH} AS path, CASE WHEN doc_id % 7 = 0 THEN 'm' ELSE 'b' END || doc_id AS version FROM documents WHERE doc_id % 10 <> 9 AND doc_id % 11 <> 0)"
_KS = "(SELECT 'k' || k AS checkout_id, k FROM range(5) r(k))"
_DELTAS = f"""(SELECT checkout_id, CASE WHEN added THEN 'new/' || p ELSE p END AS path, CASE WHEN doc_id % 10 = k THEN 'c' || k || '_' || doc_id WHEN added THEN 'n' || k || '_' || doc_id END AS version
 FROM (SELECT checkout_id, k, doc_id, {_PATH} AS p, doc_id % 10 = 9 AND doc_id % 5 = k AS added FROM documents, {_KS}) WHERE doc_id % 10 = k OR added OR (doc_id % 17 = k AND doc_id % 10 <> 9))"""
_K1 = f"(SELECT * FROM {_DELTAS} WHERE checkout_id = 'k1')"
_VISIBLE_K1 = f"(SELECT path, version FROM {_BASE} b WHERE NOT EXISTS (SELECT 1 FROM {_K1} x WHERE x.path = b.path) UNION ALL SELECT path, version FROM {_K1} WHERE version IS NOT NULL)"
_SEEN = f"""(SELECT k.checkout_id, path, version FROM {_KS} k, {_BASE} b WHERE NOT EXISTS (SELECT 1 FROM {_DELTAS} x WHERE x.path = b.path AND x.checkout_id = k.checkout_id)
 UNION ALL SELECT checkout_id, path, version FROM {_DELTAS} WHERE version IS NOT NULL)"""
_VERSIONED = f"(SELECT p || id AS id, content, embedding FROM (SELECT *, unnest(CASE WHEN id % 10 = 1 THEN ['b', 'c1_'] WHEN id % 10 = 9 THEN ['n4_', 'n1_'] ELSE ['b'] END) AS p FROM {_SEARCHABLE} WHERE content IS NOT NULL))"
_MASKED = f"(SELECT * FROM {_VERSIONED} WHERE id IN (SELECT version FROM {_VISIBLE_K1}))"
_SYMBOLS = """(SELECT 'p' || p_partkey AS chunk_id, p_name AS name, 'function' AS kind, p_brand AS file_path, p_size::INT AS start_line, p_size::INT + 5 AS end_line FROM part
 UNION ALL SELECT 's' || s_suppkey, s_name, 'class', s_nationkey::VARCHAR, (s_suppkey % 50)::INT, (s_suppkey % 50 + 5)::INT FROM supplier
 UNION ALL SELECT 'n' || n_nationkey, n_name, 'module', n_regionkey::VARCHAR, n_nationkey::INT, (n_nationkey + 5)::INT FROM nation
 UNION ALL SELECT 'r' || r_regionkey, r_name, 'module', 'world', r_regionkey::INT, (r_regionkey + 5)::INT FROM region)"""
_EDGES = """(SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, 'calls' AS relation FROM lineitem UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'defines' FROM supplier
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'inherits_from' FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'imports' FROM supplier)"""


def _hop(table: str, column: str, relation: str, incoming: bool) -> str:
    here, there = ("dst", "src") if incoming else ("src", "dst")
    return f"WITH s AS {_SYMBOLS}, e AS {_EDGES} SELECT * FROM s WHERE chunk_id IN (SELECT {there} FROM e WHERE relation = '{relation}' AND {here} IN (SELECT chunk_id FROM s WHERE name = (SELECT min({column}) FROM {table})))"


_SPANS = """(SELECT l_orderkey AS file_path, l_linenumber::INT AS ord, 's' || l_partkey AS name, CASE WHEN l_linenumber % 3 = 1 THEN 'class' ELSE 'function' END AS kind, l_linenumber::INT AS start_line,
 (l_linenumber + floor(l_quantity % 5))::INT AS end_line FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))"""
_TREE = """(SELECT CASE doc_id % 12 WHEN 0 THEN 'node_modules/pkg/' WHEN 1 THEN 'web/dist/' WHEN 2 THEN '.git/objects/' WHEN 3 THEN 'vendor/lib/' ELSE 'src/' END || lang || '/' || source || '/f' || doc_id ||
 CASE doc_id % 12 WHEN 4 THEN '.min.js' WHEN 5 THEN '.rs' WHEN 6 THEN '.py' WHEN 7 THEN '.tsx' WHEN 8 THEN '.snap' WHEN 9 THEN '.PY' ELSE '.txt' END AS path, n_chars AS size, doc_id FROM documents)"""
_DECISION = "CASE WHEN doc_id % 12 IN (2, 4, 8) THEN 'drop' WHEN doc_id % 12 IN (0, 1, 3) THEN 'tier2' ELSE 'tier1' END"
_DECIDED = f"(SELECT path, size, {_DECISION} AS decision FROM {_TREE})"
_DIRS = f"(SELECT array_to_string(parts[1:n], '/') AS path, size FROM (SELECT string_split(path, '/') AS parts, size, unnest(range(1, len(string_split(path, '/')))) AS n FROM {_DECIDED} WHERE decision <> 'drop'))"
_CHANGES = """(SELECT user_id % 20 AS family_id, 'u' || user_id || CASE WHEN event_id % 50 = 7 THEN '' ELSE '/f' || (event_id % 50) END AS path,
 CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' WHEN 2 THEN 'remove' ELSE 'access' END AS kind, ts, event_id FROM events)"""
_VENDOR = ["**/node_modules/**", "**/vendor/**", "vendor/", "**/.venv/**", "**/venv/**", "**/site-packages/**", "**/target/**", "**/dist/**", "**/build/**", "**/.tox/**", "**/__pycache__/**"]
_RULES = [("shipped", k, r) for k, r in enumerate(_VENDOR)] + [("global", 0, "third_party/"), ("family", 0, "!vendor/"), ("family", 1, "gen/**")]
_RECENT = "ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY"

ORACLE_SQL: dict[str, str] = {
    "fulltext_search": _ft(_SEARCHABLE, 20),
    "fulltext_indexed": _ft(_SEARCHABLE, 20),
    "fulltext_no_terms": "SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents WHERE false",
    "semantic_search": _sem(_VECTORS, 20),
    "semantic_indexed": f"""SELECT query, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM
 (SELECT q.vec_id AS query, r.id, round(list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM {_VECTORS} r, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)
 WHERE score > 0) WHERE rank <= 10""",
    "hybrid_rrf": _fuse([_sem(_SEARCHABLE, 200), _ft(_SEARCHABLE, 200)], 20),
    "hybrid_candidates_cap": _fuse([_sem(_SEARCHABLE, 1000), _ft(_SEARCHABLE, 1000)], 200),
    "rrf_single_list": _fuse([_sem(_VECTORS, 30)], 20),
    "search_results": f"SELECT c.id, '/work/repo/' || file_path AS file_path, start_line, end_line, score, content FROM {_CHUNKS} c JOIN ({_ft(_CHUNKS, 20)}) r ON c.id = r.id",
    "knowledge_list": f"SELECT id, repo_path, title, updated_at FROM {_NOTES} WHERE repo_path = 'user' ORDER BY updated_at DESC, id LIMIT 50",
    "knowledge_fulltext": _ft(_NOTES, 20),
    "knowledge_semantic": _sem(_NOTES, 20, False),
    "knowledge_hybrid": _fuse([_sem(_NOTES, 40, False), _ft(_NOTES, 40)], 20),
    "usage_total": f"SELECT count(*) AS calls FROM events WHERE {_RECENT}",
    "usage_by_tool": f"SELECT event_type AS tool, count(*) AS calls FROM events WHERE {_RECENT} GROUP BY 1",
    "usage_checked": "SELECT event_id AS id, trunc(value)::INT AS duration_ms, CASE WHEN event_id % 3 = 0 THEN (event_id % 100)::INT END AS result_count FROM events",
    "visible_manifest": f"SELECT * FROM {_VISIBLE_K1}",
    "visible_all": f"SELECT checkout_id, count(*) AS files, min(version) AS least, max(version) AS most FROM {_SEEN} GROUP BY 1",
    "masked_fulltext": _ft(_MASKED, 20),
    "masked_semantic": _sem(_MASKED, 20),
    "masked_hybrid": _fuse([_sem(_MASKED, 200), _ft(_MASKED, 200)], 20),
    "checkout_gate": f"SELECT * FROM {_BASE}",
    "minimal_deltas": f"SELECT path, d.version FROM {_BASE} b FULL JOIN {_VISIBLE_K1} d USING (path) WHERE b.version IS DISTINCT FROM d.version",
    "base_move_preserve": f"""SELECT checkout_id, path, s.version FROM (SELECT k.checkout_id, n.path, n.version FROM {_KS} k, {_NEW_BASE} n) n FULL JOIN {_SEEN} s USING (checkout_id, path) WHERE s.version IS DISTINCT FROM n.version""",
    "gc_versions": f"SELECT id FROM (SELECT unnest(['b', 'm', 'c1_', 'n4_', 'old']) || doc_id AS id FROM documents) WHERE id NOT IN (SELECT version FROM {_BASE}) AND id NOT IN (SELECT version FROM {_DELTAS} WHERE version IS NOT NULL)",
    "protected_cleanup": """SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id NOT IN (SELECT unnest([doc_id + 2, doc_id + 5]) FROM documents WHERE doc_id % 100 = 1)
 AND doc_id NOT IN (SELECT doc_id + 6 FROM documents WHERE doc_id % 50 = 3 AND doc_id % 100 = 3)""",
    "content_hash_versions": f"""SELECT file_path AS path, content_hash, NOT (id % 2 = 0 AND id % 6 <> 0 AND id % 10 <> 0) AS is_new, CASE WHEN id % 2 = 0 AND id % 6 <> 0 AND id % 10 <> 0 THEN 'v' || id END AS known FROM {_CHUNKS}""",
    "embedding_reuse": f"SELECT id, id % 3 = 0 AND id IN (SELECT vec_id FROM embeddings) AS reused FROM {_CHUNKS}",
    "orphan_paths": f"SELECT file_path FROM {_CHUNKS} WHERE id % 4 = 0",
    "pending_groups": f"SELECT content_hash, count(*) AS rows FROM {_CHUNKS} WHERE embedding_state = 'pending' GROUP BY 1 ORDER BY 1 LIMIT 128",
    "backfill_fanout": f"""WITH c AS {_CHUNKS}, g AS (SELECT DISTINCT content_hash FROM c WHERE embedding_state = 'pending' ORDER BY 1 LIMIT 128), s AS (SELECT CASE WHEN embedding_state = 'pending' AND content_hash IN (SELECT content_hash FROM g) THEN 'made' ELSE embedding_state END AS s FROM c)
 SELECT CASE s WHEN 'made' THEN 'embedded' ELSE s END AS embedding_state, count(*) AS rows, count(*) FILTER (s = 'made') AS vectors FROM s GROUP BY 1""",
    "coverage_summary": f"""SELECT count(*) AS total, count(*) FILTER (vec_id IS NOT NULL AND embedding_state = 'embedded') AS usable, count(*) FILTER (embedding_state = 'pending') AS pending,
 count(*) FILTER (vec_id IS NULL AND embedding_state = 'embedded') AS waiting, count(*) FILTER (embedding_state = 'pending' OR vec_id IS NULL AND embedding_state = 'embedded') = 0 AS complete FROM {_CHUNKS} LEFT JOIN embeddings ON id = vec_id""",
    "callers": _hop("supplier", "s_name", "calls", True),
    "callees": _hop("part", "p_name", "calls", False),
    "defines": _hop("nation", "n_name", "defines", False),
    "inheritors": _hop("region", "r_name", "inherits_from", True),
    "inherits": _hop("nation", "n_name", "inherits_from", False),
    "imports": _hop("supplier", "s_name", "imports", False),
    "edge_resolution_local_first": f"""WITH s AS (SELECT file_path || '/' || ord AS chunk_id, name, (file_path % 500)::VARCHAR AS file, ord FROM {_SPANS}),
 j AS (SELECT c.chunk_id AS src, t.chunk_id AS dst, c.file = t.file AS near FROM s c JOIN s t ON c.name = t.name),
 k AS (SELECT DISTINCT src, dst FROM j WHERE near OR src NOT IN (SELECT src FROM j WHERE near))
 SELECT src, count(*) AS targets, min(dst) AS least, max(dst) AS most FROM k GROUP BY 1""",
    "edge_dedup": "SELECT DISTINCT l_partkey::VARCHAR AS src, l_suppkey::VARCHAR AS dst, 'calls' AS relation FROM lineitem WHERE l_linenumber % 5 <> 0",
    "delete_file_symbols": f"""WITH s AS {_SYMBOLS}, e AS {_EDGES}, g AS (SELECT chunk_id FROM s WHERE file_path IN ('Brand#11', 'Brand#12', '3', '4'))
 SELECT 'node' AS what, kind, count(*) AS n FROM s WHERE chunk_id NOT IN (SELECT chunk_id FROM g) GROUP BY 2
 UNION ALL SELECT 'edge', relation, count(*) FROM e WHERE src NOT IN (SELECT chunk_id FROM g) AND dst NOT IN (SELECT chunk_id FROM g) GROUP BY 2""",
    "containment_defines": f'SELECT o.file_path, o.ord AS "outer", i.ord AS "inner" FROM {_SPANS} o JOIN {_SPANS} i ON o.file_path = i.file_path AND o.kind = \'class\' AND o.start_line <= i.start_line AND i.end_line <= o.end_line AND o.ord <> i.ord',
    "chunk_symbol_link": f"SELECT file_path || '/' || ord AS chunk_id, name, kind, file_path, start_line, end_line FROM {_SPANS}",
    "symbol_name_map": f"SELECT file_path, name, min(chunk_id) AS chunk_id FROM {_SYMBOLS} GROUP BY ALL",
    "graph_upserts": f"WITH e AS {_EDGES} SELECT relation, count(*) AS n FROM (SELECT * FROM e UNION SELECT src, dst, 'imports' FROM e WHERE relation = 'defines') GROUP BY 1",
    "classify_paths": f"SELECT path, decision FROM {_DECIDED}",
    "classify_layered": f"""SELECT path, CASE WHEN doc_id % 12 IN (2, 8) OR path LIKE 'src/de/%' THEN 'drop' WHEN doc_id % 12 = 1 THEN 'drop' WHEN path LIKE 'node_modules/%' THEN 'tier2' ELSE 'tier1' END AS decision FROM {_TREE}""",
    "language_detect": f"SELECT path, CASE doc_id % 12 WHEN 4 THEN 'javascript' WHEN 5 THEN 'rust' WHEN 6 THEN 'python' WHEN 7 THEN 'typescript' END AS language FROM {_TREE}",
    "tier_totals": f"SELECT decision, count(*) AS files, sum(size)::BIGINT AS bytes FROM {_DECIDED} GROUP BY 1",
    "ancestor_costs": f"SELECT path, count(*) AS files, sum(size)::BIGINT AS bytes FROM {_DIRS} GROUP BY 1",
    "largest_files": f"SELECT path, size AS bytes FROM {_DECIDED} WHERE decision <> 'drop' ORDER BY size DESC, path LIMIT 20",
    "costly_directories": f"SELECT path, count(*) AS files, sum(size)::BIGINT AS bytes FROM {_DIRS} GROUP BY 1 ORDER BY bytes DESC, files DESC, path LIMIT 20",
    "inventory_advice": f"""SELECT count(*) AS files, sum(size)::BIGINT AS bytes, max(size) AS largest, CASE WHEN count(*) > 10000 THEN 'selected_files_over_10000,' ELSE '' END || CASE WHEN sum(size) > 104857600 THEN 'selected_bytes_over_100_mib,' ELSE '' END ||
 'selected_dependency_build_or_environment_directory,incomplete_inventory' AS reasons, 'refine_configuration_with_or_without_agent' AS advice FROM {_DECIDED} WHERE decision <> 'drop'""",
    "nearest_ancestor": f"SELECT path, root, md5(root) AS family_id FROM (SELECT path, CASE WHEN path LIKE 'src/%' THEN 'src' ELSE array_to_string(string_split(path, '/')[1:2], '/') END AS root FROM {_TREE})",
    "identity_lookup": "SELECT c_custkey AS family_id, c_name AS name FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 4 = 0",
    "reconcile_checkouts": """SELECT 'g' || c_custkey AS git_dir, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey::VARCHAR END AS checkout_id,
 CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 13 = 0 THEN 'replaced' WHEN c_custkey % 11 = 0 THEN 'moved' ELSE 'present' END AS verdict FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 <> 0""",
    "live_families": "SELECT c_custkey AS family_id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0",
    "fleet_decision": """SELECT c_custkey AS family_id, CASE WHEN c_custkey % 23 = 0 THEN 'retire' WHEN c_custkey % 19 = 0 THEN 'wait_missing' WHEN c_custkey % 7 = 0 THEN 'skip_paused' WHEN c_custkey % 11 = 0 THEN 'skip_disabled'
 WHEN c_custkey % 13 = 0 THEN 'skip_dimension' WHEN c_custkey % 3 = 0 THEN 'backfill_and_watch' WHEN c_custkey % 2 <> 0 AND c_custkey % 5 <> 0 THEN 'skip_never_indexed' WHEN c_custkey % 17 = 0 THEN 'skip_foreground'
 WHEN c_custkey % 29 = 0 THEN 'skip_in_flight' WHEN c_custkey % 31 = 0 THEN 'skip_locked' ELSE 'reindex' END AS decision FROM customer""",
    "missing_grace": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'present' WHEN ts <= TIMESTAMP '2024-01-15 11:59:00' THEN 'retired' ELSE 'pending' END AS state FROM events",
    "policy_impact": """SELECT c_custkey AS family_id, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'embedding_profile' WHEN c_custkey % 3 = 0 THEN 'selection' WHEN c_custkey % 2 = 0 THEN 'runtime' ELSE 'display' END AS impact FROM customer""",
    "effective_rules": "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{o}', {k}, '{r}')" for n, (o, k, r) in enumerate(_RULES)) + ") v(ord, origin, position, rule)",
    "receipts_state": """WITH o AS (SELECT o_custkey AS k, max(o_orderkey % 20) AS m FROM orders GROUP BY 1)
 SELECT c_custkey::VARCHAR AS receipt_id, CASE WHEN c_custkey % 4 = 0 THEN 'finished' WHEN k IS NULL THEN 'accepted' WHEN c_custkey % 6 = 0 THEN 'failed' ELSE 'running' END AS state,
 CASE WHEN c_custkey % 4 = 0 OR k IS NULL THEN c_custkey % 10 ELSE greatest(c_custkey % 10, m) END AS progress, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 6 = 0 AND k IS NOT NULL THEN 'x' END AS result FROM customer LEFT JOIN o ON c_custkey = k""",
    "work_cancel": "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'done' WHEN c_custkey % 2 = 0 THEN 'cancelled' ELSE 'accepted' END AS state, count(*) AS n FROM customer GROUP BY 1",
    "compare_and_swap": "SELECT c_custkey AS id, CASE WHEN a THEN 4 ELSE c_custkey % 5 END AS revision, CASE WHEN a THEN 'new' ELSE 'old' END AS state, a AS applied FROM (SELECT *, c_custkey % 2 = 0 AND c_custkey % 5 = 3 AS a FROM customer)",
    "event_window_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type AS fingerprint, count(*) AS seen, count(*) - 1 AS suppressed FROM events GROUP BY 1, 2",
    "change_audit": f"""WITH c AS {_CHANGES}, k AS (SELECT DISTINCT path FROM c WHERE event_id % 50 <> 7 AND family_id % 2 = 0), e AS (SELECT * FROM c WHERE kind <> 'access' AND (family_id % 3 <> 0 OR event_id % 50 <> 7))
 SELECT family_id, bool_or(path IN (SELECT split_part(path, '/', 1) FROM k)) AS full_audit, count(DISTINCT path)::INT AS paths FROM e GROUP BY 1""",
    "debounce_batches": f"""WITH RECURSIVE e AS (SELECT DISTINCT family_id, epoch_us(ts) // 1000 AS ms, path FROM {_CHANGES} WHERE kind <> 'access'),
 b AS (SELECT family_id, 0::BIGINT AS batch, min(ms) AS opened FROM e GROUP BY 1
  UNION ALL SELECT b.family_id, b.batch + 1, (SELECT min(ms) FROM e WHERE e.family_id = b.family_id AND e.ms >= b.opened + 21600000) FROM b WHERE (SELECT min(ms) FROM e WHERE e.family_id = b.family_id AND e.ms >= b.opened + 21600000) IS NOT NULL)
 SELECT b.family_id, batch, make_timestamp(opened * 1000) AS opened, count(DISTINCT path)::INT AS paths FROM b JOIN e ON e.family_id = b.family_id AND e.ms >= opened AND e.ms < opened + 21600000 GROUP BY ALL""",
    "rule_violations": f"""SELECT rule, rows FROM (SELECT 'content is not empty' AS rule, count(*) FILTER (id % 50 = 0) AS rows FROM {_CHUNKS} UNION ALL SELECT 'lines are in order', count(*) FILTER (id % 40 = 0) FROM {_CHUNKS}
 UNION ALL SELECT 'embedding state is known', count(*) FILTER (id % 30 = 0) FROM {_CHUNKS} UNION ALL SELECT 'first-party chunks are never pending', count(*) FILTER (id % 30 <> 0 AND id % 31 = 0 AND tier = 1) FROM {_CHUNKS}) WHERE rows > 0""",
    "line_counts": "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END::INT AS lines, strlen(text)::INT AS bytes, '/root/' || source AS path FROM documents",
    "parse_symbols": """SELECT 'f' || doc_id || '.' || ['py', 'js', 'rs', 'ts'][doc_id % 4 + 1] AS file_path, (k - 1)::INT AS ord, 'f' || k || '_' || regexp_extract(line, '[a-z]+') AS name,
 CASE WHEN doc_id % 4 = 3 THEN 'class' ELSE 'function' END AS kind, (4 * (k - 1) + 1)::INT AS start_line, (4 * (k - 1) + 3)::INT AS end_line
 FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents)""",
    "parse_calls": """SELECT 'f' || doc_id || '.' || ['py', 'js', 'rs', 'ts'][doc_id % 4 + 1] AS file_path, (k - 1)::INT AS from_ord, (4 * (k - 1) + 1)::INT AS from_line, 'g' || ((k - 1) % 7) AS to_name
 FROM (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents) WHERE doc_id % 4 <> 3""",
}
