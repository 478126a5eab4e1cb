"""Logical tables of the engine and the rules their rows must satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES: dict[str, str] = {
    "families": "family_id string, name string, path string, identity_kind string, identity_key binary, embedding_dim int, paused boolean, enabled boolean, ever_indexed boolean, indexed_at timestamp, retired_at timestamp, epoch long",
    "checkouts": "checkout_id string, family_id string, root string, git_dir string, state string, is_base boolean, indexed_at timestamp, missing_since timestamp, retired_at timestamp, generation long, stamp string, problem string",
    "file_versions": "id string, path string, content_hash string, tier short, source string",
    "base_files": "path string, version string",
    "file_deltas": "checkout_id string, path string, version string",
    "chunks": "id string, file_version string, file_path string, start_line int, end_line int, content string, embedding array<float>, tier short, embedding_state string, content_hash string",
    "symbols": "chunk_id string, name string, kind string, file_path string, start_line int, end_line int",
    "edges": "src string, dst string, relation string",
    "knowledge": "id string, repo_path string, title string, body string, tags array<string>, related_files array<string>, created_at timestamp, updated_at timestamp, embedding array<float>",
    "usage": "id long, ts timestamp, tool string, repo_path string, duration_ms int, result_count int",
    "policies": "family_id string, revision long, policy string",
    "accepted_work": "work_id string, family_id string, state string, captured_ids array<string>",
    "active_readers": "reader_id string, family_id string, references array<string>",
    "receipts": "receipt_id string, family_id string, state string, progress long, result string",
}

RELATIONS = ("calls", "imports", "defines", "inherits_from")
SYMBOL_KINDS = ("function", "class", "module", "import")
EMBEDDING_STATES = ("embedded", "pending", "absent")

#: Rules by table: name -> condition that every row satisfies.
RULES: dict[str, dict[str, Column | str]] = {
    "chunks": {
        "content is not empty": "content IS NOT NULL AND content <> ''",
        "path is not empty": "file_path IS NOT NULL AND file_path <> ''",
        "lines are in order": "end_line >= start_line",
        "embedding state is known": "embedding_state IN ('embedded', 'pending', 'absent')",
        "first-party chunks are never pending": "NOT (tier = 1 AND embedding_state = 'pending')",
        "vectors are usable": "embedding IS NULL OR (NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0))",
    },
    "edges": {"relation is known": "relation IN ('calls', 'imports', 'defines', 'inherits_from')"},
    "symbols": {"kind is known": "kind IN ('function', 'class', 'module', 'import')"},
    "checkouts": {"retired goes with its time": "(state = 'retired') = (retired_at IS NOT NULL)"},
    "families": {"identity is whole or absent": "(identity_kind IS NULL) = (identity_key IS NULL)"},
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """rule, rows: how many rows break each rule of a table, in one pass; rules that hold are left out."""
    rules = RULES.get(table, {})
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, rows long")
    counts = [F.count_if(~F.coalesce(F.expr(str(c)), F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())]
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("rows")) for i, name in enumerate(rules)]))
    return df.agg(*counts).select(pairs.alias("x")).select("x.*").where("rows > 0")
