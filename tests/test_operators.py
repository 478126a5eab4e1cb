import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.functions.embed import ConstantBackend
from loamwork.functions.vector import cosine, cosine_batched
from loamwork.operators import graph, indexing, inventory, knowledge, registry, search, usage, versions
from loamwork.schema import violations
from loamwork.sources.catalog import Catalog, Conflict
from loamwork.streaming import changes


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def results(spark, ids):
    return spark.createDataFrame([(i, float(len(ids) - k)) for k, i in enumerate(ids)], "id string, score double")


def test_fuse(spark):
    got = search.fuse([results(spark, ["a", "b"]), results(spark, ["a", "c"])], 10).collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", round(2 / 60, 9)), ("b", round(1 / 61, 9)), ("c", round(1 / 61, 9))]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), unique=True, max_size=12), st.lists(st.integers(0, 30), unique=True, max_size=12), st.integers(1, 8))
def test_fuse_properties(spark, a, b, limit):
    got = search.fuse([results(spark, [str(x) for x in a]), results(spark, [str(x) for x in b])], limit).collect()
    assert len(got) == min(limit, len(set(a) | set(b)))
    assert all(x["score"] > 0 for x in got) and [x["score"] for x in got] == sorted((x["score"] for x in got), reverse=True)


@pytest.mark.parametrize("bad", [0, -1, 1001])
def test_limits(bad):
    with pytest.raises(ValueError):
        search.check_limit(bad)


def test_unusable_vectors_are_never_found(spark):
    v = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [float("nan"), 1.0]), ("d", [-1.0, 0.0]), ("e", None), ("f", [1.0]), ("g", [float("inf"), 1.0])]
    df = spark.createDataFrame(v, "id string, embedding array<float>")
    assert rows(search.semantic(df, [1.0, 0.0])) == [("a", 1.0)]
    assert rows(search.semantic(df, [1.0, 0.0], positive_only=False)) == [("a", 1.0), ("d", -1.0)]
    both = df.select(cosine(F.col("embedding"), [0.5, 0.5]).alias("x"), cosine_batched([0.5, 0.5])(F.col("embedding")).alias("y")).collect()
    assert [r["x"] for r in both] == [r["y"] for r in both]
    with pytest.raises(ValueError):
        cosine(F.col("embedding"), [0.0, 0.0])


def test_fulltext_needs_all_terms(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "x x"), ("c", None), ("d", "Y. x")], "id string, content string")
    assert [r["id"] for r in search.fulltext(df, "x Y").collect()] == ["a", "d"]
    assert search.fulltext(df, "...").count() == 0


def view(spark, pairs):
    return spark.createDataFrame(pairs, "path string, version string")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("123")), st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("123")), st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("1234")))
def test_views_survive_a_moving_base(spark, old, new, seen):
    base, after = view(spark, list(old.items())), view(spark, list(new.items()))
    deltas = versions.minimal_deltas(base, view(spark, list(seen.items())))
    assert rows(versions.visible(base, deltas)) == sorted(seen.items())
    k = spark.createDataFrame([("k",)], "checkout_id string")
    moved = versions.move_base(base, after, deltas.withColumn("checkout_id", F.lit("k")), k)
    assert rows(versions.visible(after, moved)) == sorted(seen.items())
    assert moved.count() == versions.minimal_deltas(after, view(spark, list(seen.items()))).count()


def test_versions_are_reused_only_for_equal_sources(spark):
    files = spark.createDataFrame([("p", "h", 1, "s"), ("q", "h", 1, "s"), ("r", "h", 2, "s")], "path string, content_hash string, tier int, source string")
    known = spark.createDataFrame([("v1", "p", "h", 1, "s"), ("v2", "q", "h", 1, "other"), ("v3", "r", "h", 1, "s")], "id string, path string, content_hash string, tier int, source string")
    got = {r["path"]: (r["version"], r["is_new"]) for r in versions.assign_versions(files, known).collect()}
    assert got["p"] == ("v1", False) and got["q"][1] and got["r"][1] and len({v for v, _ in got.values()}) == 3


def test_nothing_kept_makes_all_orphans(spark):
    stored = spark.createDataFrame([("a",), ("a",), ("b",)], "file_path string")
    assert rows(versions.orphans(stored, spark.createDataFrame([], "path string"))) == [("a",), ("b",)]


PY = "def alpha():\n    return beta()\n\ndef beta():\n    return 1\n"


def files_df(spark, sources):
    return spark.createDataFrame([(p, p, 1, s) for p, s in sources.items()], "version string, path string, tier int, source string")


def test_structure_prefers_the_own_file(spark):
    files = files_df(spark, {"a.py": PY, "b.py": "def beta():\n    pass\n", "c.py": "def gamma():\n    return beta()\n"})
    chunk_rows = indexing.chunk_files(files)
    nodes, edges = indexing.structure(indexing.analysed(files), chunk_rows)
    name = {r["chunk_id"]: (r["file_path"], r["name"]) for r in nodes.collect()}
    assert sorted((name[r["src"]], name[r["dst"]], r["relation"]) for r in edges.collect()) == [
        (("a.py", "alpha"), ("a.py", "beta"), "calls"), (("c.py", "gamma"), ("a.py", "beta"), "calls"), (("c.py", "gamma"), ("b.py", "beta"), "calls"),
    ]
    assert [r["name"] for r in graph.related(nodes, edges, "beta", "callers").collect()] == ["alpha", "gamma"]
    assert [r["name"] for r in graph.related(nodes, edges, "gamma", "callees").collect()] == ["beta", "beta"]
    with pytest.raises(ValueError):
        graph.related(nodes, edges, "beta", "friends")
    kept, left = graph.delete_files(nodes, edges, spark.createDataFrame([("a.py",)], "file_path string"))
    assert kept.count() == 2 and left.count() == 1


def test_patch_equals_full_resolution(spark):
    before = files_df(spark, {"a.py": PY, "c.py": "def gamma():\n    return beta() + delta()\n"})
    after = files_df(spark, {"a.py": PY.replace("beta", "delta"), "c.py": "def gamma():\n    return beta() + delta()\n"})

    def parts(files):
        chunk_rows = indexing.chunk_files(files)
        nodes = graph.link_chunks(chunk_rows, indexing.symbols_of(files))
        src = chunk_rows.groupBy("file_path", F.col("start_line").alias("from_line")).agg(F.min("id").alias("src"))
        cand = indexing.edge_candidates(files).join(src, ["file_path", "from_line"])
        return nodes, cand

    n0, c0 = parts(before)
    n1, c1 = parts(after)
    old = graph.resolved(c0, n0)
    changed, names = spark.createDataFrame([("a.py",)], "file_path string"), spark.createDataFrame([("beta",), ("delta",)], "name string")
    assert rows(graph.patch(old, c1, n1, changed, names)) == rows(graph.resolve(c1, n1))


def test_backfill_embeds_each_content_once(spark):
    c = spark.createDataFrame([(str(k), 2, s, "pending", s) for k, s in enumerate(["x", "x", "y"])], "id string, tier int, content string, embedding_state string, content_hash string").withColumn("embedding", F.lit(None).cast("array<float>"))
    assert rows(indexing.pending_groups(c)) == [("x", "x", 2), ("y", "y", 1)]
    done = indexing.backfill(c, ConstantBackend(4))
    assert done.where("embedding_state = 'embedded' AND size(embedding) = 4").count() == 3 and indexing.pending_groups(done).count() == 0
    first = indexing.prepared(c.drop("embedding", "embedding_state").withColumn("tier", F.when(F.col("id") == "2", 2).otherwise(1)), ConstantBackend(4))
    assert {r["id"]: r["embedding_state"] for r in first.collect()} == {"0": "embedded", "1": "embedded", "2": "pending"}
    assert violations(first.withColumns({"file_path": F.lit("p"), "start_line": F.lit(1), "end_line": F.lit(1)}), "chunks").count() == 0


def test_inventory(spark):
    files = [("src/main.rs", 10), ("ignored.odd", 10), ("node_modules/pkg/a.js", 6), ("excluded/deep/file", 5), (".git/config", 9)]
    d = inventory.classified(spark.createDataFrame(files, "path string, size long"), ["excluded/"], ["node_modules/"])
    assert rows(inventory.tiers(d)) == [("drop", 2, 14), ("tier1", 2, 20), ("tier2", 1, 6)]
    assert rows(inventory.directory_costs(d)) == [("node_modules", 1, 6), ("node_modules/pkg", 1, 6), ("src", 1, 10)]
    assert inventory.advice(d).first()["reasons"] == ["selected_dependency_build_or_environment_directory"]


def test_usage_overflow(spark):
    u = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "t", None, 2**31, None)], "id long, ts timestamp, tool string, repo_path string, duration_ms long, result_count long")
    with pytest.raises(Exception, match="out of range"):
        usage.checked(u).collect()
    assert usage.checked(u.withColumn("duration_ms", F.lit(None).cast("long"))).first()["duration_ms"] is None
    got = spark.createDataFrame([('{"results":[1,2]}',), ('{"symbols":[]}',), ("{}",)], "j string").select(usage.result_count(F.col("j")).alias("n"))
    assert [r["n"] for r in got.collect()] == [2, 0, None]


def test_notes(spark):
    schema = "id string, repo_path string, title string, body string, created_at int, updated_at int"
    old, new = spark.createDataFrame([("a", "r", "t", "b", 1, 1)], schema), spark.createDataFrame([("a", "r", "t2", "b", 5, 5), ("z", "r", "x", "y", 5, 5)], schema)
    assert rows(knowledge.upsert(old, new)) == [("a", "r", "t2", "b", 1, 5), ("z", "r", "x", "y", 5, 5)]
    assert [r["id"] for r in knowledge.listed(knowledge.upsert(old, new)).collect()] == ["a", "z"]


def test_receipts(spark):
    schema = "receipt_id string, family_id string, state string, progress long, result string"
    old = spark.createDataFrame([("a", "f", "running", 5, None), ("b", "f", "finished", 9, "x")], schema)
    again = registry.accept(old, spark.createDataFrame([("a", "f", "accepted", 0, None), ("c", "f", "accepted", 0, None)], schema))
    moved = registry.checkpointed(again, spark.createDataFrame([("a", 3), ("b", 99), ("c", 1)], "receipt_id string, to long"))
    done = registry.finished(moved, spark.createDataFrame([("a", "failed", "e"), ("b", "failed", "e")], "receipt_id string, outcome string, value string"))
    assert rows(done) == [("a", "f", "failed", 5, "e"), ("b", "f", "finished", 9, "x"), ("c", "f", "running", 1, None)]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    first = c.snapshot()
    assert first.number == 0 and first.table("edges").count() == 0
    e = lambda *x: spark.createDataFrame([(i, i, "calls") for i in x], "src string, dst string, relation string")
    one = c.commit(first, {"edges": e("a")})
    with pytest.raises(Conflict):
        c.commit(first, {"edges": e("b")})
    two = c.commit(one, {"edges": e("a", "b")})
    assert one.table("edges").count() == 1 and two.table("edges").count() == 2 == c.snapshot().table("edges").count()
    assert c.vacuum(keep=1) == 1 and c.snapshot().table("edges").count() == 2


def test_engine_end_to_end(spark, tmp_path):
    import io

    from loamwork.serve import Engine

    tree = tmp_path / "repo"
    for path, text in {"src/a.py": PY, "node_modules/p/i.js": "function vendored() { return 1; }\n", "x.min.js": "min", "bin.dat": "a\0b"}.items():
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(text)
    engine = Engine(spark, f"file://{tmp_path}/store")
    fid = engine.call("register_family", {"path": str(tree), "name": "r"})["family_id"]
    assert engine.reindex_family(fid) == {"indexed": True, "files": 2, "chunks": 3}
    with pytest.raises(KeyError):
        engine.search_fulltext("vendored", str(tmp_path / "other"))
    assert [r["file_path"] for r in engine.search_fulltext("vendored", str(tree))["results"]] == [f"{tree}/node_modules/p/i.js"]
    found = engine.search_hybrid("alpha beta", str(tree / "src"))["results"]
    assert found and found[0]["file_path"] == f"{tree}/src/a.py"
    assert [s["name"] for s in engine.search_structural("beta", "callers", str(tree))["symbols"]] == ["alpha"]
    (tree / "src/b.py").write_text("def delta():\n    return alpha()\n")
    assert engine.start_family(fid)["files"] == 3
    assert sorted(s["name"] for s in engine.search_structural("alpha", "callers", str(tree))["symbols"]) == ["delta"]
    note = engine.record_knowledge("why", "alpha calls beta", "r")["id"]
    assert [n["id"] for n in engine.search_knowledge("beta")["results"]] == [note]
    assert engine.delete_knowledge(note) == {"deleted": True}
    own = engine.inspect_policy(fid)
    changed = own["policy"] | {"index": {"exclude": ["src/"], "vendor": []}}
    assert engine.check_policy(fid, changed) == {"valid": True, "impact": "selection"}
    assert engine.apply_policy(fid, own["revision"], changed)["applied"] and not engine.apply_policy(fid, own["revision"], changed)["applied"]
    assert engine.preflight_family(fid)["files"] == 2  # no content is read, so the binary file counts
    assert engine.tools["pause_family"](fid)["paused"] and len(engine.tools) == 24
    out = io.StringIO()
    engine.serve(io.StringIO('{"id":1,"method":"tools/call","params":{"name":"inspect_status","arguments":{}}}\nnonsense\n'), out)
    first, second = map(json.loads, out.getvalue().splitlines())
    assert json.loads(first["result"]["content"][0]["text"])["families"][0]["name"] == "r" and "error" in second
    assert engine.forget_repository(fid)["forgotten"] and engine.store.shared("chunks", fid, 0).count() == 0


def test_protocol_and_log_of_uses(spark, tmp_path, monkeypatch):
    import io

    from loamwork import serve

    engine, out = serve.Engine(spark, f"file://{tmp_path}/store"), io.StringIO()
    asked = [{"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "ping"}, {"id": 3, "method": "tools/list"}, [1], {"id": 4, "method": "other"}]
    engine.serve(io.StringIO("".join(json.dumps(x) + "\n" for x in asked)), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in answers] == [1, 2, 3, None, 4] and ["error" in x for x in answers] == [False, False, False, True, True]
    assert answers[0]["result"]["capabilities"] == {"tools": {}}
    tools = {t["name"]: t["inputSchema"] for t in answers[2]["result"]["tools"]}
    assert len(tools) == 24 and tools["search_hybrid"]["required"] == ["query", "cwd"] and tools["search_hybrid"]["properties"]["limit"] == {"type": "integer"}
    assert tools["record_knowledge"]["properties"]["tags"]["type"] == "array" and tools["apply_policy"]["properties"]["policy_json"] == {"type": "object"}
    assert tools["recreate_index"] == {"type": "object", "properties": {}, "required": []}

    note = engine.record_knowledge("Über", "日本 text", "r")["id"]
    for query in ("über", "日本"):
        assert [n["id"] for n in engine.search_knowledge(query)["results"]] == [note]

    assert engine.call("list_knowledge", {})["results"]
    assert engine.call("list_knowledge", {})["results"]
    assert [(r["tool"], r["result_count"]) for r in engine.uses().collect()] == [("list_knowledge", 1)] * 2
    monkeypatch.setattr(engine.store, "root", "nowhere://")
    assert engine.call("list_knowledge", {})["results"]  # not logged, but answered


def test_drains_are_capped():
    assert changes.drained(["b", "a", "b"]) == [["a", "b"]] and changes.drained([]) == []
    many = [f"p{k:05}" for k in range(2_100)]
    assert [len(x) for x in changes.drained(many[::-1])] == [1024, 1024, 52] and sum(changes.drained(many), []) == many


def test_names_are_resolved_in_the_own_file_first_and_hot_ones_are_dealt(spark, monkeypatch):
    """One name with a tenth of all symbols: the same edges however few candidates a task takes, and tasks of even size."""
    import random

    rng = random.Random(1)
    symbols = [(f"s{k}", "new" if k % 10 == 0 else f"n{k % 97}", f"f{k % 60}") for k in range(1000)]
    calls = [(f"s{rng.randrange(1000)}", f"f{rng.randrange(90)}", rng.choice(["new", "new", f"n{rng.randrange(97)}", "none"]), "calls") for _ in range(2000)]
    s = spark.createDataFrame(symbols, "chunk_id string, name string, file_path string")
    c = spark.createDataFrame(calls, "src string, file_path string, to_name string, relation string")
    want = set()
    for src, path, name, relation in calls:
        there = [(i, f) for i, n, f in symbols if n == name]
        local = [i for i, f in there if f == path]
        want |= {(src, i, relation) for i in (local or [i for i, _ in there])}
    assert set(rows(graph.resolve(c, s))) == want
    monkeypatch.setattr(graph, "HOT_NAME", 50)
    dealt = graph.resolved(c, s)
    assert set(rows(dealt.select("src", "dst", "relation"))) == want and dealt.count() == len(set(rows(dealt)))
    sizes = [r["n"] for r in dealt.where("to_name = 'new'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 10 * sorted(sizes)[len(sizes) // 2]


def test_views_of_all_checkouts_need_no_cross_join(spark):
    base = view(spark, [(p, f"b{p}") for p in "abcd"])
    deltas = spark.createDataFrame([("k1", "a", "x"), ("k1", "b", None), ("k2", "e", "y"), ("other", "c", "z"), ("k2", "a", "x")], "checkout_id string, path string, version string")
    ids = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "checkout_id string")
    seen = versions.visible_all(base, deltas, ids)
    for k in ("k1", "k2", "k3"):
        assert rows(seen.where(F.col("checkout_id") == k).select("path", "version")) == rows(versions.visible(base, deltas.where(F.col("checkout_id") == k)))
    assert seen.count() == sum(versions.visible(base, deltas.where(F.col("checkout_id") == k)).count() for k in ("k1", "k2", "k3"))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert versions.visible_sets(base, deltas).count() == 7  # as many as distinct versions, whatever the checkouts
