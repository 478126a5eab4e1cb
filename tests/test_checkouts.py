"""Two Git worktrees of one family: separate results, incremental publication, and what is rewritten."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loamwork.operators import checkouts as linked
from loamwork.operators import graph
from loamwork.serve import Engine


def sh(cwd, *args):
    subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-c", "commit.gpgsign=false", *args], cwd=cwd, check=True, capture_output=True)


@pytest.fixture
def family(spark, tmp_path):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}  # plans are many and small here
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield _family(spark, tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _family(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    (one / "src").mkdir()
    (one / "src" / "a.py").write_text("def alpha():\n    return beta()\n\ndef beta():\n    return 1\n")
    (one / "b.py").write_text("def user():\n    return alpha()\n")
    (one / "deleted.txt").write_text("gone soon\n")
    sh(one, "init", "-q", "-b", "main")
    sh(one, "add", "-A")
    sh(one, "commit", "-qm", "x")
    sh(one, "worktree", "add", "-q", str(two), "-b", "side")
    engine = Engine(spark, f"file://{tmp_path}/store")
    fid = engine.register_family(str(two), "f")["family_id"]  # by a linked worktree; the primary one is the base
    return engine, fid, one, two


def found(engine, query, cwd):
    return sorted(os.path.basename(r["file_path"]) for r in engine.search_fulltext(query, str(cwd))["results"])


def folders(engine, table):
    top = engine.store.root.removeprefix("file://") + f"/{table}"
    return {os.path.relpath(os.path.join(d, f), top) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def callers(engine, name, cwd):
    return sorted(s["name"] for s in engine.search_structural(name, "callers", str(cwd))["symbols"])


def full_edges(views):
    """All edges of a view, resolved anew."""
    own = views.shared("analyses").join(views.files().select("version"), "version", "left_semi")
    return sorted(map(tuple, graph.resolve(linked.candidates_of(own), linked.nodes_of(own)).collect()))


def test_two_worktrees(family):
    engine, fid, one, two = family
    assert engine.register_family(str(one), "again") == {"family_id": fid, "created": False}
    out = engine.reindex_family(fid)
    assert out["indexed"] and out["files"] == 3 and out["linked"] == [{"root": str(two), "files": 3, "new_files": 0}]
    assert engine.parsed.value == 3  # the linked checkout has the base's versions

    # A change in one worktree is seen there alone.
    (two / "src" / "a.py").write_text("def alpha():\n    return gamma()\n\ndef gamma():\n    return 2\n")
    (two / "deleted.txt").unlink()
    base_before, own = folders(engine, "base"), {r["root"]: r["checkout_id"] for r in engine.inspect_status()["checkouts"]}
    deltas = folders(engine, "deltas")
    engine.reindex_family(fid, [str(two / "src" / "a.py"), str(two / "deleted.txt")])
    assert engine.parsed.value == 4
    assert folders(engine, "base") == base_before
    assert {x.split("/")[0] for x in folders(engine, "deltas") - deltas} == {f"checkout_id={own[str(two)]}"}
    assert found(engine, "gamma", two / "src") == ["a.py"] * 2 and found(engine, "gamma", one) == []
    assert found(engine, "gone soon", one) == ["deleted.txt"] and found(engine, "gone soon", two) == []
    assert callers(engine, "beta", one) == ["alpha"] and callers(engine, "beta", two) == [] and callers(engine, "gamma", two / "src") == ["alpha"]
    assert callers(engine, "alpha", two) == callers(engine, "alpha", one / "src") == ["user"]
    shown = engine.search_semantic("gamma alpha", str(two))["results"]
    assert shown and all(r["file_path"].startswith(str(two)) for r in shown)

    # The base moves: the other checkout sees what it saw before.
    (one / "b.py").write_text("def user():\n    return delta() + alpha()\n\ndef delta():\n    pass\n")
    (one / "new.py").write_text("def fresh():\n    return user()\n")
    engine.reindex_family(fid, [str(one / "b.py"), str(one / "new.py")])
    assert engine.parsed.value == 6
    assert found(engine, "delta", one) == ["b.py"] * 2 and found(engine, "delta", two) == [] and found(engine, "fresh", two) == []
    assert callers(engine, "delta", one) == ["user"] and callers(engine, "user", one) == ["fresh"] and callers(engine, "alpha", two) == ["user"]
    for cwd in (one, two):
        _, views = engine._view(str(cwd))
        assert sorted(map(tuple, views.edges().collect())) == full_edges(views)

    # Nothing changed: nothing is parsed or published.
    numbers = {r["root"]: r["generation"] for r in map(lambda x: x.asDict(), engine.catalog.snapshot().table("checkouts").collect())}
    assert engine.reindex_family(fid)["indexed"] and engine.parsed.value == 6
    assert {r["root"]: r["generation"] for r in engine.catalog.snapshot().table("checkouts").collect()} == numbers

    # What nobody sees goes when it is much.
    (two / "src" / "a.py").write_text("def alpha():\n    return 3\n")
    engine.reindex_family(fid)
    assert engine.collect_garbage(fid, share=0.9) is None and engine.collect_garbage(fid, share=0.01) == 1
    assert found(engine, "gone soon", one) == ["deleted.txt"] and found(engine, "gamma", two) == []
    seen = engine.store.shared("versions", fid, 1)
    assert seen.count() == seen.select("id").distinct().count() == 6 and engine.store.shared("versions", fid, 0).count() == 0


def test_worktrees_come_and_go(family, tmp_path):
    engine, fid, one, two = family
    assert found(engine, "alpha", two) == ["a.py", "b.py"]  # indexed by the search, with the base it needs
    three = tmp_path / "three"
    sh(one, "worktree", "add", "-q", str(three), "-b", "late")
    (three / "only.py").write_text("def only_here():\n    pass\n")
    assert found(engine, "only_here", three) == ["only.py"] and found(engine, "only_here", one) == []
    moved = tmp_path / "moved"
    sh(one, "worktree", "move", str(three), str(moved))
    engine.reindex_family(fid)
    assert [r["file_path"] for r in engine.search_fulltext("only_here", str(moved))["results"]] == [f"{moved}/only.py"]
    sh(one, "worktree", "remove", "--force", str(moved))
    engine.reindex_family(fid)
    state = {r["root"]: r["state"] for r in engine.inspect_status()["checkouts"]}
    assert state[str(moved)] == "active"  # for a while
    late = F.when(F.col("root") == str(moved), F.lit("2020-01-01").cast("timestamp")).otherwise(F.col("missing_since"))
    snap = engine.catalog.snapshot()
    engine.catalog.commit(snap, {"checkouts": snap.table("checkouts").withColumn("missing_since", late)})
    engine.reindex_family(fid)
    assert {r["root"]: r["state"] for r in engine.inspect_status()["checkouts"]}[str(moved)] == "retired"
    with pytest.raises(KeyError):
        engine.search_fulltext("alpha", str(tmp_path / "elsewhere"))


def test_a_tree_that_moves_or_merges_keeps_its_last_index(family, monkeypatch):
    engine, fid, one, _ = family
    engine.reindex_family(fid)
    (one / "b.py").write_text("def user():\n    return later()\n")
    publish = linked._same

    def meanwhile(*args):
        (one / "b.py").write_text("def user():\n    return even_later()\n")
        publish(*args)

    monkeypatch.setattr(linked, "_same", meanwhile)
    assert engine.reindex_family(fid, [str(one / "b.py")]) == {"indexed": False, "reason": "changed while it was indexed", "skipped": [{"root": str(one), "reason": "changed while it was indexed"}]}
    assert found(engine, "later", one) == [] and callers(engine, "alpha", one) == ["user"]
    monkeypatch.setattr(linked, "_same", publish)
    (one / ".git" / "MERGE_HEAD").write_text("x")
    assert "blocked: merge" in engine.reindex_family(fid)["reason"]
    (one / ".git" / "MERGE_HEAD").unlink()
    engine.reindex_family(fid)
    assert found(engine, "even_later", one) == ["b.py"]


def test_vendored_chunks_get_their_vectors_later(family):
    engine, fid, one, two = family
    (one / "node_modules" / "p").mkdir(parents=True)
    (one / "node_modules" / "p" / "i.js").write_text("function vendored() { return 1; }\n")
    out = engine.reindex_family(fid)
    assert out["files"] == 4 and engine.inspect_status()["coverage"]["pending"] == 1
    assert engine.start_family(fid)["embedded"] == 1
    status = engine.inspect_status()["coverage"]
    assert status["pending"] == 0 and status["complete"]
    assert [os.path.basename(r["file_path"]) for r in engine.search_semantic("function vendored", str(one))["results"]][0] == "i.js"
    assert all(not r["file_path"].endswith(".js") for r in engine.search_semantic("function vendored", str(two))["results"])
