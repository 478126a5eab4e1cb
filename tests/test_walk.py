"""The walk of a tree: what is entered, what is counted, and what is read."""

import os

import pytest

from loamwork.sources import files


def tree(root, paths):
    for p, text in paths.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(text)
    return str(root)


@pytest.fixture
def root(tmp_path):
    top = tree(tmp_path / "t", {"src/main.rs": b"fn main() {}", "src/deep/er/x.py": b"x", "ignored.odd": b"0123456789", "ignored.lock": b"y", "node_modules/pkg/a.js": b"abcdef", "excluded/deep/file": b"zzzzz", ".git/config": b"g", "sub/.git/config": b"g", "bin.dat": b"a\0b", "latin.txt": b"\xff\xfe", "empty.txt": b""})
    os.symlink("/etc", tmp_path / "t" / "link")
    os.mkfifo(tmp_path / "t" / "pipe")
    return top


def test_excluded_directories_are_never_listed(spark, root):
    seen = files.walk(spark, root, ["excluded/", "*.lock"], ["node_modules/"])
    paths = {r["path"]: (r["kind"], r["decision"]) for r in seen.entries.collect()}
    assert not any(p.startswith(("excluded/", ".git/", "sub/.git/")) for p in paths)
    assert paths["excluded"] == ("directory", "drop") and paths["node_modules/pkg/a.js"] == ("file", "tier2") and paths["src/deep/er/x.py"] == ("file", "tier1")
    assert seen.listed == 7 and seen.complete and seen.visited == len(paths)  # the root, src, deep, er, node_modules, pkg, sub
    assert seen.counters() == {"observed_excluded_files": 1, "pruned_directories": 3, "skipped_symlinks": 1, "skipped_special_entries": 1, "unreadable_entries": 0}


def test_a_walk_says_where_it_stopped(spark, root):
    seen = files.walk(spark, root, most=3)
    assert not seen.complete and seen.stop_reason == "entry_limit" and seen.listed == 1
    assert files.walk(spark, root, budget_s=0).stop_reason == "time_limit"
    gone = files.walk(spark, root + "/nothing")
    assert gone.complete and gone.visited == 0 and gone.files().collect() == []


@pytest.mark.skipif(os.geteuid() == 0, reason="root reads everything")
def test_unreadable_directories_are_counted(spark, root):
    os.chmod(f"{root}/src", 0)
    try:
        assert files.walk(spark, root).counters()["unreadable_entries"] == 1
    finally:
        os.chmod(f"{root}/src", 0o755)


def test_scans_read_what_they_keep(spark, root):
    found = {r["path"]: (r["source"], r["tier"], r["size"]) for r in files.scan(spark, root, ["excluded/", "*.lock"], ["node_modules/"]).collect()}
    assert found == {"src/main.rs": ("fn main() {}", 1, 12), "src/deep/er/x.py": ("x", 1, 1), "ignored.odd": ("0123456789", 1, 10), "node_modules/pkg/a.js": ("abcdef", 2, 6), "empty.txt": ("", 1, 0)}
    some = files.scan_paths(spark, root, ["src/main.rs", "gone", "src", "excluded/deep/file", "node_modules/pkg/a.js", "link/passwd", "bin.dat"], ["excluded/"], ["node_modules/"])
    assert sorted(r["path"] for r in some.where("path <> 'link/passwd'").collect()) == ["node_modules/pkg/a.js", "src/main.rs"]
    assert files.scan_paths(spark, root, []).collect() == []
