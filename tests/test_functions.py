import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.functions import chunk, glob, parse, stem
from loamwork.functions.embed import HashingBackend
from loamwork.operators import policy
from loamwork.sources import config, git
from loamwork.streaming import changes


def verdict(exclude, vendor, path):
    member = lambda rules: any(glob.member(p, d, rules) for p, d in [(path, False), *((a, True) for a in above)])
    above = ["/".join(path.split("/")[:n]) for n in range(1, len(path.split("/")))]
    if ".git" in path.split("/") or member(glob.compile_rules(exclude)):
        return "drop"
    return "tier2" if member(glob.compile_rules(vendor)) else "tier1"


@pytest.mark.parametrize(
    ("exclude", "vendor", "path", "want"),
    [
        (["**/x/**"], ["**/x/**"], "x/a.js", "drop"), ([], ["**/node_modules/**"], "node_modules/p/i.js", "tier2"), ([], ["**/node_modules/**"], "src/main.rs", "tier1"),
        ([], ["**/target/**", "!**/target/**"], "target/x.rs", "tier1"), ([], [], "src/lib.rs", "tier1"), (["target/"], [], "target/debug/build/x.rs", "drop"),
        (["target/"], [], "a/target/foo", "drop"), (["/target/"], [], "a/target/foo", "tier1"), (["**/*.min.js"], [], "web/static/app.min.js", "drop"), (["**/*.min.js"], [], "web/static/app.js", "tier1"),
        (["target/", "dist/", "**/*.lock"], [], "a/b/Cargo.lock", "drop"), ([], [], ".git/config", "drop"), (["target/"], [], "target", "tier1"), (["a?c.[xy]"], [], "d/abc.y", "drop"),
        (["a?c.[!xy]"], [], "d/abc.y", "tier1"), (["#x"], [], "#x", "drop"), (["a/*"], [], "a/b/c", "drop"), (["a/**/z"], [], "a/z", "drop"), (["a/**/z"], [], "a/b/c/z", "drop"),
    ],
)
def test_classify(exclude, vendor, path, want):
    assert verdict(exclude, vendor, path) == want


@pytest.mark.parametrize("bad", ["", "  ", "!", "a\0b", "[ab"])
def test_strict_rules_reject(bad):
    with pytest.raises(ValueError):
        glob.compile_rules([bad])
    assert glob.compile_rules([bad], strict=False) == []


def pieces(source, symbols=()):
    return chunk.chunks(source, symbols)


def test_chunks_of_symbols_and_gaps():
    source = "use a;\n\nfn f() {\n}\n// tail\n"
    got = pieces(source, [(3, 4), (3, 4)])
    assert [(c.start, c.end, c.content) for c in got] == [(3, 4, "fn f() {\n}"), (1, 2, "use a;\n\n"), (5, 5, "// tail\n")]


def test_chunk_sizes_are_bytes_and_strict():
    line = "x" * 1499
    assert [c.content for c in pieces(line)] == [line + "\n"]
    line = "x" * 1500
    assert [c.content for c in pieces(line)] == [line]
    euro = "€" * 2000
    got = pieces(euro)
    assert "".join(c.content for c in got) == euro and max(len(c.content.encode()) for c in got) <= 1500


@pytest.mark.parametrize("odd", ["a" * 50_000, "b\r\n" * 10, "a\0b\n", "\n\n \n", "", "é\n" * 3000, "x" * 3_145_725])
def test_chunks_of_odd_texts(odd):
    got = pieces(odd)
    assert all(c.content.strip() and 1 <= c.start <= c.end and len(c.content.encode()) <= 1501 for c in got)
    assert got == pieces(odd)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \té", max_size=60), max_size=60), st.integers(8, 80))
def test_chunks_cover(lines, limit):
    source = "\n".join(lines)
    got = chunk.chunks(source, (), limit)
    covered = {n for c in got for n in range(c.start, c.end + 1)}
    want = {n for n, x in enumerate(chunk.lines_of(source), 1) if x.strip()}
    assert want <= covered
    assert all(c.content.strip() for c in got)


def test_parse_python():
    p = parse.parse("import os\n\n# doc\n@deco\ndef f(x):\n    return g(x) + x.h(g(1)) + f(2)\n\nclass C(B):\n    def g(self):\n        pass\n", "python")
    assert [(s.name, s.kind, s.start, s.end) for s in p.symbols] == [("os", "import", 1, 1), ("f", "function", 3, 6), ("C", "class", 8, 10), ("g", "function", 9, 10)]
    assert sorted(c for i, c in p.calls if p.symbols[i].name == "f") == ["g", "h"]
    assert parse.defines(p.symbols) == [(2, 3)]
    assert parse.parse("def (", "python").symbols == []


def test_parse_python_with_errors():
    p = parse.parse("import os\n\n@deco\ndef f():\n    return g()\n\ndef broken(:\n    pass\n\nclass C:\n    def m(self):\n        f()\n", "python")
    assert [(s.name, s.kind, s.start, s.end) for s in p.symbols] == [("os", "import", 1, 1), ("f", "function", 3, 5), ("C", "class", 10, 12), ("m", "function", 11, 12)]
    assert p.calls == [(1, "g"), (3, "f")]


def test_parse_imports_over_lines():
    p = parse.parse("import {\n  a,\n  b,\n} from './m';\nimport x from \"y\";\nfunction go() { return import('z'); }\n", "typescript")
    assert [(s.name, s.kind, s.start, s.end) for s in p.symbols] == [("./m", "import", 1, 4), ("y", "import", 5, 5), ("go", "function", 6, 6)]
    assert parse.parse("import {\n  a,\n", "javascript").symbols == []


def test_parse_rust():
    source = 'use std::io;\n\n/// doc\n#[inline]\npub fn alpha(x: u8) -> u8 {\n    // beta(1)\n    let s = "gamma(";\n    self.beta(x) + alpha(1)\n}\nstruct S { a: u8 }\nimpl S {\n    fn beta(&self) { }\n}\nmod tests;\n'
    p = parse.parse(source, "rust")
    assert [(s.name, s.kind, s.start, s.end) for s in p.symbols] == [("std::io", "import", 1, 1), ("alpha", "function", 3, 9), ("S", "class", 10, 10), ("S", "class", 11, 13), ("beta", "function", 12, 12), ("tests", "module", 14, 14)] or p.symbols[3].name == "<anonymous>"
    assert [c for i, c in p.calls if p.symbols[i].name == "alpha"] == ["beta"]


def test_parse_typescript():
    p = parse.parse("import { a } from './m';\nexport async function go(x) {\n  return helper(x);\n}\nexport class K {\n  m() { go(1); }\n}\n", "typescript")
    assert [(s.name, s.kind, s.start, s.end) for s in p.symbols] == [("./m", "import", 1, 1), ("go", "function", 2, 4), ("K", "class", 5, 7)]
    assert p.calls == [(1, "helper")]


def test_hashing_backend():
    b = HashingBackend(16)
    (v,), empty = b.embed(["a b a"]), b.embed([""])
    assert math.isclose(sum(x * x for x in v), 1, rel_tol=1e-5) and empty == [[]] and b.embed(["a b a"]) == [v]


def test_policy_rules():
    p = policy.shipped("x")
    assert policy.validate(p) == p
    for change in ({"name": " "}, {"watcher": {"debounce_ms": -1}}, {"watcher": {"debounce_ms": 2**53}}, {"embeddings": {"backend": "local", "model": "m", "batch_size": 1}}, {"embeddings": p["embeddings"] | {"batch_size": 0}}, {"index": {"exclude": ["[a"], "vendor": []}}, {"extra": 1}):
        with pytest.raises(policy.PolicyError):
            policy.validate(p | change)
    assert policy.impact(p, p | {"name": "y"}) == "display"
    assert policy.impact(p, p | {"watcher": {"debounce_ms": 1}}) == "runtime"
    assert policy.impact(p, p | {"index": {"exclude": ["a"], "vendor": []}, "watcher": {"debounce_ms": 1}}) == "selection"
    assert policy.impact(p, p | {"embeddings": {"backend": "local", "model": None, "batch_size": 64}}) == "embedding_profile"
    assert policy.effective(p)["index"]["exclude"][0] == ".git/"


def test_config():
    c = config.parse('[index]\nexclude = ["a/"]\n[watcher]\ndebounce_ms = 5\n')
    assert c.exclude == ["a/"] and c.debounce_ms == 5 and c.effective_rules()[0][-1] == "a/"
    for bad in ("[odd]\na = 1\n", "[index]\nodd = []\n", "[watcher]\ndebounce_ms = 'x'\n", "[embeddings]\nbatch_size = 0\n"):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_git(tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    assert git.discover(str(tmp_path)) is None
    run("init", "-q")
    co = git.discover(str(tmp_path))
    assert co is not None and git.stamp(co) == ""
    (tmp_path / "a").write_text("x")
    run("add", "."), run("commit", "-qm", "x")
    assert len(git.stamp(co)) == 40 and [w.root for w in git.worktrees(str(tmp_path))] == [co.root]
    (tmp_path / ".git/MERGE_HEAD").write_text("x")
    with pytest.raises(RuntimeError):
        git.stamp(co)
    assert [w.branch for w in git.parse_worktrees("worktree /a b\0HEAD 1\0branch refs/heads/m\0\0worktree /c\0HEAD 2\0detached\0prunable gone\0\0")] == ["refs/heads/m", None]


def symbols(source, language):
    p = parse.parse(source, language)
    return [(x.name, x.kind, x.start, x.end) for x in p.symbols], [(p.symbols[i].name, c) for i, c in p.calls]


def test_declarations_on_one_line():
    assert symbols("function a(){ b(); } function c(){ d(); }", "javascript") == ([("a", "function", 1, 1), ("c", "function", 1, 1)], [("a", "b"), ("c", "d")])
    assert symbols("mod m { fn inner() { g(); } }", "rust") == ([("m", "module", 1, 1), ("inner", "function", 1, 1)], [("inner", "g")])
    assert symbols("struct A; impl A { fn x(&self) { y(); } }", "rust") == ([("A", "class", 1, 1), ("<anonymous>", "class", 1, 1), ("x", "function", 1, 1)], [("x", "y")])


def test_rust_tokens():
    source = r"""use std::{fmt, io as x};
/* /* nested */ fn no() {} */
/// doc
#[attr(call())]
pub(crate) async unsafe fn t<'a>(x: &'a str) -> impl Fn(u8) where T: Fn(u8) {
    println!("{}", hidden());
    let s = r#"fn no() { "#; let c = '{'; let d = b'\''; "\"{";
    a.b().c(); Foo::new(p::q::<T>(1));
    fn within() { deep(); }
}
trait T { fn signature(&self); fn body() { k(); } }
macro_rules! m { ($x:expr) => { fn not() { no() } } }
mod other;
pub struct P(u8, Q);
unsafe impl<T> Send for P<T> where T: Copy {}
fn open() { if x { z();
"""
    found, calls = symbols(source, "rust")
    assert found == [("std::{fmt, io as x}", "import", 1, 1), ("t", "function", 2, 10), ("within", "function", 9, 9), ("body", "function", 11, 11), ("other", "module", 13, 13), ("P", "class", 14, 14), ("<anonymous>", "class", 15, 15), ("open", "function", 16, 16)]
    assert [c for f, c in calls if f == "t"] == ["b", "c", "new", "q", "deep"] and [c for f, c in calls if f != "t"] == ["deep", "k", "z"]


def test_script_tokens():
    source = """import a, {b} from "x";
import 'side'
export default class Foo extends mix({}) { m() { n(); } static async k(a) { return `t ${ l(`${q()}`) } }`; } x = y(); }
const f = function g() { z(); };
export async function h(a = dflt()) { if (a) { i?.j(); } new K(); return /fn(}/.test(s) / 2; }
export function over(a: string): void;
export function typed(a: {b: number}): {c: string} { u<T>(1); v(); }
foo(function inner() { s(); })
function* gen() { t("don't }"); }
// function no() {
function last() { w()
"""
    found, calls = symbols(source, "typescript")
    assert found == [("x", "import", 1, 1), ("side", "import", 2, 2), ("Foo", "class", 3, 3), ("h", "function", 5, 5), ("typed", "function", 7, 7), ("gen", "function", 9, 9), ("last", "function", 10, 11)]
    assert calls == [("h", "dflt"), ("h", "j"), ("h", "test"), ("typed", "u"), ("typed", "v"), ("gen", "t"), ("last", "w")]


def test_a_class_keeps_its_good_methods():
    source = "import os\nclass A:\n    @deco\n    def good(self):\n        return f(1)\n    def bad(self:\n        x = \n    def also(self):\n        return g()\n\ndef top():\n    h()\n"
    assert symbols(source, "python") == ([("os", "import", 1, 1), ("A", "class", 2, 9), ("good", "function", 3, 5), ("also", "function", 8, 9), ("top", "function", 11, 12)], [("good", "f"), ("also", "g"), ("top", "h")])


def test_debounce_is_anchored_at_the_first_event():
    assert changes.batches([0, 299, 300, 400, 599, 600, 2000]) == [0, 0, 1, 1, 1, 2, 3]
    assert changes.batches([]) == []


def test_audit_schedule():
    a = changes.AuditSchedule(0)
    assert a.select(["x"], 299) == ["x"] and a.select(["x"], 300) is None
    a.completed(True, False, 300)
    assert a.select(["x"], 301) is None
    a.completed(True, True, 301)
    assert a.select(["x"], 302) == ["x"]


def test_state_machine():
    s = "watching"
    for e in ("change", "change", "reindex", "failure", "reindex", "success", "settle"):
        s = changes.step(s, e)
    assert s == "watching"
    with pytest.raises(ValueError):
        changes.step("watching", "success")


def test_suppressor():
    c = changes.Suppressor(2)
    assert c.observe(1) == (True, None) and c.observe(1) == (False, None) and c.observe(2) == (True, None) and c.observe(3) == (True, (1, 1))
    assert c.observe(2)[0] is False and c.drain() == [(2, 1)] and c.drain() == []


# Words and their stems, as published with the algorithm.
STEMS = """consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori console consol consolidating consolid
consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir conspiring conspir constancy constanc knackeries knackeri knavish knavish kneeled kneel
knightly knight knitted knit knives knive knobs knob knopp knopp running run flies fli ties tie gas gas this this kiwis kiwi hoping hope hopping hop cry cri by by say say happy happi generate generat
generously generous communication communic skies sky dying die agreed agre relational relat conditional condit rationalize ration electricity electr hopefulness hope replacement replac adoption adopt
controlling control rolled roll nationally nation inning inning proceed proceed early earli youth youth boyish boyish sayings say""".split()


def test_stems(spark):
    words = STEMS[::2]
    assert [stem.stem_word(w) for w in words] == STEMS[1::2]
    rng = random.Random(1)
    ends = [x for s in (stem._STEP1A, stem._STEP1B, stem._STEP2, stem._STEP3, stem._STEP4) for x, *_ in s] + ["y", "e", "ll", "'s", "'", "'s'"]
    made = ["".join(rng.choices("aeioubdgtnlsyw", k=rng.randrange(6))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ly"]) for _ in range(3000)]
    odd = ["", "a", "é", "naïve", "x1s", "'tis", "''", "yy", "sky", "proceeds", "herrings"]
    every = list(dict.fromkeys(words + made + odd))
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", stem.stem(F.col("w")).alias("s")).collect()}
    assert got == {w: stem.stem_word(w) for w in every}


def test_stemmed_search(spark, tmp_path):
    from loamwork.functions.text import STEMMED
    from loamwork.operators import search, text_index

    df = spark.createDataFrame([(1, "The runners were running and RAN"), (2, "he runs, she knits"), (3, "the knitting of this"), (4, None)], "id long, content string")
    ids = lambda q: [r["id"] for r in search.fulltext(df, q, 10, STEMMED).collect()]
    assert ids("run") == [1, 2] and ids("knitted runs") == [2] and ids("the of") == [] and ids("knit the") == [2, 3]
    index = text_index.build(df, str(tmp_path / "i"), STEMMED)
    for q in ("run", "knitted runs", "the of", "knit the"):
        assert index.search(q, 10).collect() == search.fulltext(df, q, 10, STEMMED).collect()
