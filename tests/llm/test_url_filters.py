"""URL rules and the spread of trust over links, against plain Python."""

import random

import duckdb

from loamwork.llm import queries, url_filters
from loamwork.llm.common import Workspace
from loamwork.llm.queries import OP12_RULES

SCHEMA = "page_id long, url string, html string, host string, rule string, trust string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], SCHEMA).repartition(3)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return lowered(rest[:end]), path[:cut]


def brute_rule(url, rules=OP12_RULES):
    host, path = parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def brute_spread(links, seeds, steps):
    unit = url_filters.UNITS // max(1, sum(a + b for a, b in seeds.values()))
    out = {}
    for kind in (0, 1):
        edges = {(a, b) if kind == 0 else (b, a) for a, b in links}
        degree = {}
        for a, _ in edges:
            degree[a] = degree.get(a, 0) + 1
        start = {h: s[kind] * unit for h, s in seeds.items() if s[kind]}
        mass = dict(start)
        for _ in range(steps):
            after = dict(start)
            for a, b in edges:
                if a in mass:
                    after[b] = after.get(b, 0) + mass[a] // 100 * 85 // degree[a]
            mass = after
        for h, m in mass.items():
            out.setdefault(h, [0, 0])[kind] = m
    return {h: tuple(m) for h, m in out.items() if any(m)}


URLS = [
    None, "", "no host", "http:/one", "http://", "HTTP://WWW.Example.ORG", "http://a.org", "http://a.org/", "http://org/x", "http://x.example.org/es/1", "http://example.org/es", "http://example.org/en/1", "http://EXAMPLE.org/en/12?q",
    "http://badexample.org/es/", "http://a.com/fr/x", "http://a.com/FR/x", "http://a.com/de/#x", "http://a.com/de", "http://a.com?/de/", "http://a.net/x://y/de/", "x://a.com://b.org/", "http://a.com:80/fr/", "http://é.org/é", "http://a.com/fr/\n/de/",
]


def test_rules_and_parts(spark):
    got = url_filters.judge(spark, frame(spark, [(i, u, None) for i, u in enumerate(URLS)]), OP12_RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        url = URLS[r["page_id"]]
        assert (r["host"], r["path"]) == parts(url), url
        name, verdict = brute_rule(url)
        assert r["rule"] == name, url
        assert verdict is None or r["verdict"] == verdict


def web(seed, hosts=14, pages=90):
    rng = random.Random(seed)
    names = [f"h{k}.{rng.choice(['com', 'net', 'org', 'example.org'])}" for k in range(hosts)]
    rows = []
    for i in range(pages):
        links = "".join(rng.choice(['<a href="http://{0}/x">', "<A HREF='//{0}'>", "<img src=https://{0}?y >", '<a href="/{0}">', "<a href = \"HTTPS://{1}/z\">"]).format(h := rng.choice(names), h.upper()) for _ in range(rng.randrange(4)))
        rows.append((i, f"http://{names[0] if i % 3 == 0 else rng.choice(names)}/{rng.choice(['fr', 'de', 'en', 'es', 'en/1'])}/{i}", links or None))
    return rows


def test_spread_equals_brute_force_and_sql(spark):
    import re

    for seed in (1, 2):
        rows = web(seed) + [(None, "http://h0.net/", "<a href=//x.com>"), (5, None, None), (5, None, None)]
        got = url_filters.judge(spark, frame(spark, rows), OP12_RULES).collect()
        links, seeds = set(), {}
        for _, u, html in rows:
            host = parts(u)[0]
            for target in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^"'\s>/?#]+)""", html or ""):
                if host and lowered(target) != host:
                    links.add((host, lowered(target)))
            if (verdict := brute_rule(u)[1]) is not None:
                seeds.setdefault(host, [0, 0])[verdict == "block"] += 1
        want = brute_spread(links, seeds, url_filters.STEPS)
        assert links and any(a and b for a, b in want.values())
        for r in got:
            trust, distrust = want.get(r["host"], (0, 0))
            assert (r["trust"], r["distrust"]) == (trust, distrust)
            assert r["verdict"] == (brute_rule_of(r) or ("block" if distrust > trust else "allow"))
        con = duckdb.connect()
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
        sql = con.execute(queries.OP12_SQL).fetchall()
        key = lambda rows: sorted(map(repr, rows))
        assert key((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["trust"], r["distrust"]) for r in got) == key(sql)


def brute_rule_of(row):
    return next((r.verdict for r in OP12_RULES if r.name == row["rule"]), None)


def test_spread_stops_and_keeps_order(spark):
    """Trust goes along links and distrust against them; what is nearer gathers more."""
    edges = spark.createDataFrame([("good", "a"), ("a", "b"), ("c", "bad"), ("d", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("good", 2, 0), ("bad", 0, 1)], "host string, trusted long, blocked long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filters.spread(edges, seeds, Workspace(spark, "t")).collect()}
    assert got["good"][0] > got["a"][0] > got["b"][0] > 0 and got["bad"][1] > got["c"][1] > got["d"][1] > 0
    assert got["b"][1] == 0 and got["d"][0] == 0


def test_empty_tables(spark):
    assert url_filters.judge(spark, frame(spark, []), OP12_RULES).collect() == []
    assert [r["verdict"] for r in url_filters.judge(spark, frame(spark, [(1, "http://a.com/fr/", "x")]), []).collect()] == ["allow"]
