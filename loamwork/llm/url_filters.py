"""URL filtering by rules, and by trust and distrust that spread over links between hosts where no rule fits.

Rules name a host, with its subdomains, and the start of a path.  Pages that rules allow are seeds of trust, those that
rules block seeds of distrust, one unit each at the page's host.  Trust follows links (personalised PageRank from the
trusted seeds); distrust goes against them, from a blocked host to those that link to it.  A host is blocked if it has
gathered more distrust than trust.

Masses are whole numbers: UNITS in all at the start, and every step rounds down.  So sums don't depend on the order of
rows, a task that runs again gives the same mass, masses only grow from step to step, and the result is the same in any
engine.  Links count once for each pair of hosts.  Each step is one join of edges with masses and one sum, written to the
shared folder; nothing of the graph comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Mass of all seeds together; with DAMPING, what any host can gather stays below 2^63.
UNITS = 10**18
#: Hundredths of a host's mass that it passes on.
DAMPING = 85
#: Steps at most: what is passed on after that is below 1 % of it.
STEPS = 30
#: The target of a link of a page, up to where its host ends.
_LINK = r"""(?is)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>/?#\\]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(text: str, verdict: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(host, slash + path, verdict)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty without "://"."""
    return lower_ascii(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """name and verdict of the longest rule that fits, null for none; of equally long ones the first by name."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """src, dst: pairs of different hosts of which a page of the first has an absolute link to the second, once each."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html).cast("string"), F.lit("")), F.lit(_LINK), F.lit(1)), lambda x: lower_ascii(F.regexp_extract(x, r"//(.*)$", 1))))
    each = pages.select(host_of(F.col(url)).alias("src"), F.explode(targets).alias("dst"))
    return each.where("src <> '' AND dst <> '' AND src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, ws: Workspace, steps: int = STEPS) -> DataFrame:
    """host, trust, distrust (longs) for links (src, dst: each pair once) and seeds (host, trusted, blocked: counts of pages).

    trust(h) = seed(h) + sum of 85 % of trust(g) / links out of g, over links g to h; distrust the same over reversed
    links.  Mass that reaches a host without links goes nowhere.  Hosts that nothing reaches have no row.
    """
    total = seeds.agg(F.coalesce(F.sum(F.col("trusted") + F.col("blocked")), F.lit(0)).alias("n")).first()["n"]
    unit = UNITS // max(1, total)
    kinds = F.array(F.struct(F.lit(1).alias("kind"), F.col("trusted").alias("count")), F.struct(F.lit(-1).alias("kind"), F.col("blocked").alias("count")))
    start = seeds.select("host", F.explode(kinds).alias("x")).select("host", "x.kind", (F.col("x.count") * F.lit(unit)).cast("long").alias("mass")).where("mass > 0")
    start = ws.save(start, "seeds")
    both = edges.select(F.lit(1).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")).union(edges.select(F.lit(-1), "dst", "src"))
    degrees = both.groupBy("kind", "host").agg(F.count("*").alias("degree"))
    both = ws.save(both.join(degrees, ["kind", "host"]), "edges")
    mass = start
    if not both.isEmpty():
        for step in range(1, steps + 1):
            passed = both.join(mass, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr(f"mass div 100 * {DAMPING} div degree").alias("mass"))
            every = passed.select("host", "kind", "mass", F.lit(0).cast("long").alias("old")).union(start.select("host", "kind", "mass", F.lit(0).cast("long"))).union(mass.select("host", "kind", F.lit(0).cast("long"), "mass"))
            after = ws.save(every.groupBy("host", "kind").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")), f"step-{step}")
            if step > 1:
                ws.drop(f"step-{step - 1}")
            mass = after.select("host", "kind", "mass").where("mass > 0")
            if after.where("mass <> old").isEmpty():
                break
    return mass.groupBy("host").agg(F.sum(F.expr("IF(kind = 1, mass, 0L)")).alias("trust"), F.sum(F.expr("IF(kind = -1, mass, 0L)")).alias("distrust"))


def judge(spark: SparkSession, pages: DataFrame, rules: Sequence[Rule], identity: str = "page_id", url: str = "url", html: str = "html", steps: int = STEPS) -> DataFrame:
    """identity, host, path, rule, verdict, trust, distrust of every page.

    verdict is the rule's; without one, block if the host has more distrust than trust, else allow.  Null urls and those
    without "://" have an empty host and path, which no rule and no mass reaches: allow.  Null html has no links.
    Repeated rows and null identities are judged each; no pages give no rows; other columns, of any name, aren't read.
    """
    ws = Workspace(spark, "url-filters")
    read = pages.select(F.col(identity).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    named = read.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = ws.save(named.withColumn("fit", fitting(rules, F.col("host"), F.col("path"))).select("id", "host", "path", F.col("fit.name").alias("rule"), F.col("fit.verdict").alias("ruled")), "judged")
    seeds = judged.where("rule IS NOT NULL").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("trusted"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    masses = ws.save(spread(host_links(read, "url", "html"), seeds, ws, steps), "masses")
    open_ = judged.join(masses, "host", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    method = F.when(zero("distrust") > zero("trust"), "block").otherwise("allow")
    return open_.select(F.col("id").alias(identity), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), zero("trust").alias("trust"), zero("distrust").alias("distrust"))
