"""The engine's tables built from the driver's tables, so its operators can run on them.

Each has the same expression in SQL (module oracle).  Nothing is sampled: every table covers its whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINKED = 5  # linked checkouts k = 0 .. LINKED - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _path(doc_id: str = "doc_id"):
    return F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc_"), F.col(doc_id).cast("string"), F.lit(".txt"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_path, start_line, end_line, content, tier, embedding_state, content_hash of documents."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality")
    tier = F.when(F.col("quality") == 0, 2).otherwise(1)
    state = F.when((tier == 2) & (F.col("doc_id") % 2 == 0), "pending").when(F.col("doc_id") % 97 == 0, "absent").otherwise("embedded")
    rows = read(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("l"), "left")
    lines = F.size(F.split("text", "\n"))
    return rows.select(F.col("doc_id").alias("id"), _path().alias("file_path"), F.lit(1).alias("start_line"), lines.alias("end_line"), F.col("text").alias("content"), tier.cast("short").alias("tier"), state.alias("embedding_state"), F.sha2("text", 256).alias("content_hash"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, at: int = 0) -> list[float]:
    return [float(x) for x in vectors(spark, sf_dir).where(F.col("id") == at).first()["embedding"]]


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, embedding; either may be absent."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(vectors(spark, sf_dir), "id", "full")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes from conversations: the id is conv_id * 1000 + turn, which also stands for the time of the update."""
    c = read(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(number.alias("id"), F.col("role").alias("repo_path"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), number.alias("updated_at")).join(vectors(spark, sf_dir), "id", "left")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("repo_path"), F.col("value").cast("long").alias("duration_ms"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, version: documents but for those of the last digit 9."""
    return read(spark, sf_dir, "documents").where("doc_id % 10 <> 9").select(_path().alias("path"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("version"))


def new_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later base: other versions of every seventh path, without every eleventh."""
    number = F.col("doc_id").cast("string")
    rows = read(spark, sf_dir, "documents").where("doc_id % 10 <> 9 AND doc_id % 11 <> 0")
    return rows.select(_path().alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("m"), number)).otherwise(F.concat(F.lit("b"), number)).alias("version"))


def checkouts(spark: SparkSession) -> DataFrame:
    return spark.range(LINKED).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("checkout_id"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """checkout_id, path, version: each checkout k overrides the last digit k, deletes and adds some."""
    rows = read(spark, sf_dir, "documents").crossJoin(F.broadcast(spark.range(LINKED).select(F.col("id").alias("k"))))
    number, k = F.col("doc_id").cast("string"), F.col("k").cast("string")
    added = (F.col("doc_id") % 10 == 9) & (F.col("doc_id") % LINKED == F.col("k"))
    version = F.when(F.col("doc_id") % 10 == F.col("k"), F.concat(F.lit("c"), k, F.lit("_"), number)).when(added, F.concat(F.lit("n"), k, F.lit("_"), number))
    path = F.when(added, F.concat(F.lit("new/"), _path())).otherwise(_path())
    kept = rows.where((F.col("doc_id") % 10 == F.col("k")) | added | (F.col("doc_id") % 17 == F.col("k")) & (F.col("doc_id") % 10 != 9))
    return kept.select(F.concat(F.lit("k"), k).alias("checkout_id"), path.alias("path"), version.alias("version"))


def versioned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_version, content, embedding of all versions of checkout k1 and the base."""
    d = searchable(spark, sf_dir).where("content IS NOT NULL")
    own = F.when(F.col("id") % 10 == 1, F.array(F.lit("b"), F.lit("c1_"))).when(F.col("id") % 10 == 9, F.array(F.lit("n4_"), F.lit("n1_"))).otherwise(F.array(F.lit("b")))
    return d.select("*", F.explode(own).alias("prefix")).select(F.concat("prefix", F.col("id").cast("string")).alias("id"), F.concat("prefix", F.col("id").cast("string")).alias("file_version"), "content", "embedding")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions in files named by brand; suppliers as classes in files named by nation; nations and regions as modules."""
    part, supplier, nation, region = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region"))
    node = lambda p, key, name, kind, path, line: (F.concat(F.lit(p), F.col(key).cast("string")).alias("chunk_id"), F.col(name).alias("name"), F.lit(kind).alias("kind"), path.cast("string").alias("file_path"), line.cast("int").alias("start_line"), (line + 5).cast("int").alias("end_line"))
    a = part.select(*node("p", "p_partkey", "p_name", "function", F.col("p_brand"), F.col("p_size")))
    b = supplier.select(*node("s", "s_suppkey", "s_name", "class", F.col("s_nationkey"), F.col("s_suppkey") % 50))
    c = nation.select(*node("n", "n_nationkey", "n_name", "module", F.col("n_regionkey"), F.col("n_nationkey")))
    d = region.select(*node("r", "r_regionkey", "r_name", "module", F.lit("world"), F.col("r_regionkey")))
    return a.unionByName(b).unionByName(c).unionByName(d)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls: distinct (part, supplier) of lineitem; defines: nation of a supplier; inherits_from: region of a nation; imports: nation of a supplier."""
    link = lambda df, p, a, q, b, r: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"), F.lit(r).alias("relation"))
    calls = link(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), "p", "l_partkey", "s", "l_suppkey", "calls")
    return calls.unionByName(link(read(spark, sf_dir, "supplier"), "n", "s_nationkey", "s", "s_suppkey", "defines")).unionByName(link(read(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey", "inherits_from")).unionByName(link(read(spark, sf_dir, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "imports"))


def some_name(spark: SparkSession, sf_dir: str, table: str, column: str) -> str:
    return read(spark, sf_dir, table).agg(F.min(column).alias("x")).first()["x"]


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with line ranges per file: lines of an order, of which every third is a class."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    start = F.col("l_linenumber").cast("int")
    return rows.select(F.col("l_orderkey").alias("file_path"), start.alias("ord"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("name"), F.when(start % 3 == 1, "class").otherwise("function").alias("kind"), start.alias("start_line"), (start + (F.col("l_quantity") % 5).cast("int")).alias("end_line"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size of a source tree with vendored, generated and dropped parts."""
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id") % 12
    head = F.when(n == 0, "node_modules/pkg/").when(n == 1, "web/dist/").when(n == 2, ".git/objects/").when(n == 3, "vendor/lib/").otherwise("src/")
    name = F.when(n == 4, ".min.js").when(n == 5, ".rs").when(n == 6, ".py").when(n == 7, ".tsx").when(n == 8, ".snap").when(n == 9, ".PY").otherwise(".txt")
    return d.select(F.concat(head, F.col("lang"), F.lit("/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), name).alias("path"), F.col("n_chars").alias("size"))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("family_id"), F.when(k % 23 == 0, "retired").when(k % 19 == 0, "pending").otherwise("present").alias("missing"), (k % 7 == 0).alias("paused"), (k % 11 != 0).alias("enabled"),
        F.lit(64).alias("stored_dim"), F.when(k % 13 == 0, 128).otherwise(64).alias("configured_dim"), (k % 3 == 0).alias("indexed"), (k % 2 == 0).alias("ever_indexed"), (k % 5 == 0).alias("has_policy"),
        (k % 17 == 0).alias("preempt_requested"), (k % 29 == 0).alias("in_flight"), (k % 31 == 0).alias("locked"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family_id, path, kind, ts, is_dir of file events."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "create").when(F.col("event_id") % 4 == 1, "modify").when(F.col("event_id") % 4 == 2, "remove").otherwise("access")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 50 == 7, "").otherwise(F.concat(F.lit("/f"), (F.col("event_id") % 50).cast("string"))))
    return e.select((F.col("user_id") % 20).alias("family_id"), path.alias("path"), kind.alias("kind"), "ts", F.lit(False).alias("is_dir"), "event_id")
