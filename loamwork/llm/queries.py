"""The queries of this package, one per operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, ngram_join, packing, pii, quality, simhash, token_counts, token_files, toxicity, url_filters, warc, whitening
from .common import Workspace, held_out, load


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = quality.train(docs, labels, "quality", ~held_out("doc_id", 3, 1))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = token_counts.prefix_table(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), budget=4096, keep_deltas=False)
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    index = toxicity.build(docs, labels, "toxic", ~held_out("doc_id", 5, 0))
    return toxicity.score(docs, index).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "evidence")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    warc.write_archives(load(spark, sf_dir, "pages"), ws.path("archives"), each_row=True)
    files = spark.read.format("binaryFile").load(ws.path("archives"))
    pages = warc.read_archives(files)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of fingerprints within three bits, for every document whose id is divisible by 100."""
    return simhash.with_near_counts(spark, simhash.edited_fingerprints(load(spark, sf_dir, "documents")), F.col("doc_id") % 100 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(spark, load(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), unnamed=True)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(spark, load(spark, sf_dir, "documents"), n=3, per_cent=90)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, load(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


#: Rules of op12, host and path.
OP12_RULES = [url_filters.rule(text, verdict) for text, verdict in [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(spark, load(spark, sf_dir, "pages"), OP12_RULES)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality, "op2_token_counts": op2_token_counts, "op3_token_files": op3_token_files, "op4_toxicity": op4_toxicity, "op5_warc": op5_warc,
    "op6_simhash": op6_simhash, "op7_pii": op7_pii, "op8_decontamination": op8_decontamination, "op9_ngram_join": op9_ngram_join, "op10_packing": op10_packing,
    "op11_whitening": op11_whitening, "op12_url_filters": op12_url_filters, "op13_collocations": op13_collocations,
}

#: Equal payloads of at least 100 bytes are one response and its revisits.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

#: Words are runs of a-z, 0-9 and characters beyond ASCII once A-Z are lowered.  A window is a list of words.
OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS size, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size),
occ AS (SELECT rid, dw.size, pos, item FROM dw JOIN win ON dw.size = win.size AND array_to_string(list_slice(dw.w, pos, pos + dw.size - 1), ' ') = win.win),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + size)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

#: Sets of 3-word shingles; the links and what they reach.
OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + least(3, len(w)) - 1), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * n_both >= 90 * (nx.n + ny.n - n_both)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, y AS seen FROM edges UNION SELECT reach.doc_id, y FROM reach JOIN edges ON reach.seen = x),
least_id AS (SELECT doc_id, min(seen) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_id ON d.doc_id = least_id.doc_id
"""

#: Words of pieces, their n-grams, the lowest-scoring cut, and phrases inside of longer ones left out.
OP13_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(list_slice(w, i, i + size - 1), ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, fl.f AS l, fr.f AS r, ((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (fl.f::HUGEINT * fr.f::HUGEINT))::BIGINT AS score
           FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = first JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""



def _steps_sql(steps: int) -> str:
    """Trust and distrust step by step, in whole numbers."""
    one = "m{k} AS MATERIALIZED (SELECT host, kind, sum(mass)::BIGINT AS mass FROM (SELECT e.dst AS host, e.kind, (m.mass // 100 * 85) // e.degree AS mass FROM e JOIN m{before} m ON e.kind = m.kind AND e.src = m.host UNION ALL SELECT host, kind, mass FROM m0) GROUP BY ALL)"
    return ",\n".join(one.format(k=k, before=k - 1) for k in range(1, steps + 1))


#: Rules by length; masses of seeds, spread over links between hosts and back over them.
OP12_SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
j AS (SELECT page_id, host, path, html, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                                       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                                       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                                       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                                       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
r AS MATERIALIZED (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM j),
s AS (SELECT host, CASE ruled WHEN 'allow' THEN 1 ELSE -1 END AS kind, count(*) AS n FROM r WHERE ruled IS NOT NULL GROUP BY ALL),
m0 AS MATERIALIZED (SELECT host, kind, n * ({url_filters.UNITS} // greatest(1, (SELECT sum(n) FROM s)::BIGINT)) AS mass FROM s),
h AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?is)\\b(?:href|src)\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^"''\\s>/?#\\\\]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM r),
l AS (SELECT DISTINCT src, dst FROM h WHERE src <> '' AND dst <> '' AND src <> dst),
b AS (SELECT 1 AS kind, src, dst FROM l UNION ALL SELECT -1, dst, src FROM l),
e AS MATERIALIZED (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree FROM b),
{_steps_sql(url_filters.STEPS)},
g AS (SELECT host, sum(CASE WHEN kind = 1 THEN mass ELSE 0 END)::BIGINT AS trust, sum(CASE WHEN kind = -1 THEN mass ELSE 0 END)::BIGINT AS distrust FROM m{url_filters.STEPS} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM r LEFT JOIN g ON r.host = g.host
"""

ORACLE_SQL = {"op5_warc": OP5_SQL, "op8_decontamination": OP8_SQL, "op9_ngram_join": OP9_SQL, "op12_url_filters": OP12_SQL, "op13_collocations": OP13_SQL}
