"""SimHash document fingerprints and the search for all fingerprints within a Hamming radius.

Everything here is DataFrame functions.  A text's terms are its lower-cased words; a word votes on every bit of
its hash with a weight that grows with its length, so function words count little.  The votes of 16 sums stand
side by side in one 64-bit number, four lanes of 16 bits each, over blocks of words that can't overflow a lane;
blocks are then added up in wider numbers.  Partial sums leave one row per block of words before any shuffle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, shuffle_partitions, text_or_empty

BITS = 128
#: Largest weight of a word, and words in a block: their product stays below 2**15, the top lane's room.
MOST_WEIGHT, BLOCK_WORDS = 16, 2000
#: Bits in which near fingerprints may differ, and fingerprints in a list of a block table.
RADIUS, BUCKET = 3, 1000
_LANES = 0x0001_0001_0001_0001


def _weight(word: Column) -> Column:
    size = F.least(F.char_length(word), F.lit(8))
    return F.greatest(F.floor(size * size / 4), F.least(size, F.lit(1))).cast("long")


def _votes(words: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Sums of the weights (`total`) and of each bit's votes (`s<hash>_<shift>`, four lanes) by keys and block."""
    hashes = {"h0": F.xxhash64("word")} | {f"h{i}": F.xxhash64("word", F.lit(i)) for i in range(1, bits // 64)}
    hashed = words.withColumns({**hashes, "w": _weight(F.col("word"))})
    sums = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"s{h[1:]}_{k}") for h in hashes for k in range(16)]
    return hashed.groupBy(*keys, "block").agg(F.sum("w").alias("total"), *sums)


def fingerprint_rows(texts: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """keys and the numbers f0, f1, ... (64 bits each) of the fingerprint of column `text`.

    keys must name each row.  A bit is set if its votes for are more than half of all, so a text without words
    has zeros, as has a tie.  A null text counts as empty.
    """
    split = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[ \\n\\t\\r]+")
    words = texts.select(*keys, F.posexplode(split).alias("word_at", "word")).withColumn("block", F.floor(F.col("word_at") / BLOCK_WORDS))
    votes = _votes(words, keys, bits)
    wide = []
    for i in range(bits // 64):
        for k in range(16):
            s = F.col(f"s{i}_{k}")
            for half in range(2):  # two lanes of 32 bits a number: lanes 2*half and 2*half + 1
                low, high = F.shiftrightunsigned(s, 32 * half).bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(s, 32 * half + 16).bitwiseAND(F.lit(0xFFFF))
                wide.append(F.sum(low + F.shiftleft(high, 32)).alias(f"v{i}_{k}_{half}"))
    added = votes.groupBy(*keys).agg(F.sum("total").alias("total"), *wide)
    numbers = []
    for i in range(bits // 64):
        number = F.lit(0).cast("long")
        for bit in range(64):
            lane, k = divmod(bit, 16)
            ones = F.shiftrightunsigned(F.col(f"v{i}_{k}_{lane // 2}"), 32 * (lane % 2)).bitwiseAND(F.lit(0xFFFF_FFFF))
            number = number.bitwiseOR(F.shiftleft((ones * 2 > F.col("total")).cast("long"), bit))
        numbers.append(number.alias(f"f{i}"))
    return added.select(*keys, *numbers)


def as_hex(numbers: list[str]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in numbers]))


def likeness(a: list[str], b: list[str]) -> Column:
    """1 less the share of differing bits."""
    differing = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    return 1.0 - differing / F.lit(64.0 * len(a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """A row per distinct (id, text) of docs with its fingerprint in hex; null texts count as empty."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).distinct().withColumn("key", F.monotonically_increasing_id())
    names = [f"f{i}" for i in range(bits // 64)]
    return fingerprint_rows(rows, [id_col, "key"], bits).select(id_col, as_hex(names).alias("fingerprint"))


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their successor's text: part, guard, k, h, text, next_text, at; guard rows repeat a part's successor.

    Order is by id, then by a hash of the text; nulls come first; the first row follows the last.  Rows are dealt
    by id into parts of about equal size; the first row of a part is dealt to the part before it as well.  The
    driver holds one row per part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    parts = 4 * shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx(F.col(id_col), [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"]
    cuts = sorted({x for x in cuts or [] if x is not None})
    step = max(1, int(len(cuts) ** 0.5))
    if cuts:  # the number of cuts up to an id, by a search in two steps
        groups = F.array(*[F.array(*[F.lit(x) for x in cuts[a : a + step]]) for a in range(0, len(cuts), step)])
        heads = F.array(*[F.lit(x) for x in cuts[::step]])
        group = F.size(F.filter(heads, lambda c: c <= F.col("k")))
        within = F.size(F.filter(F.element_at(groups, F.greatest(group, F.lit(1))), lambda c: c <= F.col("k")))
        rows = rows.withColumn("part", F.when(group > 0, (group - 1) * step + within).otherwise(0))
    else:
        rows = rows.withColumn("part", F.lit(0))
    firsts = [(r["part"], r["f"]["k"], r["f"]["h"]) for r in sorted(rows.groupBy("part").agg(F.min(F.struct("k", "h")).alias("f")).collect())]
    kind = docs.schema[id_col].dataType.simpleString()
    guards = spark.createDataFrame([(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)], f"gk {kind}, gh long, before int")
    dealt = rows.join(F.broadcast(guards), F.col("k").eqNullSafe(F.col("gk")) & (F.col("h") == F.col("gh")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guard"))
    to = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("part"), F.lit(1).alias("guard"))))
    dealt = dealt.select("k", "h", "text", F.explode(to).alias("to")).select("to.part", "to.guard", "k", "h", "text")
    order = Window.partitionBy("part").orderBy("guard", "k", "h")
    return dealt.withColumns({"next_text": F.lead("text").over(order), "at": F.row_number().over(order)})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """A row per row of docs: its text's fingerprint and that of its edited text.

    The edited text has its last half (rounded down, in code points) replaced by the first as many code points of
    the next row's text; see _in_order for what is next.  A null text counts as empty; null ids come first and
    repeated rows follow each other; other columns are ignored; an empty table gives no rows.
    """
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = _in_order(docs, id_col, text_col).select((F.col("part").cast("long") * (1 << 34) + F.col("guard") * (1 << 33) + F.col("at")).alias("row"), "k", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["row", "k", "n_chars", "edited_sha256"]
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    texts = rows.select(*keys, both.alias("x")).select(*keys, "x.kind", "x.text")
    names = [f"f{i}" for i in range(bits // 64)]
    found = fingerprint_rows(texts, [*keys, "kind"], bits)
    pick = [F.max(F.when(F.col("kind") == kind, F.col(x))).alias(f"{to}{x}") for kind, to in ((0, ""), (1, "e")) for x in names]
    found = found.groupBy(*keys).agg(*pick)
    after = Window.partitionBy(F.shiftright("row", 34)).orderBy("row")
    found = found.withColumns({f"n{x}": F.lead(x).over(after) for x in names}).where(F.col("row").bitwiseAND(1 << 33) == 0)
    return found.select(
        F.col("k").alias(id_col), "n_chars", "edited_sha256", as_hex(names).alias("fingerprint"), as_hex([f"e{x}" for x in names]).alias("edited_fingerprint"),
        likeness(names, [f"e{x}" for x in names]).alias("near_edited"), likeness(names, [f"n{x}" for x in names]).alias("near_next"),
    )


def _numbers(bits: int) -> list[Column]:
    return [F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("long").alias(f"f{i}") for i in range(bits // 64)]


def _masks(bounds: list[int], bits: int) -> list[list[int]]:
    """Of each block of hex digits, its bits in each of the fingerprint's numbers, as signed 64-bit integers."""
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        whole = (1 << 4 * (b - a)) - 1 << bits - 4 * b
        parts = [whole >> bits - 64 * (i + 1) & (1 << 64) - 1 for i in range(bits // 64)]
        out.append([x - (1 << 64) if x >> 63 else x for x in parts])
    return out


def counted_within(found: DataFrame, asked: DataFrame, radius: int, blocks: int | None = None, bits: int = BITS) -> DataFrame:
    """fingerprint, n_within for the fingerprints asked about: how many other distinct ones of `found` differ in at most `radius` bits.

    The tables of within_radius, without their pairs: each key's fingerprints stand in lists of at most about BUCKET,
    several to a key that many share, and a list is counted where a question meets it.  A fingerprint counts in the
    first table that has both under one key, so once.  Both inputs have a column `fingerprint` (hex); repeats stand once.
    """
    blocks = blocks or 2 * radius
    digits = bits // 4
    if not 0 < radius < blocks <= digits:
        raise ValueError("needs 0 < radius < blocks <= hex digits")
    bounds = [round(i * digits / blocks) for i in range(blocks + 1)]
    names, masks = [f"f{i}" for i in range(bits // 64)], _masks(bounds, bits)
    chosen = list(combinations(range(blocks), blocks - radius))
    kept = lambda i: [F.col(x).bitwiseAND(F.lit(m)) for x, m in zip(names, masks[i], strict=True) if m]
    keys = F.array(*[F.struct(F.lit(n).alias("at"), F.xxhash64(*[c for i in own for c in kept(i)]).alias("key")) for n, own in enumerate(chosen)])
    spread = lambda df: df.select("fingerprint", *_numbers(bits)).distinct().select(*names, F.explode(keys).alias("x")).select(*names, "x.at", "x.key")
    asks = spread(asked)
    have = spread(found).join(asks.select("at", "key").distinct(), ["at", "key"], "left_semi")
    hot = have.groupBy("at", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("at", "key", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*names), F.col("parts")).cast("int"), F.lit(0))
    lists = have.join(hot, ["at", "key"], "left").groupBy("at", "key", part.alias("part")).agg(F.collect_list(F.struct(*names)).alias("own"))
    asks = asks.join(hot, ["at", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def near(x: Column) -> Column:
        apart = [x[n].bitwiseXOR(F.col(n)) for n in names]
        few = sum((F.bit_count(a) for a in apart), F.lit(0)).between(1, radius)
        same = [F.lit(True) for _ in range(blocks)]
        for i in range(blocks):
            for a, m in zip(apart, masks[i], strict=True):
                if m:
                    same[i] = same[i] & (a.bitwiseAND(F.lit(m)) == 0)
        first = F.coalesce(*[F.when(_every([same[i] for i in own]), n) for n, own in enumerate(chosen)])
        return few & (first == F.col("at"))

    met = asks.join(lists, ["at", "key", "part"]).select(*names, F.size(F.filter("own", near)).cast("long").alias("n"))
    counts = met.groupBy(*names).agg(F.sum("n").alias("n_within"))
    return counts.select(as_hex(names).alias("fingerprint"), "n_within")


def _every(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def with_near_counts(spark: SparkSession, rows: DataFrame, asked: Column, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """rows (with a column `fingerprint`) and n_within: for those asked about, how many other distinct fingerprints of the
    rows are within the radius; null for the rest.

    radius + 1 tables: a block is 32 of 128 bits then, so even among billions of fingerprints few share one by chance.
    """
    ws = Workspace(spark, "simhash")
    rows = ws.save(rows, "fingerprints")
    ws.release()
    question = F.coalesce(asked, F.lit(False))
    counts = counted_within(rows.select("fingerprint"), rows.where(question).select("fingerprint"), radius, radius + 1, bits)
    return rows.where(question).join(counts, "fingerprint").select(*rows.columns, "n_within").union(rows.where(~question).withColumn("n_within", F.lit(None).cast("long")))


def within_radius(found: DataFrame, radius: int, blocks: int | None = None, bits: int = BITS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints (hex column `fingerprint`) that differ in 1 to `radius` bits, with `distance`.

    Permuted block tables: fingerprints are cut into `blocks` blocks, of which at least blocks - radius are equal
    in any such pair, so there is a table for each choice of that many blocks, keyed by them.  Equal fingerprints
    stand for each other, so copies make no pairs.  Keys span most bits, so only near fingerprints share one.
    """
    blocks = blocks or 2 * radius
    digits = bits // 4
    if not 0 < radius < blocks <= digits:
        raise ValueError("needs 0 < radius < blocks <= hex digits")
    bounds = [round(i * digits / blocks) for i in range(blocks + 1)]
    part = [F.substring("fingerprint", a + 1, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
    tables = [F.concat(F.lit(f"{n}:"), *[part[i] for i in chosen]) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = found.select("fingerprint").distinct().select("fingerprint", F.explode(F.array(*tables)).alias("key"))
    left, right = keyed.select(F.col("fingerprint").alias("a"), "key"), keyed.select(F.col("fingerprint").alias("b"), "key")
    number = lambda c, i: F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("long")
    distance = sum((F.bit_count(number("a", i).bitwiseXOR(number("b", i))) for i in range(bits // 64)), F.lit(0))
    pairs = left.join(right, "key").where("a < b").withColumn("distance", distance).where(F.col("distance") <= radius)
    return pairs.select("a", "b", "distance").distinct()
