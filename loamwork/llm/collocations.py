"""Phrase collocations by pivot partitioning: count all word n-grams, score candidates exactly, keep each language's best.

Each n-gram is owned by its rarest word, its pivot.  Around every occurrence of a word a text is rewritten to what that
word can own as the pivot: the words before it that are more frequent and the words after it that aren't rarer, up to the
first that isn't or the piece's end.  Words too rare for any candidate end fragments too.  Fragments go to their pivot,
and each pivot's are mined by themselves: only n-grams with the pivot in them are counted, so every occurrence counts
once and a count is final where it is made.

The order of words is by counts in a table of fixed size (2^TABLE_BITS hashed counts, 8 MB), then hash, then bytes.
Words that share an entry share a count, which moves n-grams to another owner and never changes a result: any order
would do.  Pivots with more than HOT_FRAGMENTS occurrences are split by fragment, and their counts are added up again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, shuffle_partitions

TABLE_BITS = 20
#: A pivot with more occurrences is dealt to as many parts as it takes to have so many in each.
HOT_FRAGMENTS = 1 << 19
#: Bytes of text taken together, and fragments in a row.
TOGETHER = 8 << 20
TOGETHER_FRAGMENTS = 100

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 0: of a word, 1: white space, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class _Words:
    """The words of some texts in a row: unit (number of its language and spelling), first (no word of its piece before it)."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = _KIND[raw]
        word = kind == 0
        opens = np.zeros(len(raw) + 1, bool)
        opens[offsets] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts = np.flatnonzero(word & (~before | opens[:-1]))
        ends = np.flatnonzero(word & (~after | opens[1:])) + 1
        of = np.searchsorted(offsets, starts, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.first = np.ones(len(starts), bool)
        self.first[1:] = (of[1:] != of[:-1]) | (piece[1:] != piece[:-1])
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_LOWER[raw[word]])).dictionary_encode()
        langs = langs.dictionary_encode()
        many = max(1, len(spelled.dictionary))
        both = pa.array(langs.indices.to_numpy()[of].astype(np.int64) * many + spelled.indices.to_numpy()).dictionary_encode()
        self.unit, names = both.indices.to_numpy(), both.dictionary.to_numpy()
        self.langs = langs.dictionary.take(pa.array(names // many))
        self.words = spelled.dictionary.take(pa.array(names % many)).cast(pa.string())


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """Words of the batches (lang, text), some TOGETHER bytes at a time; longer texts are cut between pieces."""
    held: list[tuple[pa.Array, pa.Array]] = []
    size = 0
    for batch in batches:
        langs, texts = batch.column(0).cast(pa.string()), batch.column(1).cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        start = 0
        for i in range(len(texts)):
            size += int(sizes[i])
            if size >= TOGETHER:
                for part in _cut(texts[i]) if sizes[i] >= TOGETHER else [None]:
                    held.append((langs.slice(start, i + 1 - start), texts.slice(start, i + 1 - start)) if part is None else (langs.slice(i, 1), part))
                    if part is not None and start < i:
                        held.insert(0, (langs.slice(start, i - start), texts.slice(start, i - start)))
                        start = i
                    yield _Words(*(pa.concat_arrays([x[k] for x in held]) for k in (0, 1)))
                    held = []
                start, size = i + 1, 0
        if start < len(texts):
            held.append((langs.slice(start), texts.slice(start)))
    if held:
        yield _Words(*(pa.concat_arrays([x[k] for x in held]) for k in (0, 1)))


def _cut(text: pa.Scalar) -> Iterator[pa.Array]:
    """A long text in parts that end between pieces."""
    whole = memoryview(text.as_buffer())
    raw, start = np.frombuffer(whole, np.uint8), 0
    while start < len(raw):
        end = min(len(raw), start + TOGETHER)
        while end < len(raw) and _KIND[raw[end]] != 2:  # between pieces, else on to where the piece ends
            found = np.flatnonzero(_KIND[raw[end : end + TOGETHER]] == 2)
            end = end + int(found[0]) if len(found) else min(len(raw), end + TOGETHER)
        yield pa.array([bytes(whole[start:end])], pa.large_binary()).cast(pa.large_string())
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n."""
    for x in _taken(batches):
        yield pa.RecordBatch.from_arrays([x.langs, x.words, pa.array(np.bincount(x.unit, minlength=len(x.words)))], ["lang", "word", "n"])


def _hash(langs: list[str], words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(f"{a}\t{w}".encode()) for a, w in zip(langs, words, strict=True)], np.int64)


def _spark_hash() -> Column:
    return F.crc32(F.concat_ws("\t", "lang", "word").cast("binary"))


def _fragments(table: np.ndarray, most_words: int, least: int):
    """Of batches (lang, text): rows lang, pivot, part, fragments, split.

    A fragment is most_words - 1 words before the pivot, as many behind it ('' for none) and how often it occurs, each
    with a tab behind it; a row has up to TOGETHER_FRAGMENTS of them.
    """
    reach = most_words - 1
    steps = [*range(-reach, 0), *range(1, reach + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _taken(batches):
            if not len(x.unit):
                continue
            crc = _hash(x.langs.to_pylist(), x.words.to_pylist())
            count = table[crc & (len(table) - 1)]
            order = pc.sort_indices(pa.table({"n": count, "crc": crc, "word": x.words}), sort_keys=[("n", "ascending"), ("crc", "ascending"), ("word", "ascending")]).to_numpy()
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            rank[count < least] = -1
            columns = _contexts(rank[x.unit], x.first, reach)
            if not len(columns["0"]):
                continue
            found = pa.TableGroupBy(pa.table(columns), list(columns), use_threads=False).aggregate([([], "count_all")])
            crc, count = np.append(crc[order], 0), count[order]
            pivot, *near = (found[k].to_numpy() for k in ("0", "-1", "1"))
            parts = -(-count // HOT_FRAGMENTS)
            part = (crc[near[0]] * 31 + crc[near[1]]) % np.maximum(parts, 1)[pivot]
            found = found.append_column("part", pa.array(part)).sort_by([("0", "ascending"), ("part", "ascending"), *((str(k), "ascending") for k in steps)])
            pivot, part = found["0"].to_numpy(), found["part"].to_numpy()
            langs, words = x.langs.take(pa.array(order)), pa.concat_arrays([x.words.take(pa.array(order)), pa.array([""])]).cast(pa.large_string())
            fields = [words.take(pa.array(np.where((at := found[str(k)].to_numpy()) < 0, len(order), at))) for k in steps]
            lines = pc.binary_join_element_wise(*fields, found["count_all"].combine_chunks().cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\t", pa.large_string()))
            changes = np.flatnonzero((pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])) + 1
            begins = np.unique(np.concatenate([[0], changes, np.arange(0, len(pivot), TOGETHER_FRAGMENTS)]))
            ends = np.frombuffer(lines.buffers()[1], np.int64)[np.append(begins, len(pivot))]
            packed = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), lines.buffers()[2]).cast(pa.string())
            at = pa.array(pivot[begins])
            yield pa.RecordBatch.from_arrays([langs.take(at), words.take(at).cast(pa.string()), pa.array(part[begins].astype(np.int32)), packed, pa.array(parts[pivot[begins]] > 1)], ["lang", "pivot", "part", "fragments", "split"])

    return run


def _contexts(r: np.ndarray, first: np.ndarray, reach: int) -> dict[str, np.ndarray]:
    """For words of these ranks that can be a pivot with others: "0" their rank, "-1", "1" and so on those around it.

    An n-gram belongs to the first of its rarest words: those before the pivot are more frequent, those behind it at
    least as frequent.  -1 from the first word on that isn't, and beyond the piece.
    """
    size = len(r)
    own = {}
    for side in (-1, 1):
        going = r >= 0
        for step in range(1, reach + 1):
            other, opens = np.full(size, -1, np.int32), np.ones(size, bool)
            if step < size:
                if side < 0:
                    other[step:], opens[step:] = r[:-step], first[1 : size - step + 1]
                else:
                    other[:-step], opens[:-step] = r[step:], first[step:]
            going = going & ~opens & ((other > r) if side < 0 else (other >= r))
            own[str(side * step)] = np.where(going, other, -1)
    kept = np.flatnonzero((own["-1"] >= 0) | (own["1"] >= 0))
    return {"0": r[kept]} | {k: v[kept] for k, v in own.items()}


def _mined(most_words: int, least: int):
    """Of batches (lang, pivot, part, fragments, split) in this order: lang, phrase, n, of the n-grams with the pivot in
    them; n below least only where the pivot is split, as its other parts add to it."""
    reach = most_words - 1
    steps = [*range(-reach, 0), 0, *range(1, reach + 1)]
    spans = [range(i, i + k) for k in range(2, most_words + 1) for i in range(len(steps) - k + 1) if 0 in steps[i : i + k]]

    def mine(rows: pa.Table) -> pa.RecordBatch:
        packed = rows["fragments"].combine_chunks()
        at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
        raw = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]]
        tabs = np.flatnonzero(raw == 9)
        cuts = np.concatenate([[0], tabs + 1 - np.arange(1, len(tabs) + 1)])
        fields = pa.LargeStringArray.from_buffers(len(tabs), pa.py_buffer(cuts), pa.py_buffer(raw[raw != 9]))
        own = np.arange(len(tabs)).reshape(-1, 2 * reach + 1)
        row = np.repeat(np.arange(len(rows)), np.diff(np.searchsorted(tabs, at - at[0])) // (2 * reach + 1))
        n = fields.take(pa.array(own[:, -1])).cast(pa.int64()).to_numpy()
        names = pa.concat_arrays([fields.take(pa.array(own[:, :-1].ravel())), rows["pivot"].combine_chunks().cast(pa.large_string())]).dictionary_encode()
        ids = names.indices.to_numpy()
        around, pivot = ids[: -len(rows)].reshape(-1, 2 * reach), ids[-len(rows) :][row]
        none = pc.index(names.dictionary, "").as_py()
        words = np.insert(around, reach, pivot, axis=1)
        lang = rows["lang"].combine_chunks().dictionary_encode()
        split = rows["split"].combine_chunks().to_numpy(zero_copy_only=False)
        parts = []
        for span in spans:
            own_words = words[:, list(span)]
            kept = np.flatnonzero((own_words != none).all(axis=1))
            padded = np.full((len(kept), most_words), -1, np.int32)
            padded[:, : len(span)] = own_words[kept]
            parts.append(np.column_stack([lang.indices.to_numpy()[row[kept]], split[row[kept]], padded, n[kept]]))
        every = np.concatenate(parts)
        keys = ["lang", "split", *(f"w{k}" for k in range(most_words))]
        found = pa.TableGroupBy(pa.table({k: every[:, i] for i, k in enumerate([*keys, "n"])}), keys, use_threads=False).aggregate([("n", "sum")])
        found = found.filter(pc.or_(pc.equal(found["split"], 1), pc.greater_equal(found["n_sum"], least)))
        empty = pa.concat_arrays([names.dictionary, pa.array([""], pa.large_string())])
        texts = [empty.take(pa.array(np.where((w := found[f"w{k}"].to_numpy()) < 0, len(names.dictionary), w))) for k in range(most_words)]
        phrase = pc.ascii_rtrim(pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())), characters=" ")
        return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(found["lang"].to_numpy())), phrase.cast(pa.string()), found["n_sum"].combine_chunks()], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3).cast(pa.large_string()), batch.column(4)], ["lang", "pivot", "part", "fragments", "split"])
            keys = [batch.column(k).dictionary_encode().indices.to_numpy() for k in range(3)]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            same = held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(3))
            last = int(changes[-1]) if len(changes) else 0
            if last or (held and not same):  # the last pivot may go on in the next batch
                yield mine(pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])]).combine_chunks())
                held = []
            held.append(batch.slice(last))
        if held:
            yield mine(pa.Table.from_batches(held).combine_chunks())

    return run


def _table(words: DataFrame) -> np.ndarray:
    """Counts (lang, word, n) in 2^TABLE_BITS entries by hash."""
    at = _spark_hash().bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    found = words.groupBy(at.alias("at")).agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << TABLE_BITS, np.int64)
    table[found["at"].to_numpy()] = found["n"].to_numpy()
    return table


def frequent_ngrams(spark: SparkSession, docs: DataFrame, ws: Workspace, most_words: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n) with all their counts, and phrases (lang, phrase, n) of 2 to most_words words, n >= least.

    docs: lang, text.  A null lang is 'und', a null text empty.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = ws.save(counted, "words")
    shared = spark.sparkContext.broadcast(_table(words))

    def run(batches):
        return _fragments(shared.value, most_words, least)(batches)

    fragments = rows.mapInArrow(run, "lang string, pivot string, part int, fragments string, split boolean")
    dealt = fragments.repartition(shuffle_partitions(spark), "lang", "pivot", "part").sortWithinPartitions("lang", "pivot", "part")
    mined = dealt.mapInArrow(_mined(most_words, least), "lang string, phrase string, n long")
    phrases = ws.save(mined.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    return words, phrases


def collocations(spark: SparkSession, docs: DataFrame, most_words: int = 3, least: int = 10, inside_per_cent: int = 50, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to most_words words of each language in docs (lang, text).

    A phrase of a occurrences is cut where floor(10^6 a^2 / (l r)), of its parts' occurrences, is least (of equals, the
    first).  Phrases that lie in a longer one with at least inside_per_cent of their occurrences are left out.
    Arithmetic is exact: decimals of 38 digits with whole division.  Best first by score, then a, then phrase (by bytes).
    Null languages are 'und'; null and empty texts have no words; repeated rows count each; no rows give no phrases.
    Columns beside lang and text, of any name, aren't read.
    """
    ws = Workspace(spark, "collocations")
    words, phrases = frequent_ngrams(spark, docs, ws, most_words, least)
    parts = words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n").union(phrases)
    own = F.split("phrase", " ")
    cut = phrases.select("lang", "phrase", F.col("n").alias("a"), own.alias("own"), F.explode(F.sequence(F.lit(1), F.size(own) - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("own", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("own", F.col("k") + 1, F.size("own") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr("1000000BD * (CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    sizes = F.sequence(F.lit(2), F.size("own") - 1)
    inner = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.size("own") - k + 1), lambda i: F.array_join(F.slice("own", i, k), " "))))
    longer = phrases.select("lang", "n", own.alias("own")).where(F.size("own") > 2).select("lang", "n", F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(inside_per_cent) * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of many parts first, so that no task sorts a whole language.
    part = F.pmod(F.crc32(F.col("phrase").cast("binary")), F.lit(shuffle_partitions(spark)))
    few = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
