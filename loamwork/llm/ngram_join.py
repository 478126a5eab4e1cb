"""Exact Jaccard self-join of documents on word n-grams, with signature trees.

A set's prefix is its first few elements in a fixed order, rare ones first; sets similar enough share an element
of their prefixes.  So candidates meet at shared prefix elements.  Equal sets are one class from the start, and
only whether classes end in one component matters, so no group is expanded into its pairs:

1. Each class goes with the smallest class it shares a prefix element with, if their bitmaps allow the similarity.
2. Elements whose classes are in several candidate groups then: signature trees over their bitmaps, and only the
   links that join groups come out.
3. The candidate groups hold every component whole.  Their sets are built again from the texts, one copy each, and
   signature trees over exact bitmaps give the links.

A large group is dealt to tasks as pairs of blocks; blocks that are one component already are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .components import components, extended, roots
from .signature_tree import Groups, fold, link_exact, link_hashed
from .units import column_slices, cuts

#: Frequent elements go last in the order: a table of ORDER_SLOTS bytes has the (logarithmic) count of the most frequent
#: ORDERED_ELEMENTS.  It only orders elements, any table gives the same result.
ORDERED_ELEMENTS, ORDER_SLOTS = 1 << 20, 1 << 23
#: Sets in a block of a large group.
BLOCK_HASHED, BLOCK_EXACT = 2048, 512
FILTER_BITS_EACH, FILTER_MOST_BITS = 16, 1 << 26
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Random numbers of bytes (capital and small letters alike), and which bytes part words.
_OF_BYTE = np.random.default_rng(1_913).integers(0, 1 << 64, 256, np.uint64)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    out = []
    for base in (0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _word_hashes(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts in a row (bytes, and where each text starts and the last ends), and at which
    word each text starts.  A word's hash is a polynomial of its bytes' numbers, a difference of running sums."""
    inside = _IN_WORD[data]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    edges = cut[(cut > 0) & (cut < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = 1 << 21
    while size < len(data):
        size *= 2
    power, inverse = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * power[: len(data)], out=sums[1:], dtype=np.uint64)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = (h ^ h >> np.uint64(31)) * _B
    return h ^ h >> np.uint64(29), np.searchsorted(starts, cut)


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    mixed = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : k + len(mixed)]) * _A
        mixed ^= mixed >> np.uint64(29)
    mixed *= _B
    return mixed ^ mixed >> np.uint64(32)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[:1] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if there are fewer words."""
    for a, b in column_slices(texts, 1 << 20):
        cut = cuts(texts)[a : b + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cut[0] : cut[-1]]
        h, first = _word_hashes(data, cut - cut[0])
        whole = _mixed(h, n)
        for x, y in zip(first.tolist(), first.tolist()[1:], strict=False):
            yield _distinct(whole[x : y - n + 1]) if y - x >= n else _mixed(h[x:y], y - x) if y > x else h[:0]


def shingle_set(text: str, n: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), n))


def _prefix_size(n: int, per_cent: int) -> int:
    """Elements of which sets of n and of any similar size must share one: n less the least overlap, plus one."""
    return n - -(-per_cent * n // 100) + 1


def _digest(s: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _bitmap(s: np.ndarray) -> bytes:
    words = 1
    while words * 64 < len(s):
        words *= 2
    bits = np.zeros(words * 64, bool)
    bits[(s >> np.uint64(7)) & np.uint64(words * 64 - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _frequent(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in column_slices(batch.column(0), 1 << 23):
                tokens = np.sort(np.concatenate([*shingle_sets(batch.column(0).slice(a, b - a), n), np.zeros(0, np.uint64)]))
                first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
                count = np.diff(first, append=len(tokens))
                often = count > 1
                yield pa.RecordBatch.from_arrays([pa.array(tokens[first[often]].astype(np.int64)), pa.array(count[often])], ["token", "n"])

    return run


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(17)) & np.uint64(ORDER_SLOTS - 1)


def _order_table(often: DataFrame) -> np.ndarray:
    """The byte by which elements are ordered, by slot: eight times the binary logarithm of the count of the most frequent.

    Of often (token, n), the at most ORDERED_ELEMENTS of the highest counts come to the driver, whole steps of the
    logarithm at a time."""
    step = F.least(F.lit(255), F.floor(F.log2("n") * 8)).cast("int")
    left, least = ORDERED_ELEMENTS, 256
    for r in sorted(often.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    table = np.zeros(ORDER_SLOTS, np.uint8)
    for batch in often.select("token", step.alias("step")).where(F.col("step") >= least).toArrow().to_batches():
        np.maximum.at(table, _slots(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy().astype(np.uint8))
    return table


def _signatures(n: int, per_cent: int, table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in column_slices(batch.column(1)):
                h1, h2, sizes, keys, bits = [], [], [], [], []
                for s in shingle_sets(batch.column(1).slice(a, b - a), n):
                    for column, number in zip((h1, h2), _digest(s), strict=True):
                        column.append(number)
                    sizes.append(len(s))
                    # By the table, then by value: s is sorted and the sort is stable.
                    first = np.argsort(table[_slots(s)], kind="stable")[: _prefix_size(len(s), per_cent) if len(s) else 0]
                    keys.append(s[first].astype(np.int64))
                    bits.append(_bitmap(s))
                lengths = np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(bits, pa.binary())], ["doc_id", "h1", "h2", "size", "keys", "bits"])

    return run


def pair_allowed(bits_a: bytes, bits_b: bytes, size_a: int, size_b: int, per_cent: int) -> bool:
    """Whether two sets' hashed bitmaps and sizes allow the similarity."""
    if 100 * min(size_a, size_b) < per_cent * max(size_a, size_b):
        return False
    if len(bits_a) != len(bits_b):
        width = min(len(bits_a), len(bits_b)) // 8
        bits_a, bits_b = (fold(np.frombuffer(x, np.uint64)[None, :], width).tobytes() for x in (bits_a, bits_b))
    x, y = int.from_bytes(bits_a, "little"), int.from_bytes(bits_b, "little")
    common = (x & y).bit_count()
    overlap = min(size_a - x.bit_count() + common, size_b - y.bit_count() + common)
    return (100 + per_cent) * overlap >= per_cent * (size_a + size_b)


def _allowed(per_cent: int):
    """Rows (a, b, bits and sizes of both) whose bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            made = [x for *x, bx, by, sx, sy in zip(*(rows[k] for k in ("a", "b", "bits_a", "bits_b", "size_a", "size_b")), strict=True) if pair_allowed(bx, by, sx, sy, per_cent)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.int64()), pa.array([y for _, y in made], pa.int64())], ["a", "b"])

    return run


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Columns of each run of rows with equal keys; a run may span batches."""
    held: dict[str, list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.to_pydict()
        marks = list(zip(*(rows[k] for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = {k: v[a:b] for k, v in rows.items()}
            if held is not None and all(held[k][0] == part[k][0] for k in keys):
                for k, v in part.items():
                    held[k] += v
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


def _joined(rows: dict[str, list]) -> tuple[Groups, np.ndarray | None]:
    """Union-find over the rows with those of one label joined, and each row's side of a pair of blocks."""
    groups, first = Groups(len(rows["node"])), {}
    for i, x in enumerate(rows["label"]):
        groups.join(first.setdefault(x, i), i)
    side = np.array(rows["side"])
    return groups, None if side[0] < 0 else side


def _spokes(made: list[tuple[int, int]], groups: Groups, nodes: list[int]) -> list[tuple[int, int]]:
    """Edges from each newly joined node to one node of its group, so that components have short ways."""
    return list({(nodes[k], nodes[groups.find(k)]): None for pair in made for k in pair})


def _batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])


def _hashed_links(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in _by_group(batches, ["key", "i", "j"]):
            if len(rows["node"]) == 2:  # most groups: no tree is needed for one pair
                if rows["label"][0] != rows["label"][1] and pair_allowed(*rows["bits"], *rows["size"], per_cent):
                    out.append((rows["node"][0], rows["node"][1]))
            elif len(rows["node"]) > 2:
                groups, side = _joined(rows)
                out += _spokes(link_hashed(rows["bits"], np.array(rows["size"]), groups, per_cent, side), groups, rows["node"])
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


def _exact_links(n: int, per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches, ["key", "i", "j"]):
            groups, side = _joined(rows)
            made = link_exact(list(shingle_sets(pa.array(rows["text"], pa.string()), n)), groups, per_cent, side)
            yield _batch(_spokes(made, groups, rows["node"]))

    return run


def _in_blocks(rows: DataFrame, counts: DataFrame, block: int, pairs: str) -> DataFrame:
    """rows (key, node, label, ...) dealt to tasks (key, i, j): blocks of a key's rows by hash, `pairs` of blocks.

    pairs: "own" (i = j only), "first" (also with block 0) or "all".  side: 0 or 1 for block i or j, -1 if i = j.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    rows = rows.join(counts.select("key", "members"), "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(-1).alias("side")))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
    pair = lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"), (k < F.col("block")).cast("int").alias("side"))
    if pairs == "own":
        to = own
    elif pairs == "first":
        to = F.concat(own, F.transform(F.filter(others, lambda k: (k == 0) | (F.col("block") == 0)), pair))
    else:
        to = F.concat(own, F.transform(others, pair))
    return rows.withColumn("to", F.explode(to)).select("*", "to.i", "to.j", "to.side").drop("to", "members", "blocks", "block")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _relabel(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (node, ...) with the label of each node, itself where labels has none."""
    return rows.join(labels.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").withColumn("label", F.coalesce("label", "node")).drop("n2")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the 64-bit hashes in column h, at most FILTER_MOST_BITS; a full filter only keeps more."""
    size = 1 << 10
    need = FILTER_BITS_EACH * ids.count()
    while size < min(need, FILTER_MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), size):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = bits.view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    out = np.zeros(size // 64, np.int64)
    found = ids.select("h").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return out.view(np.uint8)


def _places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.astype(np.int64).view(np.uint64)
    return (u & np.uint64(size - 1)).astype(np.int64), ((u * _A >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)


def similar_documents(spark: SparkSession, docs: DataFrame, n: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (the smallest id that links reach, its own included).

    Documents link when their sets of word n-grams have a Jaccard similarity of per_cent / 100 or more.  A-Z are
    lowered, words are parted by ASCII white space, and a document of fewer than n words has its whole sequence as
    its one element.  Null, empty and blank texts have no elements and link with nothing: their component is their
    own id.  Rows with a null id take part with the null left out of the smallest (null if they are alone); rows
    that repeat an id keep their own texts.  Other columns are ignored; an empty table gives no rows.
    """
    ws = Workspace(spark, "ngram-join")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    often = texts.select("text").mapInArrow(_frequent(n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = _order_table(ws.save(often, "often"))
    ws.drop("often")
    wide = ws.save(texts.mapInArrow(_signatures(n, per_cent, table), f"doc_id {kind}, h1 long, h2 long, size long, keys array<long>, bits binary"), "signatures")
    sig = ws.save(wide.select("doc_id", "h1", "h2", "size"), "sig")
    any_of = [F.first(x).alias(x) for x in ("size", "keys", "bits")]
    # F.first of equal values: the partial aggregate leaves one row per set and task before the shuffle.
    nodes = wide.where("size > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), *any_of)
    nodes = ws.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    ws.drop("signatures")
    ws.release()
    # Of a similar pair the smaller set has the shared element early: within its size less the least overlap of sets
    # of that size and up, which is 2t / (1 + t) of it.  Elements that no set has early can't bring a pair together.
    early = F.col("at") <= F.floor(F.col("size") * (100 - per_cent) / (100 + per_cent))
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("at", "key")).select("node", "size", "key", early.alias("early"))
    met = keyed.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("members"), F.max("early").alias("any_early")).where("members > 1 AND any_early")
    met = ws.save(met.select("key", "center", "members"), "met")
    shared = ws.save(keyed.join(met.select("key"), "key", "left_semi"), "shared")

    ws.release()
    facts = nodes.select("node", "size", "bits")
    star = shared.join(met, "key").groupBy("node").agg(F.min("center").alias("center")).where("center < node")
    star = star.join(facts.select("node", F.col("size").alias("size_a"), F.col("bits").alias("bits_a")), "node")
    star = star.join(facts.select(F.col("node").alias("center"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b")), "center")
    maybe = star.select(F.col("node").alias("a"), F.col("center").alias("b"), "size_a", "size_b", "bits_a", "bits_b").mapInArrow(_allowed(per_cent), "a long, b long")
    maybe = ws.save(maybe, "maybe-1")
    near = roots(maybe.select(F.col("a").alias("node"), F.col("b").alias("label")), ws, "near-1")

    labelled = _relabel(shared, near)
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    # An element's sets by size class: similar sets lie in one class or in neighbouring ones, and the smaller, early one
    # of a pair is met in its own class.
    step = math.log(100 / per_cent) * 1.0001
    place = F.floor(F.log("size") / step)
    sized = labelled.join(open_keys, "key", "left_semi").select("node", "label", "key", F.explode(F.array(F.struct(place.alias("place"), F.col("early")), F.struct((place - 1).alias("place"), F.lit(False).alias("early")))).alias("x"))
    sized = ws.save(sized.select(F.xxhash64("key", "x.place").alias("key"), "node", "label", "x.early"), "sized")
    # Elements met by the same classes (those of a shared passage, say) are one group: the first stands for all.
    groups = sized.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max("early").alias("any_early"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")
    )
    open_keys = ws.save(groups.where("low < high AND any_early").groupBy("members", "x1", "x2").agg(F.min("key").alias("key")), "open-keys")
    open_rows = sized.drop("early").join(open_keys.select("key"), "key", "left_semi").join(facts, "node")
    more = _dealt(_in_blocks(open_rows, open_keys, BLOCK_HASHED, "all")).mapInArrow(_hashed_links(per_cent), "a long, b long")
    more = ws.save(more, "maybe-2")
    for table_name in ("met", "shared", "sized", "open-keys"):
        ws.drop(table_name)
    candidates = extended(near, more, ws, "near-2").withColumnRenamed("label", "key")
    ws.release()
    sizes = ws.save(candidates.groupBy("key").agg(F.count("*").alias("members")), "candidate-sizes")

    chosen = candidates.join(nodes.select("node", "first_id", "h1", "h2"), "node")
    kept = _filter_of(chosen.select(F.xxhash64("first_id").alias("h")))
    bits = len(kept) * 8

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [(kept[x >> 3] >> (x & 7)) & 1 for x in _places(batch.column("h").to_numpy(), bits)]
            batch = batch.filter(pa.array((at[0] & at[1]).astype(bool)))
            digests = [_digest(s) for s in shingle_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([x for x, _ in digests], pa.int64()), pa.array([x for _, x in digests], pa.int64())], ["doc_id", "text", "h1", "h2"])

    likely = texts.withColumn("h", F.xxhash64("doc_id")).mapInArrow(pick, f"doc_id {kind}, text string, h1 long, h2 long")
    # Rows that repeat an id may have other texts; the digest of the set says which is meant.
    wanted = chosen.join(likely, ["h1", "h2"]).where("doc_id <=> first_id").select("key", "node", "text")
    wanted = ws.save(wanted, "candidate-texts")
    labels = None
    for step, pairs in (("own", "first"), ("rest", "all")):
        rows = wanted.withColumn("label", F.col("node")) if labels is None else _relabel(wanted, labels)
        counts = sizes
        if labels is not None:
            counts = sizes.where(F.col("members") > BLOCK_EXACT).join(_relabel(candidates, labels).groupBy("key").agg(F.countDistinct("label").alias("parts")).where("parts > 1"), "key")
            if counts.isEmpty():
                break
        made = ws.save(_dealt(_in_blocks(rows, counts, BLOCK_EXACT, pairs)).mapInArrow(_exact_links(n, per_cent), "a long, b long"), f"links-{step}")
        labels = components(made, ws, f"linked-{step}") if labels is None else extended(labels, made, ws, f"linked-{step}")
    least = _relabel(nodes.select("node", "first_id", "h1", "h2"), labels)
    least = least.join(least.groupBy("label").agg(F.min("first_id").alias("component_id")), "label").select("h1", "h2", "component_id")
    out = sig.select("doc_id", "h1", "h2", F.col("size").alias("n_shingles")).join(least, ["h1", "h2"], "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
