"""Benchmark decontamination: windows of benchmark items found in documents by an FM-index per shard.

Windows are 10 words in a row (a shorter item is one window).  Words outside the items' vocabulary can be in no
window, so a shard's index holds only the runs of known words that are long enough.  Documents never move: each
task cuts its own rows into shards.  Items are handed to the tasks in blocks of bounded size, one pass per block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .fm_index import FMIndex
from .units import slices

WINDOW = 10
#: Text of the items handed to the tasks at a time: some 100 MB on the driver, 300 MB if no word comes twice.
BLOCK_BYTES = 8 << 20
#: Text that a task takes together, words of an index, and windows searched at a time.
SHARD_CHARS, SHARD_WORDS, PATTERNS = 1 << 23, 1 << 20, 1 << 15
#: a-z, 0-9 and all beyond ASCII are parts of words; A-Z are lowered.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def _in_order(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


class Windows:
    """The windows of a block of items, by length: where each distinct one starts in the items' words, and whose it is.

    Some 20 bytes a word of the items beside the vocabulary; rows of words are made a few thousand windows at a time.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.names = _in_order({item for item, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        parts, starts, owners, sizes, at = [], [], [], [], 0
        for item, text in items:
            own = words_of(text)
            if not own:
                continue
            parts.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own), np.int32, len(own)))
            size = min(window, len(own))
            many = len(own) - size + 1
            starts.append(np.arange(at, at + many, dtype=np.int64))
            owners.append(np.full(many, place[item], np.int32))
            sizes.append(np.full(many, size, np.int16))
            at += len(own)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        start, owner, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, owners, sizes))
        self.groups = [(int(k), *self._distinct(start[size == k], owner[size == k], int(k))) for k in np.unique(size)]
        self.shortest, self.longest = (self.groups[0][0], self.groups[-1][0]) if self.groups else (0, 0)

    def _distinct(self, start: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of distinct windows, where each one's owners begin, and the owners.  Windows whose hashes meet are compared
        word by word; different ones with the same hash may stand more than once, which changes no result."""
        key = np.zeros(len(start), np.uint64)
        for k in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + self.words[start + k].astype(np.uint64)
        order = np.lexsort((owner, key))
        start, owner, key = start[order], owner[order], key[order]
        same = np.zeros(len(start), bool)
        same[1:] = key[1:] == key[:-1]
        for k in range(size):
            same[1:] &= self.words[start[1:] + k] == self.words[start[:-1] + k]
        again = same.copy()
        again[1:] &= owner[1:] == owner[:-1]
        kept = ~again
        begins = np.flatnonzero(~same[kept])
        return start[kept][begins], np.append(begins, int(kept.sum())), owner[kept]

    def scan(self, texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, set[str | None]]]:
        """For each document (a list of words): which words are hit, and the items with windows in it."""
        sizes = np.array([len(x) for x in texts], np.int64)
        text_ends = np.cumsum(sizes)
        starts = text_ends - sizes
        total = int(sizes.sum())
        get = self.vocabulary.get
        known = np.fromiter((get(w, 0) for x in texts for w in x), np.int64, total)
        # Runs of known words within a document, long enough for the shortest window.
        inside = np.concatenate([[0], (known > 0).astype(np.int8), [0]])
        cut = np.zeros(total + 1, bool)
        cut[starts[starts < total]] = True
        edge = np.flatnonzero((np.diff(inside) != 0) | (cut & (inside[1:] > 0) & (inside[:-1] > 0)))
        begin = edge[(edge < total) & (known[np.minimum(edge, max(total - 1, 0))] > 0)] if total else edge[:0]
        finish = edge[(edge > 0) & (known[np.maximum(edge - 1, 0)] > 0)] if total else edge[:0]
        long = finish - begin >= max(self.shortest, 1)
        begin, finish = begin[long], finish[long]
        change = np.zeros(total + 1, np.int64)
        items: list[set[str | None]] = [set() for _ in texts]
        for first, beyond in self._shards(begin, finish):
            spans = beyond - first + 1
            ends = np.cumsum(spans)
            place = np.arange(int(ends[-1])) - np.repeat(ends - spans, spans) + np.repeat(first, spans)
            stop = np.zeros(len(place), bool)
            stop[ends - 1] = True
            index = FMIndex(np.where(stop, 0, known[np.minimum(place, total - 1)]))
            for size, firsts, offsets, owners in self.groups:
                for k in range(0, len(firsts), PATTERNS):
                    low, high = index.search(self.words[firsts[k : k + PATTERNS, None] + np.arange(size)].astype(np.int64))
                    found = np.flatnonzero(high > low)
                    count = (high - low)[found]
                    if not len(found):
                        continue
                    which = np.repeat(found, count) + k
                    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[found], count)
                    at = place[index.locate(rows)]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size, -1)
                    doc = np.searchsorted(text_ends, at, side="right")
                    for pair in np.unique(doc * len(firsts) + which).tolist():
                        own = owners[offsets[pair % len(firsts)] : offsets[pair % len(firsts) + 1]]
                        items[pair // len(firsts)].update(self.names[x] for x in own.tolist())
        hit = np.cumsum(change[:-1]) > 0
        for a, n, own in zip(starts.tolist(), sizes.tolist(), items, strict=True):
            yield hit[a : a + n], own

    def _shards(self, begin: np.ndarray, finish: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The runs in shards of about SHARD_WORDS; a longer run is cut, with so many words in both parts that no window is lost."""
        step = max(SHARD_WORDS, 2 * self.longest)
        if len(begin) and int((finish - begin).max()) > step:
            pieces = [(a, min(a + step, b)) for x, b in zip(begin.tolist(), finish.tolist(), strict=True) for a in range(x, max(x + 1, b - self.longest + 1), step - self.longest + 1)]
            begin, finish = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        sizes, at = np.cumsum(finish - begin + 1), 0
        while at < len(begin):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + step, side="right")))
            yield begin[at:end], finish[at:end]
            at = end


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, unnamed: bool) -> Iterator[tuple[int, int, list[tuple[str | None, str]]]]:
    """Items as (block, blocks, list of (id, text)) of at most about BLOCK_BYTES each; an item longer than that is a block.

    unnamed: whether items without an id are among them.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), text_or_empty(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = 1 + total // BLOCK_BYTES
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield k, blocks, [(r["i"], r["t"]) for r in own.collect() if unnamed or r["i"] is not None]


def _written(ws: Workspace, state: DataFrame, block: int) -> DataFrame:
    """The state after a block that others follow, as a table: one block's windows are held at a time."""
    state = ws.save(state, f"block-{block}")
    if block:
        ws.drop(f"block-{block - 1}")
    return state


def _ranges(hit: np.ndarray) -> np.ndarray:
    """First and beyond-last places of the runs of hits, as one flat array."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, unnamed: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_words, hits (merged word ranges, flat: first, beyond last, ...), items (ids as
    strings, sorted)[, kept columns, the text among them as doc_text].

    Null and empty texts have no words; null item texts have no windows and items without an id are left out
    or, if `unnamed`, hit words under one null name (the last of the items); items that repeat an id count once; null ids and repeated rows of docs stay; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("doc_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = f"doc_id {kind}, doc_text string, n_words long, hits array<long>, items array<string>"
    ws = Workspace(docs.sparkSession, "windows")
    for block, blocks, items in _blocks(benchmark, item_col, item_text_col, unnamed):
        windows = Windows(items, window)

        def run(batches: Iterator[pa.RecordBatch], windows: Windows = windows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("doc_text").to_pylist()
                for a, b in slices(texts, SHARD_CHARS):
                    words = [words_of(x) for x in texts[a:b]]
                    part = batch.slice(a, b - a)
                    hits, found = [], []
                    for w, old, names, (hit, own) in zip(words, part.column("hits").to_pylist(), part.column("items").to_pylist(), windows.scan(words), strict=True):
                        for x, y in zip(old[::2], old[1::2], strict=True):
                            hit[x:y] = True
                        hits.append(_ranges(hit))
                        found.append(_in_order({*names, *own}))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("doc_text"), pa.array([len(x) for x in words], pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], ["doc_id", "doc_text", "n_words", "hits", "items"])

        state = state.mapInArrow(run, schema)
        state = _written(ws, state, block) if block < blocks - 1 else state
    return state


def contamination(docs: DataFrame, benchmark: DataFrame, unnamed: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see find_windows.

    A null name counts in n_items and is not in items_sha256.
    """
    found = find_windows(docs, benchmark, unnamed=unnamed)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: x - a)  # ranges alternate, so the signs work out
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_ranges(text: str, hits: list[int]) -> str:
    """The text without the words in the ranges, nor what stands between the words of a range."""
    data = text.encode()
    spans = [m.span() for m in _WORD.finditer(data.translate(_TO_WORDS))]
    out, at = [], 0
    for a, b in zip(hits[::2], hits[1::2], strict=True):
        out.append(data[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def remove_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """docs with the benchmark's passages cut from the texts; same columns and rows, null texts stay null.

    All windows of all items are found first, then cut at once, so the blocks in which items come make no difference.
    unnamed: whether items without an id count.  Documents keep what surrounds a passage; one that is nothing else is
    left with an empty text or bare marks.  Null ids and repeated rows stay as they are; an empty benchmark cuts nothing;
    no rows give no rows; other columns, of any name, go through.
    """
    hidden = "hits"
    while hidden in [x.lower() for x in docs.columns]:
        hidden += "_"
    state = docs.withColumn(hidden, F.array().cast("array<long>"))
    wide, names = state.schema, docs.columns
    ws = Workspace(docs.sparkSession, "passages")
    for block, blocks, items in _blocks(benchmark, "item_id", "text", unnamed):
        windows, last = Windows(items), block == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], windows: Windows = windows, last: bool = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = names.index(text_col)
                texts = batch.column(at).to_pylist()
                for a, b in slices([x or "" for x in texts], SHARD_CHARS):
                    part, own, hits = batch.slice(a, b - a), texts[a:b], []
                    columns = part.columns
                    for old, (hit, _) in zip(columns[-1].to_pylist(), windows.scan([words_of(x or "") for x in own]), strict=True):
                        for x, y in zip(old[::2], old[1::2], strict=True):
                            hit[x:y] = True
                        hits.append(_ranges(hit))
                    if last:
                        columns = columns[:-1]
                        columns[at] = pa.array([cut_ranges(x, h.tolist()) if len(h) else x for x, h in zip(own, hits, strict=True)], pa.string())
                    else:
                        columns[-1] = pa.array(hits, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(columns, names=names if last else [*names, hidden])

        state = state.mapInArrow(run, docs.schema if last else wide)
        state = state if last else _written(ws, state, block)
    return state
