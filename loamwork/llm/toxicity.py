"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

All terms of the examples are indexed.  A term's weight is its idf, times a factor that grows with how much its presence
goes with the label in the examples (a z-score of the difference of shares), so cosines follow what matters more than
the topic.  The index holds the examples' normalised weights by term, and the largest weight of each term in each block
of examples.  Examples that are alike lie in one block, so that bounds are tight.  A query bounds every block by its
terms' largest weights, scores the blocks of the highest bounds, then those whose bounds can still reach the k-th best:
the k nearest are exact.  Queries go in batches.  Neighbours vote with their cosine; a logistic fit on leave-one-out
votes calibrates the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .units import slices, spans

#: Bound of the labelled rows used as examples, of each label: the first by a hash of the id.
EXAMPLES_EACH = 3_000
#: Fewer examples than this say nothing about how a term goes with the label.
LEAST_DF = 5
NEIGHBOURS, BLOCK, EVIDENCE = 25, 64, 3
#: Blocks scored first; then all that can still matter, at once.
FIRST_BLOCKS = 8
#: So many of the terms that more than 1 in 64 examples have also lie as dense rows, block by block.
DENSE_ROWS = 256
#: Queries answered at a time.
QUERIES = 48
#: Examples of one label whose sets of five words in a row are at least 4/5 alike (Jaccard) are one.
SHINGLE, ALIKE = 5, (4, 5)
_WORD = re.compile(r"\w+")
_MEMO = 1 << 16


def terms_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def factors(df: np.ndarray, positive: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Weight factors (at least 1) of terms found in df of n examples, in `positive` of the n1 with label 1."""
    n0 = n - n1
    gap = positive / max(1, n1) - (df - positive) / max(1, n0)
    pooled = df / max(1, n)
    z = gap / np.sqrt(pooled * (1 - pooled) * (1 / max(1, n1) + 1 / max(1, n0)) + 1e-12)
    return 1 + np.where((df >= LEAST_DF) & (min(n0, n1) > 0), np.round(z, 9) ** 2, 0)


def _alike_together(rows: np.ndarray) -> np.ndarray:
    """An order of rows in which each BLOCK in a row are alike: halves along the main direction, again and again."""
    todo, done = [np.arange(len(rows))], []
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            done.append(at)
            continue
        x = rows[at] - rows[at].mean(axis=0)
        v = x[int(np.argmax((x * x).sum(axis=1)))]
        for _ in range(10):
            v = x.T @ (x @ v)
            v = v / max(np.linalg.norm(v), 1e-12)
        order = at[np.argsort(np.round(x @ v, 9), kind="stable")]
        half = max(1, len(at) // BLOCK // 2) * BLOCK
        todo += [order[half:], order[:half]]
    return np.concatenate([*done, np.zeros(0, np.int64)]).astype(np.int64)


class Index:
    """Examples: ids, labels (0 or 1) and, as rows (doc, term, count) by example, the counts of vocabulary terms.

    weight: what an example of each label stands for.  by_label: whether a term's weight also says how it goes with the
    label (see factors); else it is plain idf.
    """

    def __init__(self, vocabulary: list[str], ids: list, labels: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, weight: tuple[float, float], by_label: bool = True):
        self.number = {t: i for i, t in enumerate(vocabulary)}
        n, terms = len(ids), len(vocabulary)
        labels = np.asarray(labels, np.int64)
        df = np.bincount(term, minlength=terms)
        self.weight = np.log((1 + n) / (1 + df)) + 1
        if by_label:
            self.weight = self.weight * factors(df, np.bincount(term, labels[doc], terms), n, int(labels.sum()))
        w = self._weights(doc, term, count, n)
        often = np.argsort(-df, kind="stable")[:DENSE_ROWS]
        often = often[df[often] * 64 > n]
        self.row = np.full(terms, -1, np.int16)
        self.row[often] = np.arange(len(often))
        dense = self._dense(doc, term, w, n)
        order = _alike_together(dense)
        self.ids, self.labels, self.dense = [ids[k] for k in order.tolist()], labels[order], np.ascontiguousarray(dense[order].T)
        self.mass = np.array(weight)[self.labels] if n else np.zeros(0)
        del dense
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        at = place[doc]
        by_doc = np.argsort(at, kind="stable")
        at, term, w = at[by_doc], term[by_doc].astype(np.int32), w[by_doc]
        del by_doc
        rare = np.flatnonzero(self.row[term] < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]  # by term, then by example
        own, self.at, self.w = term[rare], at[rare], w[rare]
        del rare
        # A segment is the postings of a term in a block.
        self.blocks = max(1, -(-n // BLOCK))
        key = own.astype(np.int64) * self.blocks + self.at // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.cuts = np.append(first, len(key)).astype(np.int32)
        self.block = (key[first] % self.blocks).astype(np.int32)
        self.largest = np.maximum.reduceat(self.w, first) if len(first) else np.zeros(0)
        self.segments = np.searchsorted(own[first], np.arange(terms + 1)).astype(np.int32)
        del key, first, own
        self.dense_largest = np.maximum.reduceat(self.dense, np.arange(0, n, BLOCK), axis=1) if n else np.zeros((len(often), 1))
        self.memo: dict[bytes, tuple] = {}
        self.base = float((self.mass * self.labels).sum() / self.mass.sum()) if self.mass.sum() else 0.0
        self.slope, self.offset = 1.0, 0.0
        self._calibrate(at, term, w)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def _weights(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        raw = (1 + np.log(count)) * self.weight[term]
        return raw / np.sqrt(np.bincount(doc, raw * raw, n))[doc]

    def _dense(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """The weights of the terms that have dense rows: a row for each of n documents."""
        row = self.row[term]
        out = np.zeros((n, int(self.row.max(initial=-1)) + 1))
        out[doc[row >= 0], row[row >= 0]] = w[row >= 0]
        return out

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (doc, term, weight) of the texts' terms that the vocabulary has; a text's vector has length 1."""
        words = [terms_of(x) for x in texts]
        number = np.fromiter(map(self.number.get, chain.from_iterable(words), repeat(-1)), np.int64, sum(map(len, words)))
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        size = max(1, len(self.number))
        pairs, count = np.unique((doc * size + number)[number >= 0], return_counts=True)
        doc, term = pairs // size, pairs % size
        return doc, term, self._weights(doc, term, count, len(texts))

    def nearest(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest examples of n queries: rows (query, example, cosine rounded to 12 digits) from the nearest down.

        Queries are rows (doc, term, weight) as vectors() gives them.  Ties go to the earlier example; examples of
        cosine 0 are never near.  without: an example that each query leaves out.
        """
        size, blocks = len(self.ids), self.blocks
        dense = self._dense(doc, term, w, n)
        rare = self.row[term] < 0
        low, high = self.segments[term[rare]], self.segments[term[rare] + 1]
        segment, query, weight = spans(low, high), np.repeat(doc[rare], high - low), np.repeat(w[rare], high - low)
        cell = query * blocks + self.block[segment]
        bounds = np.bincount(cell, weight * self.largest[segment], n * blocks).reshape(n, blocks) + dense @ self.dense_largest + 1e-9
        scores = np.zeros((n, size))
        seen = np.zeros((n, blocks), bool)
        if blocks > FIRST_BLOCKS:
            np.put_along_axis(seen, np.argpartition(-bounds, FIRST_BLOCKS - 1, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        want = seen if blocks > FIRST_BLOCKS else ~seen
        for last in (False, True):
            here = want.ravel()[cell]
            low, high = self.cuts[segment[here]], self.cuts[segment[here] + 1]
            place = spans(low, high)
            scores += np.bincount(np.repeat(query[here] * size, high - low) + self.at[place], np.repeat(weight[here], high - low) * self.w[place], n * size).reshape(n, size)
            for b in np.flatnonzero(want.any(axis=0)).tolist():
                rows, columns = np.flatnonzero(want[:, b]), slice(b * BLOCK, min(size, (b + 1) * BLOCK))
                scores[rows, columns] += dense[rows] @ self.dense[:, columns]
            if without is not None:
                scores[np.arange(n), without] = 0
            least = np.partition(scores, size - k, axis=1)[:, size - k] if size > k else np.zeros(n)
            if last or want.all():
                break
            want = (bounds > least[:, None]) & ~seen
        scores = np.round(scores, 12)
        query, at = np.nonzero((scores >= np.round(least, 12)[:, None]) & (scores > 0))
        cosine = scores[query, at]
        order = np.lexsort((at, -cosine, query))
        query, at, cosine = query[order], at[order], cosine[order]
        top = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[top], at[top], cosine[top]

    def _votes(self, query: np.ndarray, at: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
        """The weighted share of label 1 among the neighbours of each of n queries; without neighbours, of all examples."""
        w = self.mass[at] * cosine
        # One neighbour's worth of the base rate keeps few or far neighbours from certainty.
        prior = float(self.mass.mean()) * 0.5 if len(self.mass) else 1.0
        return (np.bincount(query, w * self.labels[at], n) + prior * self.base) / (np.bincount(query, w, n) + prior)

    def _calibrate(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        """Fits the score to the votes of the examples about each other; doc, term, weight: their rows by example."""
        if len(set(self.labels.tolist())) < 2:
            return
        votes = []
        for a in range(0, len(self.ids), QUERIES):
            b = min(len(self.ids), a + QUERIES)
            rows = slice(*np.searchsorted(doc, [a, b]).tolist())
            votes.append(self._votes(*self.nearest(doc[rows] - a, term[rows], w[rows], b - a, NEIGHBOURS, np.arange(a, b)), b - a))
        x, y, mass = self._logit(np.concatenate(votes)), self.labels, self.mass / self.mass.sum()
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps on the logistic loss, with a little pull to the identity
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(mass * (p - y) * x).sum() + 1e-3 * (a - 1), (mass * (p - y)).sum() + 1e-3 * b])
            v = mass * p * (1 - p)
            h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.offset = float(a), float(b)

    @staticmethod
    def _logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def _score(self, texts: list[str]) -> list[tuple[float, list]]:
        n = len(texts)
        query, at, cosine = self.nearest(*self.vectors(texts), n, NEIGHBOURS)
        p = 1 / (1 + np.exp(-(self.slope * self._logit(self._votes(query, at, cosine, n)) + self.offset)))
        first = np.searchsorted(query, np.arange(n + 1)).tolist()
        return [(x, [self.ids[i] for i in at[a : min(b, a + EVIDENCE)].tolist()]) for x, a, b in zip(p.tolist(), first, first[1:], strict=False)]

    def score(self, texts: list[str]) -> list[tuple[float, list]]:
        """The calibrated score and the ids of the nearest examples of each text; equal texts are searched once."""
        if not self.ids:
            return [(float(1 / (1 + np.exp(-(self.slope * self._logit(np.float64(self.base)) + self.offset)))), [])] * len(texts)
        if len(self.memo) + len(texts) >= _MEMO:
            self.memo.clear()
        keys = [xxhash.xxh3_128_digest(x.encode()) for x in texts]
        new = list({k: x for k, x in zip(keys, texts, strict=True) if k not in self.memo}.items())
        for a in range(0, len(new), QUERIES):
            part = new[a : a + QUERIES]
            self.memo.update(zip([k for k, _ in part], self._score([x for _, x in part]), strict=True))
        return [self.memo[k] for k in keys]


def distinct(ids: list, labels: list[int], shingles: list[np.ndarray]) -> list[int]:
    """Places of the examples that stay: in order of the id, those at least ALIKE to no earlier one that stays, of their
    label.  Each merge is decided by the whole sets (unique numbers).  Alike sets share one of the rarest elements of
    each, by which pairs are found.
    """
    part, whole = ALIKE
    ends = np.cumsum([0, *(len(x) for x in shingles)])
    values, inverse, df = np.unique(np.concatenate([*shingles, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(values))
    alone = int((df == 1).sum())  # elements of one example, of the lowest ranks, bring nothing together
    flat = rank[inverse]
    del values, inverse, df, rank
    sets = [np.sort(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    del flat
    owners: dict[tuple[int, int], list[int]] = {}
    stay = []
    for at in sorted(range(len(ids)), key=lambda k: (ids[k], sets[k].tobytes())):
        own = sets[at]
        n = len(own)
        prefix = [(labels[at], x) for x in own[: n - -(-part * n // whole) + 1].tolist() if x >= alone]
        for other in sorted({k for x in prefix for k in owners.get(x, ())}):
            m = len(sets[other])
            if whole * min(n, m) >= part * max(n, m):
                both = len(np.intersect1d(own, sets[other], assume_unique=True))
                if whole * both >= part * (n + m - both):
                    break
        else:
            stay.append(at)
            for x in prefix:
                owners.setdefault(x, []).append(at)
    return stay


def build(docs: DataFrame, labels: DataFrame, label: str, usable: Column, each: int = EXAMPLES_EACH, by_label: bool = True) -> Index:
    """The index of the labelled rows of docs where `usable` (a condition on labels) holds, at most `each` per label.

    Null ids and labels are left out; an id with several labels counts as its largest.  The sample is bounded, so
    it is broadcast to find its texts; all its term counts come to the driver.  Near copies of one label are one example
    (see distinct), so no group of copies outvotes the rest; their sets of shingles come to the driver too.  Without examples every score is 0.
    by_label: False for plain TF-IDF, without term weights learnt from the labels.
    """
    all_labels = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in all_labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = [all_labels.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    chosen = sample[0].union(sample[1]).withColumnRenamed("doc_id", "label_id")
    texts = docs.select("doc_id", text_or_empty()).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(t) for t in batch.column(2).to_pylist()]
            counts = [Counter(t) for t in terms]
            shingles = [list({xxhash.xxh64_intdigest(" ".join(t[k : k + SHINGLE])) - (1 << 63) for k in range(max(1, len(t) - SHINGLE + 1))}) for t in terms]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shingles, pa.list_(pa.int64())), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], ["label_id", "y", "shingles", "terms", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = texts.mapInArrow(run, f"label_id {kind}, y int, shingles array<long>, terms array<string>, n array<long>").toArrow().combine_chunks()
    ids, ys = table.column("label_id").to_pylist(), table.column("y").to_pylist()
    lists = table.column("shingles").combine_chunks()
    flat, own = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    stay = distinct(ids, ys, [flat[a:b] for a, b in zip(own, own[1:], strict=False)])
    terms, n = table.column("terms").combine_chunks(), table.column("n").combine_chunks().flatten().to_numpy()
    own = np.append(0, np.cumsum(terms.value_lengths().to_numpy()))
    coded = terms.flatten().dictionary_encode()
    del table, lists, flat, terms
    pa.default_memory_pool().release_unused()
    # One order of terms and examples, whatever order the rows came in.
    by_name = pc.sort_indices(coded.dictionary).to_numpy()
    vocabulary, number = coded.dictionary.take(pa.array(by_name)), np.empty(len(by_name), np.int64)
    number[by_name] = np.arange(len(by_name))
    codes = number.astype(np.int32)[coded.indices.to_numpy()]
    del coded, number
    rows = {}
    for k in stay:
        part = slice(own[k], own[k + 1])
        by_code = np.argsort(codes[part])
        rows[k] = codes[part][by_code], n[part][by_code]
    order = sorted(stay, key=lambda k: (xxhash.xxh64_intdigest(str(ids[k])), str(ids[k]), rows[k][0].tolist(), rows[k][1].tolist()))
    used, term = np.unique(np.concatenate([*(rows[k][0] for k in order), np.zeros(0, np.int32)]), return_inverse=True)
    count = np.concatenate([*(rows[k][1] for k in order), np.zeros(0, np.int64)])
    n1 = sum(ys[k] for k in order)
    weight = (totals.get(0, 0) / max(1, len(order) - n1), totals.get(1, 0) / max(1, n1))
    doc = np.repeat(np.arange(len(order), dtype=np.int64), [len(rows[k][0]) for k in order])
    names = vocabulary.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
    del rows, codes, n, own, vocabulary, used
    return Index(names, [ids[k] for k in order], np.array([ys[k] for k in order], np.int64), doc, term, count, weight, by_label)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5) and evidence (ids of the nearest examples) of each row of docs.

    A text that shares no term with any example, the null and the empty one too, gets a constant (by the rate of the
    label) and no evidence.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                found = index.score(texts[a:b])
                s = np.array([x for x, _ in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([x for _, x in found], pa.list_(batch.schema.field(0).type))], ["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<{kind}>")
