"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled pair (good, bad) is a preference.  The chance that one document is preferred is the logistic function
of the difference of their scores, and a score is linear in features of the text, so training is logistic loss on
feature differences.  The threshold is the quantile of the scores of all usable labelled documents that leaves as
many of them below it as are labelled bad; scores around it are scaled to probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty
from .units import slices

#: Bound of the labelled rows used for fitting, of each label: the first by a hash of the id.
SAMPLE_EACH = 3_000
PAIRS, STEPS, RIDGE, SEED = 60_000, 300, 1e-3, 7
#: Bins in which the scores of all usable labelled rows are counted: the bound of the driver's table, at any size.
BINS = 1 << 16


def features(text: str) -> np.ndarray:
    """Shares of the bytes, and marks of form: sizes, case, repetition.  Any text, the empty one too, has them."""
    data = text.encode()
    n = max(1, len(data))
    bins = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words, lines = text.split(), text.split("\n")
    count, most = len(words), max(Counter(words).values(), default=0)
    upper, lower = bins[65:91].sum(), bins[97:123].sum()
    form = [
        np.log1p(len(data)), np.log1p(count), len(text) / max(1, count) if count else 0.0, len(set(words)) / max(1, count), most / max(1, count),
        len(lines) / max(1, count), len(set(lines)) / len(lines), upper / max(1e-9, upper + lower), bins[48:58].sum(), bins[128:].sum(),
        bins[33:48].sum() + bins[58:65].sum() + bins[91:97].sum() + bins[123:127].sum(), float(not words),
    ]
    return np.concatenate([np.sqrt(bins), form])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    low: float = 0.0
    width: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; 0.5 is the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold), -30, 30)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of raw scores, the outermost ones for all beyond."""
        return np.clip((self.raw(x) - self.low) // self.width, 0, BINS - 1).astype(np.int32)

    def placed(self, counts: dict[tuple[int, int], int]) -> Model:
        """This model with its threshold and slope by the counts of labelled rows, by label (0 or 1) and bin."""
        at = sorted({b for _, b in counts})
        if not at:
            return self
        values = self.low + self.width * (np.array(at) + 0.5)
        bad, good = (np.array([counts.get((y, b), 0) for b in at], float) for y in (0, 1))
        k = min(int(np.searchsorted(np.cumsum(bad + good), bad.sum() - 0.5)), len(at) - 1)
        threshold = float((values[k] + values[min(k + 1, len(at) - 1)]) / 2)
        slopes = np.geomspace(0.05, 20, 60)
        loss = [(good * np.logaddexp(0, -a * (values - threshold)) + bad * np.logaddexp(0, a * (values - threshold))).sum() for a in slopes]
        return replace(self, threshold=threshold, slope=float(slopes[int(np.argmin(loss))]))


def fit(good: np.ndarray, bad: np.ndarray) -> Model:
    """The ranking by features of good and bad documents; its threshold is yet to be placed.

    Without examples of either kind nothing can be ranked: every score is 0.5 then, and there are no bins.
    """
    size = good.shape[1] if good.size else bad.shape[1] if bad.size else len(features(""))
    if not len(good) or not len(bad):
        return Model(np.zeros(size), np.ones(size), np.zeros(size), 0.0, 1.0)
    both = np.concatenate([good, bad])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-6] = np.inf  # a feature that never varied tells nothing
    g, b = (good - mean) / scale, (bad - mean) / scale
    rng = np.random.default_rng(SEED)
    better, worse = rng.integers(len(g), size=PAIRS), rng.integers(len(b), size=PAIRS)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        at = rng.integers(PAIRS, size=2048)
        rows = g[better[at]] - b[worse[at]]  # a step's pairs alone: all of them would fill the driver
        miss = 1 / (1 + np.exp(np.clip(rows @ w, -30, 30)))
        slope = -(miss @ rows) / len(rows) + RIDGE * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        w = w - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    values = np.concatenate([g @ w, b @ w])
    low, high = float(values.min()), float(values.max())
    span = max(high - low, 1e-6)
    return Model(mean, scale, w, 0.0, 1.0, low - span, 3 * span / BINS)


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, each: int = SAMPLE_EACH) -> Model:
    """Fits on the labelled rows of docs where `usable` (a condition on labels) holds.

    Null ids and null labels are left out, an id with several labels counts as its largest.  The ranking is learnt
    from a sample of `each` ids of each label at most, so it is broadcast to find their texts; an id's features come
    to the driver once, however often its row is repeated (of different texts, the least features).  Threshold and
    slope are placed by all usable labelled rows: each is scored and counted by label and bin.
    """
    usable_labels = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    sample = [usable_labels.where(F.col("y") == y).orderBy(*order).limit(each) for y in (0, 1)]
    texts = docs.select("doc_id", text_or_empty())
    chosen = texts.join(F.broadcast(sample[0].union(sample[1])), F.col("doc_id") == F.col("label_id")).select("label_id", "y", "text")
    kind = chosen.schema["label_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary())], ["label_id", "y", "x"])

    found = chosen.mapInArrow(run, f"label_id {kind}, y int, x binary").groupBy("label_id", "y").agg(F.min("x").alias("x"))
    rows = sorted((r["y"], bytes(r["x"])) for r in found.collect())
    size = len(features(""))
    of = lambda y: np.array([np.frombuffer(x, np.float32) for label, x in rows if label == y], np.float64).reshape(-1, size)
    model = fit(of(1), of(0))
    if not model.width:
        return model

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                bins = model.bins(np.array([features(t) for t in texts[a:b]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(bins)], ["doc_id", "bin"])

    placed = texts.mapInArrow(ranked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bin int")
    counts = placed.join(usable_labels, F.col("doc_id") == F.col("label_id")).groupBy("y", "bin").count()
    return model.placed({(r["y"], r["bin"]): r["count"] for r in counts.collect()})


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (1 if score >= 0.5); null texts count as empty.

    `names` are the two columns' names, which docs may not have yet: ValueError.  All rows and other columns stay.
    """
    if {x.lower() for x in names} & {x.lower() for x in docs.columns}:
        raise ValueError(f"docs have columns named {names} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                s = model.scores(np.array([features(t) for t in texts[a:b]]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
