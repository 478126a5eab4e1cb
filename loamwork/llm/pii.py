"""Personal data by weak supervision: exact base patterns, and a span classifier for what they miss.

Base spans follow fixed patterns and always stay.  Wider patterns propose more spans (other spellings of the same
kinds).  Labelers (patterns, gazetteers, checksums and words of the context) vote for, against or not at all on
every span, base ones among them.  Expectation-maximisation estimates how often each labeler is right and how
likely each pattern of votes is personal data; a logistic span classifier is trained on those probabilities and
decides which proposals are added.  Votes and features are few and discrete, so the corpus is summed up as counts
per pattern: all spans take part and the driver's table is bounded by the number of patterns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: A proposal is added from this probability on.
ADD_FROM = 0.9
ROUNDS = 100

# The base patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider patterns for proposals.
_SPELLED_EMAIL = re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>]) ?[A-Za-z0-9-]{2,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}[./_\u00a0\u2013][0-9]{4}[./_\u00a0\u2013][0-9]{4}[./_\u00a0\u2013][0-9]{1,7}(?![0-9.])")
_WORDED_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{2,63})+(?![A-Za-z0-9-])")
_ZERO_PHONE = re.compile(r"(?<![0-9A-Za-z+(.-])00[1-9][0-9]{0,2}(?:[ .-]\(?[0-9]{2,5}\)?){2,5}(?![0-9A-Za-z-])")
_SHORT_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
_BRACKET_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9.])")

# Gazetteers.
_TLDS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "info", "biz", "us", "ca", "nl", "ch", "at", "be", "se", "pl", "ru", "cn", "jp", "in", "br", "mx"}
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "22", "23", "24", "25", "26", "27", "62")
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91")
_CONTEXT = {
    "email": ("mail", "contact", "write to", "address", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "login", "address", "from", "network"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta", "amex"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "cell", "contact", "reach"),
}
_AGAINST = ("version", "release", "isbn", "issn", "doi", "build", "section", "invoice", "order no", "serial", "sku", "part no")


_UNBRACKETED = str.maketrans("", "", "[]()")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    start, at = 0, text.find("@")
    while at >= 0:
        run = text[start:at]
        size = len(run) - len(run.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if size else None
        if found:
            yield at - size, found.end()
        start = found.end() if found else at + 1
        at = text.find("@", start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; leftmost and without overlap within a kind."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _HAS_DIGIT(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


_HAS_DIGIT = re.compile("[0-9]").search


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the wider patterns that overlap no base span nor one another, by kind and start."""
    found = [(0, *m.span()) for m in _SPELLED_EMAIL.finditer(text)] if any(x in text for x in "[({<") else []
    if " dot " in text or " DOT " in text:
        found += [(0, *m.span()) for m in _WORDED_EMAIL.finditer(text)]
    if _HAS_DIGIT(text):
        found += [(1, *m.span()) for m in _LONG_IP.finditer(text)] if ":" in text else []
        found += [(1, *m.span()) for m in _SHORT_IP.finditer(text) if m[0].count(":") >= 3 and _HAS_DIGIT(m[0])] if "::" in text else []
        found += [(1, *m.span()) for m in _BRACKET_IP.finditer(text) if all(int(x) <= 255 for x in re.findall("[0-9]+", m[0]))]
        found += [(2, *m.span()) for m in _DOTTED_CARD.finditer(text)]
        found += [(3, *m.span()) for p in (_LOCAL_PHONE, _ZERO_PHONE) for m in p.finditer(text)]
    # Disjoint taken spans in order, so that a new one is compared with its two neighbours alone.
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for kind, a, b in sorted(found):
        at = bisect_left(starts, b)
        if not at or ends[at - 1] <= a:
            out.append((kind, a, b))
            starts.insert(at, a)
            ends.insert(at, b)
    return out


LABELERS = ("shape", "gazetteer", "checksum", "context", "against", "border")


def votes(text: str, kind: int, a: int, b: int) -> tuple[int, ...]:
    """Votes of LABELERS on a span: 1 for personal data, -1 against, 0 none."""
    span, before = text[a:b], text[max(0, a - 40) : a].lower()
    d = digits_of(span)
    if kind == 0:
        shape = 1 if "@" in span else 0
        last = re.split(r"[^A-Za-z0-9]+", span.strip("])}> "))[-1].lower()
        gazetteer, checksum = (1 if last in _TLDS else -1), 0
    elif kind == 1:
        plain = span.translate(_UNBRACKETED)
        shape = 1 if plain.count(".") == 3 or plain.count(":") == 7 or "::" in plain else -1
        private = plain.startswith(("0.", "127.", "255.", "1.0.", "2.0."))
        gazetteer, checksum = (-1 if private else 1), 0
    elif kind == 2:
        shape = 1 if len(d) in (15, 16) else 0
        gazetteer, checksum = (1 if d.startswith(_ISSUERS) else -1), (1 if luhn(d) else -1)
    else:
        shape = 1 if span.startswith("+") or re.fullmatch(r"\(?[0-9]{3}\)?[ .-]+[0-9]{3}[ .-][0-9]{4}", span) or span.startswith("00") and 9 <= len(d) - 2 <= 15 else 0
        called = d if span.startswith("+") else d[2:] if span.startswith("00") else ""
        gazetteer = 1 if called.startswith(_CALLING) or not called and d[:1] in "23456789" else -1
        checksum = -1 if len(set(d)) == 1 else 0
    context = 1 if any(x in before for x in _CONTEXT[KINDS[kind]]) else 0
    against = -1 if any(x in before for x in _AGAINST) else 0
    edges = text[a - 1 : a] + text[b : b + 1]
    border = -1 if any(x.isalnum() for x in edges) else 1
    return shape, gazetteer, checksum, context, against, border


def pattern_of(text: str, kind: int, a: int, b: int, is_base: bool) -> str:
    """What labelers and the classifier see of a span, as a short string: kind, origin, length class, votes."""
    size = min(7, len(digits_of(text[a:b])) // 3)
    return f"{kind}{int(is_base)}{size}" + "".join("-0+"[v + 1] for v in votes(text, kind, a, b))


class SpanModel:
    """Fits EM over votes and the span classifier on counts per pattern; probability(pattern) answers for a span.

    counts: pattern -> spans.  The base pattern is itself a labeler that is never against.  Without spans every
    probability is 0.
    """

    def __init__(self, counts: dict[str, int]):
        self.patterns = sorted(counts)
        n = np.array([counts[p] for p in self.patterns], float)
        self.reliability: dict[str, tuple[float, float]] = {}
        self.weights = np.zeros(0)
        if not len(n):
            return
        v = np.array([self._votes(p) for p in self.patterns], float)
        p = np.clip(0.5 + 0.12 * v.sum(axis=1), 0.05, 0.95)  # start from the majority
        for _ in range(ROUNDS):
            # Chance that a labeler votes for, or against, given the truth; the +1s keep rare votes from certainty.
            rates = []
            for truth, leaning in ((p, 1), (1 - p, -1)):
                mass = (n * truth)[:, None]
                rates.append({x: ((mass * (v == x)).sum(axis=0) + (2 if x == leaning else 1)) / (mass.sum() + 4) for x in (1, -1)})
            prior = (n @ p + 1) / (n.sum() + 2)
            score = np.full(len(n), np.log(prior / (1 - prior)))
            for x in (1, -1):  # a missing vote says nothing
                score += ((v == x) * np.log(rates[0][x] / rates[1][x])).sum(axis=1)
            after = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            moved, p = np.abs(after - p).max(), after
            if moved < 1e-9:
                break
        for k, name in enumerate((*LABELERS, "base")):
            said = v[:, k] != 0
            right = (n * said * np.where(v[:, k] > 0, p, 1 - p)).sum()
            self.reliability[name] = float((right + 1) / ((n * said).sum() + 2)), float((n * said).sum() / n.sum())
        self.posterior = dict(zip(self.patterns, p.tolist(), strict=True))
        self._fit(n, p)

    @staticmethod
    def _votes(pattern: str) -> list[int]:
        return [*("-0+".index(x) - 1 for x in pattern[3:]), int(pattern[1])]

    @staticmethod
    def _features(pattern: str) -> np.ndarray:
        kind, size = int(pattern[0]), int(pattern[2])
        v = np.array(SpanModel._votes(pattern)[:-1], float)  # not the base: proposals are judged by what they share with it
        by_kind = np.zeros((len(KINDS), len(v)))
        by_kind[kind] = v
        return np.concatenate([[1.0], np.eye(len(KINDS))[kind], np.eye(8)[size], v, by_kind.ravel()])

    def _fit(self, n: np.ndarray, p: np.ndarray) -> None:
        x = np.array([self._features(s) for s in self.patterns])
        w, mass = np.zeros(x.shape[1]), n / n.sum()
        ridge = np.full(x.shape[1], 1e-3)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (mass * (q - p)) + ridge * w
            h = (x * (mass * q * (1 - q))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h, g)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w

    def probability(self, pattern: str) -> float:
        if not len(self.weights):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self._features(pattern) @ self.weights, -30, 30))))


def _found(texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    for text in texts:
        base = base_spans(text)
        yield base, proposals(text, base)


_SPANS = "array<struct<kind:int,first:int,beyond:int,pattern:string>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("beyond", pa.int32()), ("pattern", pa.string())]))


def span_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and more (spans with their patterns) of each row of docs; null texts count as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns: list[list] = [[], []]
            for text, both in zip(texts, _found(texts), strict=True):
                for column, spans, is_base in zip(columns, both, (True, False), strict=True):
                    column.append([{"kind": k, "first": a, "beyond": b, "pattern": pattern_of(text, k, a, b, is_base)} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, _SPANS_ARROW) for x in columns)], ["doc_id", "base", "more"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, base {_SPANS}, more {_SPANS}")


def fit(spans: DataFrame) -> SpanModel:
    """The span model of a span table: counts per pattern over all its spans."""
    patterns = spans.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.pattern").count()
    return SpanModel({r["pattern"]: r["count"] for r in patterns.collect()})


def _keyed(kind: int, a: int, b: int) -> str:
    return f"{KINDS[kind]}:{a}:{b}"


def personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, counts and digest of the base spans, and all spans (base and added).

    n_email, n_ip, n_card and n_phone count base spans; base_sha256 is the digest of their list and spans the list
    of all, as kind:start:end by kind, start; n_spans counts all of them.  Null and empty texts have none; null ids and repeated rows stay;
    other columns are ignored; an empty table gives no rows.  The texts are read once: spans are a written table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = Workspace(spark, "pii").save(span_table(docs), "spans")
    model = fit(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [(x["kind"], x["first"], x["beyond"]) for x in base]
                added = [(x["kind"], x["first"], x["beyond"]) for x in more if model.probability(x["pattern"]) >= ADD_FROM]
                for k in range(4):
                    out[k].append(sum(x[0] == k for x in own))
                out[4].append(hashlib.sha256(",".join(_keyed(*x) for x in own).encode()).hexdigest())
                out[5].append(",".join(_keyed(*x) for x in sorted(own + added)))
                out[6].append(len(own) + len(added))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:6]), pa.array(out[6], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return spans.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the kind of its first, as <EMAIL>."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data in the texts masked; same columns and rows, null texts stay null."""
    model = fit(span_table(docs.select(F.lit(0).alias("doc_id"), text_col), text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            new = []
            for text, (base, more) in zip(texts, _found([x or "" for x in texts]), strict=True):
                spans = base + [x for x in more if model.probability(pattern_of(text, *x, False)) >= ADD_FROM]
                new.append(masked(text, spans) if spans else text)
            columns = batch.columns
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
