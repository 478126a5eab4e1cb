"""Token counts at every prefix by dynamic programming over a BPE vocabulary.

For byte-pair encoding each prefix of a text has exactly one last token: the vocabulary entry ending there that
may follow the last token of the prefix before it.  Whether a token may follow another depends on the two alone
(encoding their concatenation gives them back), so count[i] = count[i - len(token)] + 1 gives the exact count
of every prefix in one pass.  No piece holds a space marker after another character, and a line feed is no piece,
so the pass runs per unit and each distinct unit is solved once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .units import slices

MARK = "▁"
#: Bounds of what one worker keeps; beyond them the later entries are forgotten.
CACHE_UNITS, KEPT_UNITS, CACHE_PAIRS = 400_000, 200_000, 1_000_000
_SEGMENT = re.compile(" +[^ \n]*|[^ \n]+|\n")


class PrefixCounter:
    """deltas(texts): for each text one signed byte per code point, the change of the token count there.

    The count of a prefix is the sum over its code points.  Begin and end tokens are not counted.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(MARK in x.lstrip(MARK) for x in self.rank) or any("\n" in x for x in self.rank):
            raise ValueError("the vocabulary has pieces across a space or line feed; units can't be solved apart")
        # Tokens by number: single characters, then the rest in the order in which merges make them.
        self.names = sorted(self.rank, key=lambda x: (len(x) > 1, self.rank[x]))
        self.number = {x: i for i, x in enumerate(self.names)}
        self.halves: list[tuple[int, int]] = []
        self.trie: dict = {}
        for i, name in enumerate(self.names):
            made = self._halves(name)
            self.halves.append(made or (i, i))
            if made is not None or len(name) == 1:  # a token that no merges reach never ends a prefix
                node = self.trie
                for ch in name:
                    node = node.setdefault(ch, {})
                node[""] = i
        self.pairs: dict[int, bool] = {}
        self.spaced: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def _halves(self, name: str) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins, or None."""
        parts = list(name)
        while len(parts) > 2:
            found = [(r, k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return None
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.number[parts[0]], self.number[parts[1]]) if len(parts) == 2 and all(x in self.number for x in parts) else None

    def _follows(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' text gives them back.

        No merge across the border may come before the merges that build the tokens: walk down the right edge
        of the left token and the left edge of the right one, latest merge first.
        """
        names, number, halves = self.names, self.number, self.halves
        limit = len(names)
        while True:
            joined = number.get(names[left] + names[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def counts(self, unit: str) -> list[int]:
        """Token counts of the prefixes of lengths 0, 1, ... of a unit in the model's own spelling."""
        n, width, pairs, trie = len(unit), len(self.names), self.pairs, self.trie
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        count: list[int] = [0] + [-1] * n
        last = [-1] * (n + 1)
        for j in range(n):
            before, c = last[j], count[j] + 1
            node = trie.get(unit[j])
            if node is None:  # not in the vocabulary: one token a byte
                count[j + 1] = c - 1 + len(unit[j].encode())
                continue
            i = j
            while node is not None:
                i += 1
                if count[i] < 0:
                    token = node.get("")
                    if token is not None:
                        if before < 0:
                            count[i], last[i] = c, token
                        else:
                            key = before * width + token
                            fits = pairs.get(key)
                            if fits is None:
                                fits = pairs[key] = self._follows(before, token)
                            if fits:
                                count[i], last[i] = c, token
                if i == n:
                    break
                node = node.get(unit[i])
        return count

    def _solve(self, unit: str, first: bool) -> bytes:
        """Deltas of a unit; the first unit of a text also answers for the space that the model puts before it."""
        normal = unit.replace(" ", MARK)
        counts = self.counts(MARK + normal if first else normal)
        if first and len(counts) > 2:
            del counts[1]
        return bytes([(b - a) & 255 for a, b in pairwise(counts)])

    def deltas(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) > CACHE_UNITS or len(self.other) > CACHE_UNITS:
            for cache in (self.spaced, self.other):
                for x in list(cache)[KEPT_UNITS:]:
                    del cache[x]
        return [self._text(x) for x in texts]

    def _text(self, text: str) -> bytes:
        if not text:
            return b""
        text = text.replace(MARK, " ")  # the model takes the mark itself for a space
        out = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(b"\x01")
            words = line.split(" ")
            if n == 0:
                head, rest = words[0], words[1:]
                if head == "":
                    # A leading space joins the model's own: solved as one unit.
                    segments = _SEGMENT.findall(line)
                    out += [self._solve(segments[0], True)] if segments else []
                    out += [self._other(x) for x in segments[1:]]
                    if not segments:
                        # The text starts with a line feed: the model's space stands alone before it.
                        out.append(None)
                    continue
                out.append(self._solve(head, True))
            else:
                if "" in words:
                    out += [self._other(x) for x in _SEGMENT.findall(line)]
                    continue
                out.append(self._other(words[0]))
                rest = words[1:]
            if "" in rest:
                out += [self._other(x) for x in _SEGMENT.findall(line)[1:]]
                continue
            cache = self.spaced
            found = list(map(cache.get, rest))
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        word = rest[i]
                        if word not in cache:
                            cache[word] = self._solve(" " + word, False)
                        found[i] = cache[word]
            out.append(b"".join(found))
        if out[0] is None:
            return b"\x02" + b"".join(out[2:])
        return b"".join(out)

    def _other(self, unit: str) -> bytes:
        known = self.other.get(unit)
        if known is None:
            known = self.other[unit] = self._solve(unit, False)
        return known


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_table(docs: DataFrame, model_path: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_deltas: bool = True) -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens, fit_chars and the prefix table (binary `deltas`).

    fit_chars is the length in code points of the longest prefix of at most `budget` tokens.  A null text counts
    as empty (0 tokens, empty table); null ids and repeated rows are kept as they are; other columns are ignored.
    Nothing is shuffled.  keep_deltas=False leaves the table out of the result, not out of the work.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, fit_chars long" + ", deltas binary" * keep_deltas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                part = texts[a:b]
                found = c.deltas(part)
                n = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in found]
                fits = [len(t) if k <= budget and len(t) <= budget else longest_prefix(x, budget) for t, x, k in zip(part, found, n, strict=True)]
                columns = [batch.column(0).slice(a, b - a), pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(n, pa.int64()), pa.array(fits, pa.int64())]
                names = [id_col, "n_bytes", "n_tokens", "fit_chars"]
                if keep_deltas:
                    columns.append(pa.array(found, pa.binary()))
                    names.append("deltas")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, schema)
