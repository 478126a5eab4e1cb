"""Exact tokenisation of long corpora by memoised units.

The byte-level and word-level vocabularies never merge across the place before a lone space or line feed, so
the ids of a text are the ids of its units in a row.  Texts are split and their units numbered in Arrow, each distinct
unit goes through the tokenizers library once per worker, and a take in Arrow puts the ids in a row.  Texts whose white
space leaves the rule open go through the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept per worker; beyond it the later (rarer) ones are forgotten, which bounds memory (to some 40 MB).
CACHE_UNITS = 1_200_000
KEPT_UNITS = 800_000
#: Units encoded as one text; the library slows down on longer ones.
TOGETHER = 64

_OTHER_SPACE = "[\t\r\v\f\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]"
_OTHER = re.compile(_OTHER_SPACE)
_SEGMENT = re.compile("[ \n]*[^ \n]+|[ \n]+")
_BARE = "\x00"
#: White space other than lone spaces and line feeds within a text.
_IRREGULAR = f"\\x00|[ \n][ \n]|^[ \n]|[ \n]$|{_OTHER_SPACE}"
_MARKS = ".,;:!?#$%&*|"
#: Letters whose lower case is one letter; that of U+0130 ends in a mark, which other marks join.
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def cuts(column: pa.Array) -> np.ndarray:
    """The places in the value buffer where the strings of an array start, and the last one's end."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


class UnitEncoder:
    """ids(texts): the library's ids of all texts in a row, as little-endian unsigned integers of `dtype`, and where each text's end.

    Known units and their ids are two Arrow columns, far smaller than Python objects.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.drops_space = drops_space
        self.units, self.unit_ids = pa.array([], pa.string()), pa.array([], pa.binary())
        # Ids that a unit's first (or, where spaces are dropped, last) token can have, and no other token of it.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        edge = [i for x, i in self.tokenizer.get_vocab().items() if (x.endswith("</w>") if drops_space else x.startswith("Ġ"))]
        self.edge[edge] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _source(self, unit: str) -> str:
        """A leading line feed of a unit stays, a leading space is implied, _BARE stands for no space."""
        if self.drops_space or unit[:1] == "\n":
            return unit
        return unit[1:] if unit[:1] == _BARE else " " + unit

    def _learn(self, units: pa.Array) -> pa.Array:
        """Ids of new units; those whose ids can be told apart by the ids alone go through the library many to a text."""
        if self.drops_space:
            joinable = pc.match_substring_regex(units, f"^[{_LETTER}]+$")
        else:
            joinable = pc.invert(pc.match_substring_regex(units, "^[\\x00\n]|<\\||^$"))
        joinable = joinable.to_numpy(zero_copy_only=False)
        names = units.to_numpy(zero_copy_only=False)
        out = np.empty(len(names), object)
        at, rest = np.flatnonzero(joinable), [np.flatnonzero(~joinable)]
        size = self.dtype.itemsize
        for a in range(0, len(at), TOGETHER * 256):
            groups = [at[k : k + TOGETHER] for k in range(a, min(a + TOGETHER * 256, len(at)), TOGETHER)]
            for own, ids in zip(groups, self._encode([" " + " ".join(names[x]) for x in groups]), strict=True):
                edges = np.flatnonzero(self.edge[np.frombuffer(ids, self.dtype)])
                if len(edges) != len(own):
                    rest.append(own)
                    continue
                ends = ((edges[:-1] + 1 if self.drops_space else edges[1:]) * size).tolist()
                out[own] = [ids[x:y] for x, y in zip([0, *ends], [*ends, len(ids)], strict=True)]
        for own in rest:
            if len(own):
                out[own] = self._encode([self._source(x) for x in names[own]])
        return pa.array(out, pa.binary())

    def _ids_of(self, units: pa.Array) -> pa.Array:
        """Ids of each unit of a column."""
        coded = units.dictionary_encode()
        names = coded.dictionary
        at = pc.index_in(names, value_set=self.units)
        if at.null_count:
            new = names.filter(pc.is_null(at))
            place = at.fill_null(-1).to_numpy().copy()
            place[place < 0] = len(self.units) + np.arange(len(new))
            at = pa.array(place)
            self.unit_ids = pa.concat_arrays([self.unit_ids, self._learn(new)])
            self.units = pa.concat_arrays([self.units, new])
        return self.unit_ids.take(at).take(coded.indices)

    def _distinct(self, units: pa.Array) -> pa.Array:
        """Ids of distinct units.  A word and the marks after it are always apart, so words are encoded without them."""
        words = pc.utf8_rtrim(units, characters=_MARKS)
        parted = pc.and_not(pc.match_substring_regex(words, f"[{_LETTER}]$"), pc.match_substring(units, "<|"))
        words = pc.if_else(parted, words, units)
        sizes = (pc.binary_length(units).to_numpy() - pc.binary_length(words).to_numpy()).astype(np.int64)
        if not sizes.any():
            return self._ids_of(words)
        ends = cuts(units)[1:].astype(np.int64)
        marks = np.frombuffer(units.buffers()[2], np.uint8)[spans(ends - sizes, ends)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        marks = pa.StringArray.from_buffers(len(units), pa.py_buffer(offsets), pa.py_buffer(marks))
        if not self.drops_space:
            marks = _joined(_BARE, marks)
        return pc.binary_join_element_wise(self._ids_of(words), self._ids_of(marks), pa.scalar(b"", pa.binary()))

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(texts, "\n", " ") if self.drops_space else _joined(_BARE, pc.replace_substring(texts, "\n", " \n"))
        lists = pc.split_pattern(marked, " ")
        del marked
        coded = lists.flatten().dictionary_encode()
        return self._in_a_row(self._distinct(coded.dictionary).take(coded.indices), lists.offsets.to_numpy()[1:])

    def _in_a_row(self, found: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(found.buffers()[2] or b"", self.dtype), cuts(found)[ends].astype(np.int64) // self.dtype.itemsize

    def _irregular(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with other white space: in units where it is spaces and line feeds, else whole."""
        whole = [_OTHER.search(x) is not None or _BARE in x for x in texts]
        lists = [[] if w else [_BARE + u for u in _SEGMENT.findall(x)] for x, w in zip(texts, whole, strict=True)]
        units = pa.array([u for x in lists for u in x], pa.string())
        flat, ends = self._in_a_row(self._ids_of(units), np.cumsum([len(x) for x in lists]))
        return [np.frombuffer(self._encode([x])[0], self.dtype) if w else own for x, w, own in zip(texts, whole, np.split(flat, ends[:-1]), strict=True)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.units) > CACHE_UNITS:
            self.units, self.unit_ids = (pa.concat_arrays([x.slice(0, KEPT_UNITS)]) for x in (self.units, self.unit_ids))
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        texts = texts.cast(pa.string())
        odd = None if self.drops_space else pc.match_substring_regex(texts, _IRREGULAR)
        if odd is None or not pc.any(odd).as_py():
            return self._regular(texts)
        plain = texts.filter(pc.invert(odd))
        flat, ends = self._regular(plain) if len(plain) else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        regular, other = iter(np.split(flat, ends[:-1])), iter(self._irregular(texts.filter(odd).to_pylist()))
        parts = [next(other if x else regular) for x in odd.to_pylist()]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


def _joined(first: str, column: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(first), column, pa.scalar(""))


@lru_cache(maxsize=1)
def encoder(path: str, drops_space: bool) -> UnitEncoder:
    return UnitEncoder(path, drops_space)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def column_slices(column: pa.Array, size: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes."""
    start, before = 0, 0
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    while start < len(column):
        end = min(len(column), int(np.searchsorted(ends, before + size)) + 1)
        yield start, end
        start, before = end, int(ends[end - 1])


def slices(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters, which bounds what is held at a time."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
