"""Chunks of source files: symbol spans first, then what lies between, each at most so many bytes.

Sizes are bytes of UTF-8.  Lines are packed greedily while what is held plus the next line stays under the limit
(the line feed is added after that test); a line that is too long alone is cut at character boundaries.  A symbol
span that fits is its lines joined, without a last line feed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

MAX_BYTES = 1500


@dataclass(frozen=True)
class Chunk:
    start: int
    end: int
    content: str


def lines_of(source: str) -> list[str]:
    """Lines without their ends; a carriage return before a line feed goes, and no empty line follows the last feed."""
    lines = source.split("\n")
    if lines[-1] == "":
        lines.pop()
    else:
        last = lines[-1]
        return [x.removesuffix("\r") for x in lines[:-1]] + [last]
    return [x.removesuffix("\r") for x in lines]


def cut_bytes(text: str, limit: int) -> list[str]:
    """Pieces of at most `limit` bytes at character boundaries; a wider character is a piece of its own."""
    limit = max(1, limit)
    data, out, at = text.encode(), [], 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append(data[at:end].decode())
        at = end
    return out or [text]


def pack(lines: list[str], first: int, limit: int) -> list[Chunk]:
    """Greedy chunks of consecutive lines, the first of which has the number `first`; blank chunks are dropped."""
    out: list[Chunk] = []
    held: list[str] = []
    size = 0

    def flush(end: int) -> None:
        nonlocal held, size
        content = "".join(x + "\n" for x in held)
        if content.strip():
            out.append(Chunk(end - len(held), end - 1, content))
        held, size = [], 0

    for number, line in enumerate(lines, first):
        n = len(line.encode())
        if held and size + n >= limit:
            flush(number)
        if not held and n >= limit:
            out += [Chunk(number, number, x) for x in cut_bytes(line, limit) if x.strip()]
            continue
        held.append(line)
        size += n + 1
    if held:
        flush(first + len(lines))
    return out


def chunks(source: str, symbols: Iterable[tuple[int, int]] = (), limit: int = MAX_BYTES) -> list[Chunk]:
    """Chunks of a file.  symbols: line ranges (from 1, ends included) in order; equal ranges count once."""
    lines = lines_of(source)
    spans = list(dict.fromkeys(symbols))
    if not lines:
        return []
    if not spans:
        return pack(lines, 1, limit)
    covered = [False] * len(lines)
    out: list[Chunk] = []
    for start, end in spans:
        own = lines[max(0, start - 1) : end]
        covered[max(0, start - 1) : end] = [True] * len(own)
        if not own:
            continue
        whole = "\n".join(own)
        out += [Chunk(start, end, whole)] if len(whole.encode()) <= limit else pack(own, start, limit)
    at = 0
    while at < len(lines):
        if covered[at]:
            at += 1
            continue
        stop = at
        while stop < len(lines) and not covered[stop]:
            stop += 1
        out += pack(lines[at:stop], at + 1, limit)
        at = stop
    return out
