"""Signature trees: links between similar sets by dual traversal of OR-combined bitmaps and size ranges.

Level 0 of a tree has the sets, sorted by size; a node of the next level stands for FANOUT neighbours and holds
the OR of their bitmaps, the range of their sizes, the fewest bits of any, and the range of their group labels.
Traversal goes down both trees together and drops a pair of nodes if no sets below can be similar enough, or if
all sets below are in one group already: only whether sets end in one group matters, so a pair within a group
tells nothing new.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
#: Pairs of nodes compared at once, which bounds memory.
PAIRS_AT_ONCE = 1 << 15


class Groups:
    """Union-find over 0..n-1; the label of a group is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def _reduced(x: np.ndarray, f: np.ufunc) -> np.ndarray:
    return f.reduceat(x, np.arange(0, len(x), FANOUT), axis=0)


class Tree:
    """bits: a row of uint64 per set; sizes: of the sets.  exact: a bit is one element and elements without a
    bit are in no other set; else a bit stands for all elements that hash to it."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, members: np.ndarray, exact: bool):
        order = np.lexsort((members, sizes))
        self.members, self.exact = members[order], exact
        self.bits, self.least, self.most = [bits[order]], [sizes[order]], [sizes[order]]
        self.pops = [np.bitwise_count(self.bits[0]).sum(axis=1, dtype=np.int64)]
        while len(self.bits[-1]) > 1:
            self.bits.append(_reduced(self.bits[-1], np.bitwise_or))
            self.least.append(_reduced(self.least[-1], np.minimum))
            self.most.append(_reduced(self.most[-1], np.maximum))
            self.pops.append(_reduced(self.pops[-1], np.minimum))

    def labelled(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Range of the labels below each node, by level."""
        own = labels[self.members]
        out = [(own, own)]
        while len(out) < len(self.bits):
            out.append((_reduced(out[-1][0], np.minimum), _reduced(out[-1][1], np.maximum)))
        return out


def _similar(a: Tree, la: int, i: np.ndarray, b: Tree, lb: int, j: np.ndarray, per_cent: int) -> np.ndarray:
    """Whether sets below each pair of nodes may reach the Jaccard similarity (at level 0 of exact trees: do)."""
    small_a, large_a, small_b, large_b = a.least[la][i], a.most[la][i], b.least[lb][j], b.most[lb][j]
    near = (100 * large_a >= per_cent * small_b) & (100 * large_b >= per_cent * small_a)
    at = np.flatnonzero(near)
    common = np.bitwise_count(a.bits[la][i[at]] & b.bits[lb][j[at]]).sum(axis=1, dtype=np.int64)
    if a.exact:
        overlap = common
    else:
        overlap = np.minimum(large_a[at] - np.maximum(a.pops[la][i[at]] - common, 0), large_b[at] - np.maximum(b.pops[lb][j[at]] - common, 0))
    # 100 * overlap >= per_cent * (sizes - overlap)
    near[at] = (100 + per_cent) * overlap >= per_cent * (small_a[at] + small_b[at])
    return near


def link(a: Tree, b: Tree, groups: Groups, per_cent: int) -> list[tuple[int, int]]:
    """Joins all groups that a similar pair (one set of each tree; a is b: two of one) connects; returns the pairs that did."""
    made: list[tuple[int, int]] = []
    same = a is b

    def join(i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(a.members[i].tolist(), b.members[j].tolist(), strict=True):
            if groups.join(x, y):
                made.append((x, y))

    if same:  # neighbours by size first: groups of near copies join here, and whole subtrees are dropped below
        for step in (1, 2, 3):
            i = np.arange(len(a.members) - step)
            join(*(x[_similar(a, 0, i, b, 0, i + step, per_cent)] for x in (i, i + step)))
    labels = groups.labels()
    tags_a = a.labelled(labels)
    tags_b = tags_a if same else b.labelled(labels)
    waiting = [(len(a.bits) - 1, len(b.bits) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    known = len(made)
    while waiting:
        la, lb, i, j = waiting.pop()
        if len(i) > PAIRS_AT_ONCE:
            waiting += [(la, lb, i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]) for k in range(0, len(i), PAIRS_AT_ONCE)]
            continue
        if len(made) - known > 64:
            labels, known = groups.labels(), len(made)
            tags_a = a.labelled(labels)
            tags_b = tags_a if same else b.labelled(labels)
        (low_a, high_a), (low_b, high_b) = tags_a[la], tags_b[lb]
        keep = ~((low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j]))
        i, j = i[keep], j[keep]
        keep = _similar(a, la, i, b, lb, j, per_cent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == lb == 0:
            join(i, j)
            continue
        down_a, down_b = la >= lb, lb >= la
        if down_a:
            i, j = _children(i, j, len(a.bits[la - 1]))
            la -= 1
        if down_b:
            j, i = _children(j, i, len(b.bits[lb - 1]))
            lb -= 1
        if same:
            keep = i < j if la == 0 else i <= j
            i, j = i[keep], j[keep]
        waiting.append((la, lb, i, j))
    return made


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    below = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(j, FANOUT)
    keep = below < n
    return below[keep], other[keep]


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Hashed bitmaps at a smaller width (a power of two of 64-bit words)."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def link_hashed(bitmaps: list[bytes], sizes: np.ndarray, groups: Groups, per_cent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of sets that may be similar by their hashed bitmaps, whose widths follow their sizes.

    side: 0 or 1 for each set, to compare those of different sides only.
    """
    words = np.array([len(x) // 8 for x in bitmaps])
    made: list[tuple[int, int]] = []
    classes = {w: np.flatnonzero(words == w) for w in sorted(set(words.tolist()))}
    rows = {w: np.frombuffer(b"".join(bitmaps[k] for k in at), np.uint64).reshape(len(at), w) for w, at in classes.items()}
    halves = lambda w: [(at, rows[w][side[classes[w]] == s]) for s in (0, 1) for at in [classes[w][side[classes[w]] == s]]]

    def against(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], w: int) -> None:
        if len(x[0]) and len(y[0]):
            made.extend(link(Tree(fold(x[1], w), sizes[x[0]], x[0], False), Tree(fold(y[1], w), sizes[y[0]], y[0], False), groups, per_cent))

    for w, at in classes.items():
        if side is None:
            tree = Tree(rows[w], sizes[at], at, False)
            made += link(tree, tree, groups, per_cent)
        else:
            against(*halves(w), w)
        for v in classes:
            # Sizes within the threshold of each other can only lie in near classes; sizes prune the rest.
            if v > w:
                if side is None:
                    against((at, rows[w]), (classes[v], rows[v]), w)
                else:
                    (a0, a1), (b0, b1) = halves(w), halves(v)
                    against(a0, b1, w)
                    against(a1, b0, w)
    return made


def link_exact(sets: list[np.ndarray], groups: Groups, per_cent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of sets (sorted distinct uint64) whose Jaccard similarity is at least per_cent / 100."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if not len(sizes) or not sizes.sum():
        return []
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    shared = count[of] > 1
    width = max(1, -(-int(dense[-1] + 1) // 64))
    bits = np.zeros((len(sets), width * 8), np.uint8)
    at = dense[of[shared]]
    np.bitwise_or.at(bits, (owner[shared], at >> 3), (1 << (at & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)
    if side is None:
        every = np.arange(len(sets))
        tree = Tree(bits, sizes, every, True)
        return link(tree, tree, groups, per_cent)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return []
    return link(Tree(bits[left], sizes[left], left, True), Tree(bits[right], sizes[right], right, True), groups, per_cent)
