"""Signature trees over sets: nodes with OR-combined token bitmaps and size ranges, and their dual traversal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Sets below a leaf node, and children of an inner node.
FAN = 8


def bitmap_words(size: int) -> int:
    """64-bit words of the bitmap of a set: a power of two that gives at least two bits per element."""
    words = 2
    while 64 * words < 2 * size:
        words *= 2
    return words


def bitmap(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bitmap of 64-bit hashes: the lowest six bits give the bit, the next ones the word, so that wider ones fold onto narrower ones."""
    out = np.zeros(words, np.uint64)
    at = ((hashes >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
    np.bitwise_or.at(out, at, np.uint64(1) << (hashes & np.uint64(63)))
    return out


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one per row) at a narrower width."""
    return np.bitwise_or.reduce(rows.reshape(len(rows), -1, words), axis=1)


class Groups:
    """Union-find over the places of one tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, i: int, j: int) -> None:
        a, b = int(self.root[i]), int(self.root[j])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.root[moved] = a
        self.members[a] += moved

    def one(self, first: Node, second: Node) -> bool:
        """Whether all places of two nodes are joined already."""
        root = self.root[first.start]
        return bool((self.root[first.start : first.stop] == root).all() and (self.root[second.start : second.stop] == root).all())


class Node:
    """A range of places with the range of their sizes and, per width, their OR-combined bitmap.

    ``loose`` is, per width, the most elements of one set beyond its bits: so many
    may share a bit with others.
    """

    def __init__(self, start: int, stop: int, low: int, high: int, maps: dict[int, np.ndarray], loose: dict[int, int], children: list[Node], rows=None):
        self.start, self.stop, self.low, self.high = start, stop, low, high
        self.maps, self.loose, self.children, self.rows = maps, loose, children, rows


def _leaf(start: int, sizes: np.ndarray, maps: list[np.ndarray]) -> Node:
    words = min(map(len, maps))
    own = np.stack([folded(m[None, :], words)[0] if len(m) > words else m for m in maps])
    ors, loose, rows = {}, {}, {}
    while True:
        spare = sizes - np.bitwise_count(own).sum(1, dtype=np.int64)
        rows[words], ors[words], loose[words] = (own, spare), np.bitwise_or.reduce(own, axis=0), int(spare.max())
        if words <= 2 or len(rows) == 3:
            break
        words //= 2
        own = folded(own, words)
    return Node(start, start + len(sizes), int(sizes[0]), int(sizes[-1]), ors, loose, [], rows)


def _parent(children: list[Node]) -> Node:
    widths = sorted(set.intersection(*(set(c.maps) for c in children)))
    maps = {w: np.bitwise_or.reduce([c.maps[w] for c in children], axis=0) for w in widths}
    loose = {w: max(c.loose[w] for c in children) for w in widths}
    return Node(children[0].start, children[-1].stop, children[0].low, children[-1].high, maps, loose, children)


def tree_of(sizes: np.ndarray, maps: list[np.ndarray]) -> Node:
    """A signature tree over sets that are sorted by size."""
    level = [_leaf(i, sizes[i : i + FAN], maps[i : i + FAN]) for i in range(0, len(sizes), FAN)]
    while len(level) > 1:
        level = [_parent(level[i : i + FAN]) for i in range(0, len(level), FAN)]
    return level[0]


def dual_traversal(sizes: np.ndarray, maps: list[np.ndarray], percent: int, accept: Callable[[int, int], bool]) -> Groups:
    """Join all places whose sets may have a Jaccard similarity of ``percent`` and pass ``accept``.

    Places must be sorted by size. A pair of nodes is pruned when the maximum
    possible overlap of their sets (shared bits and loose elements, at most the
    larger size) is too small for their smallest sizes, or when all their places
    are joined already. Pairs that are not joined in the end fail the bound or
    ``accept``, so no link is lost up to connection.
    """
    groups = Groups(len(sizes))

    def possible(a: Node, b: Node) -> bool:
        most = min(a.high, b.high)
        shared = a.maps.keys() & b.maps.keys()
        if (100 + percent) * most >= percent * (a.low + b.low) and shared:
            w = max(shared)
            most = min(most, int(np.bitwise_count(a.maps[w] & b.maps[w]).sum()) + min(a.loose[w], b.loose[w]))
        return (100 + percent) * most >= percent * (a.low + b.low)

    def compare(a: Node, b: Node) -> None:
        total = sizes[a.start : a.stop, None] + sizes[None, b.start : b.stop]
        most = np.minimum(sizes[a.start : a.stop, None], sizes[None, b.start : b.stop])
        if shared := a.rows.keys() & b.rows.keys():
            (x, spare_x), (y, spare_y) = a.rows[max(shared)], b.rows[max(shared)]
            bits = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(2, dtype=np.int64)
            most = np.minimum(most, bits + np.minimum(spare_x[:, None], spare_y[None, :]))
        for i, j in np.argwhere((100 + percent) * most >= percent * total).tolist():
            i, j = i + a.start, j + b.start
            if (a is not b or i < j) and groups.root[i] != groups.root[j] and accept(i, j):
                groups.join(i, j)

    def walk(a: Node, b: Node) -> None:
        if groups.one(a, b) or a is not b and not possible(a, b):
            return
        if not a.children and not b.children:
            compare(a, b)
        elif a is b:
            for child in a.children:
                walk(child, child)
            for n, child in enumerate(a.children):
                for other in a.children[n + 1 :]:
                    walk(child, other)
        else:
            for child in a.children or [a]:
                for other in b.children or [b]:
                    walk(child, other)

    root = tree_of(sizes, maps)
    walk(root, root)
    return groups
