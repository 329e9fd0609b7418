"""Deep-shallow ordering of text positions."""

from __future__ import annotations

import numpy as np

WORD = 8
RUN = 1 << 16  # positions looked at together


def words_at(text: np.ndarray, at: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """The eight bytes from each position as big-endian numbers; bytes from ``left`` on count as zero."""
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(at), RUN):  # the places of all bytes of a run at once take 64 bytes a position
        some = text[at[a : a + RUN, None] + np.arange(WORD)]
        if left is not None:
            some[np.arange(WORD) >= left[a : a + RUN, None]] = 0
        out[a : a + RUN] = some.view(">u8").ravel()
    return out


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes keep a depth and branch bytes only.

    A string goes down by its bytes at the branch depths without comparing the rest, meets one leaf, and is compared
    once with it; the first differing byte gives the place of its new branch.
    """

    def __init__(self, depth: int, shared: int):
        self.depth, self.shared, self.root = depth, shared, None

    def _first_difference(self, x: bytes, y: bytes) -> int:
        if x == y:
            return self.depth
        lo, hi = self.shared, self.depth  # x and y agree before lo and differ before hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if x[lo:mid] == y[lo:mid]:
                lo = mid
            else:
                hi = mid
        return lo

    def insert(self, x: bytes, number: int) -> None:
        if self.root is None:
            self.root = (x, [number])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(x[node[0]]) or next(iter(node[1].values()))
        at = self._first_difference(x, node[0])
        if at == self.depth:
            node[1].append(number)
            return
        branch, parent, node_of = x[at], None, self.root
        while isinstance(node_of, list) and node_of[0] < at:
            parent, node_of = node_of, node_of[1][x[node_of[0]]]
        if isinstance(node_of, list) and node_of[0] == at:
            node_of[1][branch] = (x, [number])
            return
        new = [at, {branch: (x, [number]), node[0][at]: node_of}]
        if parent is None:
            self.root = new
        else:
            parent[1][x[parent[0]]] = new

    def leaves(self) -> list[list[int]]:
        """Members by string, in the order of the strings."""
        out, waiting = [], [self.root] if self.root is not None else []
        while waiting:
            node = waiting.pop()
            if isinstance(node, list):
                waiting.extend(child for _, child in sorted(node[1].items(), key=lambda kv: -kv[0]))
            else:
                out.append(node[1])
        return out


def deep_shallow_order(text: np.ndarray, starts: np.ndarray, depth: int, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the strings of ``depth`` bytes at ``starts``: equal strings, and only they, share a rank.

    ``text`` must reach at least seven bytes beyond every string.

    Shallow part: multikey quicksort whose symbols are eight bytes long.  A round partitions every group of strings
    that agree so far by their next symbol, and only groups of two or more go on.  Deep part: the groups that still
    agree after ``shallow`` bytes.  A group of equal strings is a trie of one leaf; the others are ordered by blind
    tries.
    """
    n = len(starts)
    order = np.arange(n)
    rank = np.zeros(n, np.int64)  # by place in order: first place of the group
    if n < 2:
        return order, rank
    active = np.arange(n)  # places in groups of two or more
    done = 0
    while done < shallow and len(active):
        left = np.full(len(active), depth - done) if depth - done < WORD else None
        symbol = words_at(text, starts[order[active]] + done, left)
        by = np.lexsort((symbol, rank[active]))
        order[active] = order[active][by]
        symbol, group = symbol[by], rank[active]
        first = np.r_[True, (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])]
        heads = active[first]
        rank[active] = np.repeat(heads, np.diff(np.r_[np.flatnonzero(first), len(active)]))
        sizes = np.diff(np.r_[np.flatnonzero(first), len(active)])
        active = active[np.repeat(sizes > 1, sizes)]
        done += WORD
    if done >= depth or not len(active):
        return order, rank
    # groups that agree so far: which of them agree to the end?
    heads, at, sizes = np.unique(rank[active], return_index=True, return_counts=True)
    alike = np.ones(len(heads), bool)
    for d in range(done, depth, WORD):
        left = np.full(len(active), depth - d) if depth - d < WORD else None
        symbol = words_at(text, starts[order[active]] + d, left)
        same = symbol == np.repeat(symbol[at], sizes)
        alike &= np.logical_and.reduceat(same, at)
    for head, size in zip(heads[~alike].tolist(), sizes[~alike].tolist(), strict=True):
        trie = BlindTrie(depth, done)
        members = order[head : head + size].tolist()
        for number in members:
            start = int(starts[number])
            trie.insert(text[start : start + depth].tobytes(), number)
        place = head
        for leaf in trie.leaves():
            order[place : place + len(leaf)] = leaf
            rank[place : place + len(leaf)] = place
            place += len(leaf)
    return order, rank
