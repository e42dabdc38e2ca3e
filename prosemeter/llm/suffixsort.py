"""Deep-shallow suffix sorting of many short stretches of text.

Shallow: multikey sorting by characters of eight bytes, to SHALLOW bytes. Deep: the groups
that still agree, whose common prefixes are long, go into blind tries, one a group, which
branch on single bytes and compare each suffix with one leaf only.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def keys_at(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a big-endian integer."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | buffer[at + k]
    return out


class BlindTrie:
    """Orders strings of one length that share a prefix; equal strings share a leaf."""

    __slots__ = ("root", "size")

    def __init__(self, size: int):
        self.root: list | None = None
        self.size = size

    def insert(self, s: bytes, name: int) -> None:
        # a leaf is [size, string, names], a branch [depth, children by byte]
        if self.root is None:
            self.root = [self.size, s, [name]]
            return
        node = self.root
        while len(node) == 2:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[1] == s:
            node[2].append(name)
            return
        other = node[1]
        differ = int.from_bytes(s) ^ int.from_bytes(other)
        depth = self.size - 1 - (differ.bit_length() - 1) // 8
        parent, node = None, self.root
        while len(node) == 2 and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        leaf = [self.size, s, [name]]
        if len(node) == 2 and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        branch = [depth, {other[depth]: node, s[depth]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def leaves(self) -> list[list[int]]:
        """Names of each leaf, in the strings' order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node[2])
        return out


def sort_windows(buffer: np.ndarray, group: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `size` bytes at positions `at`, each in a group -> (order, same): the order by
    group and bytes, and whether each equals its predecessor there.

    Only windows of one group are compared. `buffer` needs 8 spare bytes at its end.
    """
    n = len(at)
    order = np.argsort(group, kind="stable")
    bounds = np.ones(n, dtype=bool)
    if n:
        bounds[1:] = group[order][1:] != group[order][:-1]
    shallow = min(SHALLOW, size // 8 * 8)
    for depth in range(0, shallow, 8):  # refine what is still together by the next eight bytes
        part = np.cumsum(bounds) - 1
        big = np.bincount(part)[part] > 1 if n else bounds
        rows = np.flatnonzero(big)
        if not len(rows):
            break
        key = keys_at(buffer, at[order[rows]] + depth)
        by = np.lexsort((key, part[rows]))
        order[rows] = order[rows][by]
        key, p = key[by], part[rows]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1])
        bounds[rows] |= new
    same = np.zeros(n, dtype=bool)
    starts = np.flatnonzero(bounds)
    ends = np.append(starts[1:], n)
    raw = buffer.tobytes()
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        names = order[a:b].tolist()
        where = at[order[a:b]].tolist()
        if b - a == 2:
            x, y = raw[where[0] : where[0] + size], raw[where[1] : where[1] + size]
            if x == y:
                same[a + 1] = True
            elif x > y:
                order[a], order[a + 1] = names[1], names[0]
            continue
        trie = BlindTrie(size)
        for name, w in zip(names, where):
            trie.insert(raw[w : w + size], name)
        k = a
        for leaf in trie.leaves():
            order[k : k + len(leaf)] = leaf
            same[k + 1 : k + len(leaf)] = True
            k += len(leaf)
    return order, same
