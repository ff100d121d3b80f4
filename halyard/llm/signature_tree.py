"""Pairs of similar sets by a dual traversal of signature trees.

A leaf is one set with a bitmap of its hashed members; an inner node holds the OR of its
children's bitmaps and the range of their sizes. Two sets below a pair of nodes share at
most as many members as the nodes share bits, plus the members that collided
inside one bitmap, and at most the smaller of the largest sizes. Pairs of nodes
whose bound stays under the overlap that the similarity asks for are pruned;
pairs of leaves that are left are compared exactly. ``pairs`` gives all edges of
the similarity graph. ``forest`` also prunes pairs whose sets are all in one
component already, so what it returns is a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
CHUNK = 4096


class Tree:
    """Levels of nodes over sets, sorted so that similar sets are neighbours; level 0 holds the leaves."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray, bits: int):
        # sets that share nine in ten members mostly share their smallest hash
        self.rows = rows[np.lexsort(([len(sets[r]) for r in rows], [int(sets[r][0]) for r in rows]))]
        sizes = np.array([len(sets[r]) for r in self.rows], np.int64)
        marks = np.zeros((len(self.rows), bits), bool)
        for i, r in enumerate(self.rows):
            marks[i, (sets[r] >> np.uint64(7)) % np.uint64(bits)] = True
        bitmaps = np.packbits(marks, axis=1).view(np.uint64)
        collided = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, collided)]
        while len(self.levels[-1][1]) > 1:
            bitmaps, least, most, collided = self.levels[-1]
            at = np.arange(0, len(least), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bitmaps, at, axis=0),
                    np.minimum.reduceat(least, at),
                    np.maximum.reduceat(most, at),
                    np.maximum.reduceat(collided, at),
                )
            )

    def labels(self, label: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest component label below each node of a level."""
        own = label[self.rows]
        if not level:
            return own, own
        at = np.arange(0, len(own), FANOUT**level)
        return np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes, child) for all children at the level below."""
        start = nodes * FANOUT
        count = np.minimum(start + FANOUT, len(self.levels[level - 1][1])) - start
        of = np.repeat(np.arange(len(nodes)), count)
        return of, np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(of))


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether intersection / union is at least num / den."""
    shared = np.intersect1d(a, b, assume_unique=True).size
    return den * shared >= num * (len(a) + len(b) - shared)


def _leaves(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, label: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of leaves whose bound allows the similarity, in bounded runs.

    With labels, which the caller may change between runs, pairs of nodes below one label are left out.
    """
    sizes = np.array([len(s) for s in sets])
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * np.median(sizes) + 1)), 8, 16))
    halves = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = [Tree(sets, rows, bits) for rows in halves]
    left, right = trees[0], trees[-1]
    alone = len(trees) == 1
    top = max(len(left.levels), len(right.levels)) - 1
    for tree in trees:  # both trees get the same height
        tree.levels += [tree.levels[-1]] * (top + 1 - len(tree.levels))
    chunk = max(CHUNK, (1 << 23) // bits)
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > chunk:
            todo.append((level, i[chunk:], j[chunk:]))
            i, j = i[:chunk], j[:chunk]
        if label is not None:
            (low_i, high_i), (low_j, high_j) = left.labels(label, level), right.labels(label, level)
            one = (low_i[i] == high_i[i]) & (low_j[j] == high_j[j]) & (low_i[i] == low_j[j])
            i, j = i[~one], j[~one]
        maps_i, least_i, most_i, extra_i = left.levels[level]
        maps_j, least_j, most_j, extra_j = right.levels[level]
        need = -(-num * (least_i[i] + least_j[j]) // (num + den))
        fits = (den * most_i[i] >= num * least_j[j]) & (den * most_j[j] >= num * least_i[i])
        fits &= np.minimum(most_i[i], most_j[j]) >= need
        i, j, need = i[fits], j[fits], need[fits]
        if not len(i):
            continue
        bound = np.bitwise_count(maps_i[i] & maps_j[j]).sum(1, dtype=np.int64) + np.minimum(extra_i[i], extra_j[j])
        i, j = i[bound >= need], j[bound >= need]
        if level:
            of, child = left.children(level, i)
            at, other = right.children(level, j[of])
            i, j = child[at], other
            if alone:  # each pair once, a leaf not with itself
                once = (i <= j) if level > 1 else (i < j)
                i, j = i[once], j[once]
            todo.append((level - 1, i, j))
        elif len(i):
            yield left.rows[i], right.rows[j]


def forest(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places that link what similarity num / den connects.

    Places of side 0 are compared with those of side 1; with one side only, with
    each other. Sets are sorted, distinct and not empty. Places that share a label are
    taken as linked already.
    """
    label = np.arange(len(sets)) if label is None else label.copy()
    found = []
    for left, right in _leaves(sets, side, num, den, label):
        for x, y in zip(left.tolist(), right.tolist()):
            if label[x] != label[y] and similar(sets[x], sets[y], num, den):
                found.append((x, y))
                label[label == label[y]] = label[x]
    return found


def pairs(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of similarity num / den, each once, in bounded runs; sets and sides as for ``forest``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    values, members = np.unique(np.concatenate(sets), return_inverse=True)
    members = members.astype(np.int32)
    marks = np.zeros(len(values), bool)
    for left, right in _leaves(sets, side, num, den, None):
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        shared = np.zeros(len(left), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]]))
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x, others = left[start], right[start:stop]
            own = members[starts[x] : starts[x] + sizes[x]]
            marks[own] = True
            ends = np.cumsum(sizes[others])
            before = ends - sizes[others]
            at = np.repeat(starts[others] - before, sizes[others]) + np.arange(ends[-1])
            shared[start:stop] = np.add.reduceat(marks[members[at]], before, dtype=np.int64)
            marks[own] = False
        near = den * shared >= num * (sizes[left] + sizes[right] - shared)
        yield left[near], right[near]
