"""Gradient-boosted trees on binned rows, as whole-array steps over one block of rows.

A tree is grown level by level from sums of gradients and second derivatives by (node, feature, bin).
Gradients are rounded to multiples of 2**-26 first: their sums are exact, so a tree does not depend on
how the rows are cut into blocks or in which order blocks are added up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

FINE = float(1 << 26)
RUN = 1 << 17  # rows whose numbers of cells are held at once
NEAR = 1 << 13  # rows that walk down a tree together, their bins in the processor's cache
LARGE = 1 << 14  # rows of a node from which the bins of three features are counted as one
U = np.uint64


@dataclass(frozen=True)
class Spec:
    """Size and shrinkage of an ensemble; shares are drawn anew for every tree."""

    classes: bool
    rounds: int
    depth: int
    rate: float
    rows_share: float = 1.0
    columns_share: float = 1.0
    least_weight: float = 1.0
    least_gain: float = 0.0
    l2: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """A complete binary tree: node i has the children 2i+1 and 2i+2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n))

    def place(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node where every row stands, in a tree that has so many levels yet."""
        n, wide = bins.shape
        return self._walk(np.ascontiguousarray(bins).ravel(), n, wide, 1, levels)

    def place_by_column(self, by_column: np.ndarray) -> np.ndarray:
        """``place`` over bins that lie a column at a time."""
        return self._walk(by_column.ravel(), by_column.shape[1], 1, by_column.shape[1])

    def _walk(self, flat: np.ndarray, n: int, row: int, column: int, levels: int | None = None) -> np.ndarray:
        leaf = self.feature < 0
        start, cut = np.where(leaf, 0, self.feature).astype(np.int64) * column, np.where(leaf, 255, self.bin).astype(np.uint8)
        after = np.where(leaf, np.arange(len(leaf)), 2 * np.arange(len(leaf)) + 1)
        out = np.zeros(n, np.int64)
        for low in range(0, n, NEAR):
            node = out[low : low + NEAR]
            rows = np.arange(low, low + len(node)) * row
            for _ in range((len(leaf) + 1).bit_length() - 2 if levels is None else levels):
                right = flat.take(start.take(node) + rows) > cut.take(node)
                node[:] = after.take(node)
                node += right
        return out


def gradients(spec: Spec, label: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, as whole multiples of 1 / FINE."""
    if spec.classes:
        p = 1.0 / (1.0 + np.exp(-margin))
        return np.rint(weight * (p - label) * FINE), np.rint(weight * p * (1.0 - p) * FINE)
    return np.rint(weight * (margin - label) * FINE), np.rint(weight * FINE)


def paired(spec: Spec, label: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Both derivatives of every row as one complex number, so that one pass adds up both."""
    out = np.empty(len(label), np.complex128)
    for start in range(0, len(label), RUN):
        run = slice(start, start + RUN)
        out.real[run], out.imag[run] = gradients(spec, label[run], weight[run], margin[run])
    return out


def drawn(spec: Spec, tree: int, names: np.ndarray) -> np.ndarray | None:
    """Which rows a tree is grown on, by the rows' hashed names; none for all."""
    if spec.rows_share >= 1.0:
        return None
    x = (names ^ U((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29)) ^ U(spec.seed)) * U(0x94D049BB133111EB)
    return (x >> U(11)).astype(np.float64) < spec.rows_share * float(1 << 53)


def columns(spec: Spec, tree: int, features: int) -> np.ndarray:
    """The features that a tree may split on, in order."""
    if spec.columns_share >= 1.0:
        return np.arange(features)
    some = max(1, round(spec.columns_share * features))
    return np.sort(np.random.default_rng([spec.seed, tree]).permutation(features)[:some])


def _many(n_bins: int) -> tuple[int, int]:
    """Bits of a bin, and how many features one code of 16 bits holds."""
    bits = max(1, (n_bins - 1).bit_length())
    return bits, min(3, 16 // bits)


def codes(by_column: Sequence[np.ndarray], wanted: Sequence[int], n_bins: int) -> list[np.ndarray]:
    """The bins of the wanted features, some features a code; the last is filled up with zeros."""
    bits, many = _many(n_bins)
    out = []
    for start in range(0, len(wanted), many):
        code = np.zeros(len(by_column[wanted[start]]), np.uint16)
        for i, f in enumerate(wanted[start : start + many]):
            code |= by_column[f].astype(np.uint16) << np.uint16(bits * (many - 1 - i))
        out.append(code)
    return out


def _added(parts: Sequence[np.ndarray], rows: np.ndarray, edges: np.ndarray, gh: np.ndarray, features: int, n_bins: int) -> np.ndarray:
    """(2, nodes, features, bins): sums of the rows, which come node by node with ``edges`` between; ``parts`` are codes of their bins.

    Rows of a large node are added up by whole code; the sums of one feature are then those over the bins of the others. The
    small nodes are added up a feature at a time, all together.
    """
    bits, many = _many(n_bins)
    nodes, size, mask = len(edges) - 1, 1 << bits, (1 << bits) - 1
    out = np.zeros((nodes, many * len(parts), size), np.complex128)
    large = np.diff(edges) >= LARGE
    for node in np.flatnonzero(large).tolist():
        for start in range(edges[node], edges[node + 1], RUN):
            some = rows[start : min(start + RUN, edges[node + 1])]
            x = gh.take(some)
            for i, part in enumerate(parts):
                cells = np.zeros(size**many, np.complex128)
                np.add.at(cells, part.take(some).astype(np.intp), x)
                cube = cells.reshape((size,) * many)
                for k in reversed(range(many)):
                    out[node, many * i + k] += cube.sum(axis=tuple(range(k)))
                    cube = cube.sum(axis=k)
    at = np.repeat(np.arange(nodes), np.diff(edges))
    few = np.flatnonzero(~large[at])
    for start in range(0, len(few), RUN):
        mine = few[start : start + RUN]
        some = rows.take(mine)
        x, first = gh.take(some), at.take(mine) << bits
        for i, part in enumerate(parts):
            code = part.take(some).astype(np.intp)
            for k in range(many):
                cells = np.zeros(nodes * size, np.complex128)
                np.add.at(cells, first + ((code >> (bits * (many - 1 - k))) & mask), x)
                out[:, many * i + k] += cells.reshape(nodes, size)
    out = out[:, :features, :n_bins]
    return np.stack([out.real, out.imag])


def sums(bins: np.ndarray, place: np.ndarray, frontier: Sequence[int], wanted: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int) -> np.ndarray:
    """(2, nodes, features, bins): sums over the rows that stand at the nodes of the frontier."""
    slot = np.full(int(max(place.max(initial=0), max(frontier))) + 1, -1, np.int64)
    slot[list(frontier)] = np.arange(len(frontier))
    at = slot[place]
    here = np.flatnonzero(at >= 0)
    rows = here[np.argsort(at[here].astype(np.uint16), kind="stable")]
    edges = np.searchsorted(at[rows], np.arange(len(frontier) + 1))
    by_column = {f: np.ascontiguousarray(bins[:, f]) for f in wanted.tolist()}
    return _added(codes(by_column, wanted.tolist(), n_bins), rows, edges, g + 1j * h, len(wanted), n_bins)


def best_splits(total: np.ndarray, spec: Spec, unit: float = 1.0) -> np.ndarray:
    """For every node: gain (zero or less: none), place of the column, bin, and the sums (g, h) left and right.

    ``unit`` is what one unit of the label stands for: ``least_gain`` is in squares of the label's own unit.
    """
    through = np.cumsum(total, axis=3) / FINE
    g, h = through[0, :, :1, -1:], through[1, :, :1, -1:]
    gl, hl = through[0, :, :, :-1], through[1, :, :, :-1]
    gr, hr = g - gl, h - hl
    fits = (hl >= spec.least_weight) & (hr >= spec.least_weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (gl * gl / (hl + spec.l2) + gr * gr / (hr + spec.l2) - g * g / (h + spec.l2))
    gain = np.where(fits, gain * unit * unit - spec.least_gain, -1.0)
    flat = gain.reshape(len(gain), -1)
    first = flat.argmax(axis=1)  # of equal gains the first column and bin
    nodes = np.arange(len(gain))
    column, cut = np.divmod(first, gain.shape[2])
    take = lambda x: np.broadcast_to(x, gain.shape)[nodes, column, cut]
    return np.stack([flat[nodes, first], column, cut, take(gl), take(hl), take(gr), take(hr)], axis=1)


class Growing:
    """The tree that a model grows now: its frontier asks for sums, the splits found are taken."""

    def __init__(self, spec: Spec, number: int, features: int):
        self.spec, self.number = spec, number
        self.columns = columns(spec, number, features)
        self.tree = Tree.empty(spec.depth)
        self.frontier = [0]
        self.level = 0

    def _value(self, g: float, h: float) -> float:
        return -self.spec.rate * g / (h + self.spec.l2) if h + self.spec.l2 > 0 else 0.0

    def take(self, found: np.ndarray) -> bool:
        """Split the frontier; whether a level is still to come."""
        after = []
        for node, (gain, column, cut, gl, hl, gr, hr) in zip(self.frontier, found):
            if self.level == 0:
                self.tree.value[node], self.tree.cover[node] = self._value(gl + gr, hl + hr), hl + hr
            if not gain > 1e-12:
                continue
            self.tree.feature[node], self.tree.bin[node], self.tree.gain[node] = self.columns[int(column)], cut, gain
            for child, g, h in ((2 * node + 1, gl, hl), (2 * node + 2, gr, hr)):
                self.tree.value[child], self.tree.cover[child] = self._value(g, h), h
                after.append(child)
        self.frontier, self.level = after, self.level + 1
        return bool(after) and self.level < self.spec.depth


def grow(growing: Growing, parts: Sequence[np.ndarray], by_column: np.ndarray, rows: np.ndarray, gh: np.ndarray, n_bins: int, unit: float) -> None:
    """Grow a tree to its end on the given rows; ``parts`` are the codes of the tree's columns.

    Of two children the sums of the smaller are added up; the other's are what is left of the parent's, exactly.
    """
    wide = len(growing.columns)
    edges = np.array([0, len(rows)])
    total = _added(parts, rows, edges, gh, wide, n_bins)
    while True:
        nodes = growing.frontier
        if not growing.take(best_splits(total, growing.spec, unit)):
            return
        tree = growing.tree
        split = tree.feature[nodes] >= 0
        sides = []
        for s in np.flatnonzero(split).tolist():
            mine = rows[edges[s] : edges[s + 1]]
            right = by_column[tree.feature[nodes[s]]].take(mine) > tree.bin[nodes[s]]
            sides += [mine[~right], mine[right]]
        sizes = np.array([len(x) for x in sides])
        smaller = (sizes[1::2] < sizes[::2]).astype(np.int64)
        pairs = len(smaller)
        few = [sides[2 * i + k] for i, k in enumerate(smaller.tolist())]
        starts = np.cumsum([0, *map(len, few)])
        found = _added(parts, np.concatenate(few), starts, gh, wide, n_bins)
        rest = total[:, split] - found
        total = np.empty((2, 2 * pairs, *found.shape[2:]))
        total[:, 2 * np.arange(pairs) + smaller] = found
        total[:, 2 * np.arange(pairs) + 1 - smaller] = rest
        rows, edges = np.concatenate(sides), np.cumsum([0, *sizes])


def fitted(
    spec: Spec, bins: np.ndarray, names: np.ndarray, label: np.ndarray, weight: np.ndarray, base: float, n_bins: int, unit: float, train: np.ndarray
):
    """The trees of one model whose rows are all in this block, and the margin of every row."""
    return fitted_by_column(spec, np.ascontiguousarray(bins.T), names, label, weight, base, n_bins, unit, train)


def fitted_by_column(
    spec: Spec, by_column: np.ndarray, names: np.ndarray, label: np.ndarray, weight: np.ndarray, base: float, n_bins: int, unit: float, train: np.ndarray
):
    """``fitted`` over bins that lie a column at a time."""
    features, n = by_column.shape
    margin, trees, parts = np.full(n, base), [], None
    for number in range(spec.rounds):
        growing = Growing(spec, number, features)
        gh = paired(spec, label, weight, margin)
        some = drawn(spec, number, names)
        rows = np.flatnonzero(train if some is None else train & some)
        if parts is None or len(growing.columns) < features:
            parts = codes(by_column, growing.columns.tolist(), n_bins)
        grow(growing, parts, by_column, rows, gh, n_bins, unit)
        margin += growing.tree.value.take(growing.tree.place_by_column(by_column))
        trees.append(growing.tree)
    return trees, margin
