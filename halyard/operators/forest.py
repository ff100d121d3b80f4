"""Random trees on binned rows, for the importance of features.

A tree is grown on a Poisson draw of the rows, a level at a time; every node tries a few features drawn for it
and takes the cut that lowers the impurity most: Gini for classes, variance for numbers. Draws hang on the hashed name of a
row and the numbers of tree and level only, and all sums are exact, so neither order nor blocks of the rows matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FINE = float(1 << 26)
RUN = 1 << 13  # rows whose numbers of cells are held at once
LARGE = 256  # rows of a node that is read a column at a time
CELLS = 1 << 22  # sums held at once; nodes beyond it come in a further run
U = np.uint64
#: chances that a row is drawn at most 0, 1, 2 ... times
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


@dataclass(frozen=True)
class Spec:
    """Size of a forest; ``tried`` features are looked at in a node."""

    classes: bool
    depth: int
    tried: int
    seed: int = 42


def told_apart(names: np.ndarray) -> np.ndarray:
    """Names of rows; rows of equal content are numbered, so that their draws differ."""
    order = np.argsort(names, kind="stable")
    at = names[order]
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    out = np.empty_like(names)
    out[order] = at + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    return out


def drawn(spec: Spec, tree: int, names: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean one."""
    x = (names ^ U((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29)) ^ U(spec.seed)) * U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return np.searchsorted(POISSON, (x >> U(11)).astype(np.float64) / float(1 << 53), side="right").astype(np.float64)


def _tried(spec: Spec, tree: int, level: int, nodes: int, features: int) -> np.ndarray:
    """The features that each node of a level looks at, in order."""
    if spec.tried >= features:
        return np.broadcast_to(np.arange(features), (nodes, features))
    lots = np.random.default_rng([spec.seed, tree, level]).random((nodes, features))
    return np.sort(np.argpartition(lots, spec.tried, axis=1)[:, : spec.tried], axis=1)


def _best(
    bins: np.ndarray, rows: np.ndarray, at: np.ndarray, tried: np.ndarray, weight: np.ndarray, target: np.ndarray, groups: int, n_bins: int
):
    """For every node: gain of its best cut, the place of the feature, and the bin. Rows come in the order of their nodes."""
    nodes, wide = tried.shape
    kinds = max(groups, 1)
    found, total = np.zeros((nodes, wide, n_bins, kinds)), None if groups else np.zeros((nodes, wide, n_bins))
    columns = np.arange(wide) * n_bins
    edges = np.searchsorted(at, np.arange(nodes + 1))
    large = np.diff(edges) >= LARGE
    for node in np.flatnonzero(large).tolist():
        part = slice(edges[node], edges[node + 1])
        mine, much, aim = rows[part], weight[part], target[part]
        first = aim * n_bins if groups else None
        times = None if groups else much * aim
        for place, feature in enumerate(tried[node].tolist()):
            seen = bins[:, feature][mine]
            if groups:
                found[node, place] = np.bincount(first + seen, much, kinds * n_bins).reshape(kinds, n_bins).T
            else:
                found[node, place, :, 0] = np.bincount(seen, times, n_bins)
                total[node, place] = np.bincount(seen, much, n_bins)
    if large.any():  # the small ones together
        few = ~large[at]
        rows, at, weight, target = rows[few], at[few], weight[few], target[few]
    for start in range(0, len(rows), RUN):
        run = slice(start, start + RUN)
        node = at[run]
        low, high = node[0], node[-1] + 1
        cells = bins[rows[run, None], tried[node]] + columns
        cells += ((node - low) * (wide * n_bins))[:, None]
        size = (high - low) * wide * n_bins
        repeated, aim = np.repeat(weight[run], wide), np.repeat(target[run], wide)
        if groups:
            cells *= groups
            found[low:high] += np.bincount(cells.ravel() + aim, repeated, size * groups).reshape(-1, wide, n_bins, groups)
        else:
            found[low:high, :, :, 0] += np.bincount(cells.ravel(), repeated * aim, size).reshape(-1, wide, n_bins)
            total[low:high] += np.bincount(cells.ravel(), repeated, size).reshape(-1, wide, n_bins)
    if groups:
        total = found.sum(axis=3)
    else:
        found /= FINE
    found, total = found.cumsum(axis=2), total.cumsum(axis=2)
    left, n_left = found[:, :, :-1], total[:, :, :-1]
    right, n_right = found[:, :, -1:] - left, total[:, :, -1:] - n_left
    square = lambda s, n: (s * s).sum(axis=-1) / np.maximum(n, 1.0)
    gain = square(left, n_left) + square(right, n_right) - square(found[:, :, -1:], total[:, :, -1:])
    gain = np.where((n_left > 0) & (n_right > 0), gain, 0.0).reshape(nodes, -1)
    first = gain.argmax(axis=1)  # of equal gains the first feature and bin
    return (gain[np.arange(nodes), first], *np.divmod(first, n_bins - 1))


def tree_gains(spec: Spec, tree: int, bins: np.ndarray, names: np.ndarray, label: np.ndarray, n_bins: int) -> np.ndarray:
    """What each feature's cuts in one tree lower the impurity by, weighted by rows, as shares of all (zeros without a cut)."""
    features = bins.shape[1]
    bins = np.asfortranarray(bins)
    gains = np.zeros(features)
    weight = drawn(spec, tree, names)
    rows = np.flatnonzero(weight > 0)
    weight = weight[rows]
    if spec.classes:
        kinds, target = np.unique(label, return_inverse=True)
        groups = len(kinds)
        target = target[rows]
    else:
        groups, target = 0, np.rint(label[rows] * FINE)
    if not len(rows) or not features:
        return gains
    at, nodes = np.zeros(len(rows), np.int64), 1
    for level in range(spec.depth):
        tried = _tried(spec, tree, level, nodes, features)
        run = max(1, CELLS // (tried.shape[1] * n_bins * max(groups, 1)))
        order = np.argsort(at.astype(np.uint16) if nodes <= 1 << 16 else at, kind="stable")
        rows, weight, target, at = rows[order], weight[order], target[order], at[order]
        child = np.full(len(rows), -1, np.int64)
        after = 0
        for start in range(0, nodes, run):
            end = min(start + run, nodes)
            part = slice(*np.searchsorted(at, [start, end]))
            here = at[part] - start
            mine = tried[start:end]
            gain, place, cut = _best(bins, rows[part], here, mine, weight[part], target[part], groups, n_bins)
            splits = gain > 1e-9
            np.add.at(gains, mine[np.arange(end - start), place][splits], gain[splits])
            number = np.cumsum(splits) - 1  # of the nodes that are split
            right = bins[rows[part], mine[np.arange(end - start), place][here]] > cut[here]
            child[part] = np.where(splits[here], after + 2 * number[here] + right, -1)
            after += 2 * int(splits.sum())
        stay = child >= 0
        rows, weight, target, at, nodes = rows[stay], weight[stay], target[stay], child[stay], after
        if not nodes:
            break
    return gains / gains.sum() if gains.sum() > 0 else gains


# ---------------------------------------------------------------- trees whose rows lie in many blocks


@dataclass
class Tree:
    """A complete binary tree: node i has the children 2i+1 and 2i+2; feature -1 is a leaf.

    ``value`` holds the shares of the classes, or the mean alone.
    """

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int, wide: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros((n, wide)))

    def place(self, flat: np.ndarray, rows: np.ndarray, size: int, levels: int) -> np.ndarray:
        """The node, ``levels`` below the root, of the given rows; from a leaf they go on to the left. ``flat`` has the bins of ``size`` rows a column at a time."""
        leaf = self.feature < 0
        start, cut = np.where(leaf, 0, self.feature * size), np.where(leaf, 255, self.bin).astype(np.uint8)
        node = np.zeros(len(rows), np.int64)
        for _ in range(levels):
            right = flat.take(start.take(node) + rows) > cut.take(node)
            node += node
            node += 1
            node += right
        return node

    def handed_down(self) -> np.ndarray:
        """Values with those of a leaf in all nodes below it."""
        out, leaf = self.value.copy(), self.feature < 0
        for i in range(len(leaf) // 2):
            if leaf[i]:
                out[2 * i + 1], out[2 * i + 2] = out[i], out[i]
                leaf[2 * i + 1] = leaf[2 * i + 2] = True
        return out


#: times drawn by the first 16 bits of a hash: Poisson with mean one
LOTS = np.searchsorted(POISSON, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


def lots(seed: int, tree: int, names: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree."""
    x = (names ^ U((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29)) ^ U(seed)) * U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return LOTS.take((x >> U(48)).astype(np.int64))


def level_sums(spec: Spec, number: int, tree: Tree, level: int, nodes: np.ndarray, flat: np.ndarray, names: np.ndarray, target: np.ndarray, weight: np.ndarray, kinds: int, n_bins: int) -> np.ndarray:
    """(nodes, tried, bins, kinds): weights of the classes, or number and sum of the targets, of a block's rows at the nodes of a level.

    ``nodes`` are numbers of the whole tree in rising order. Weights and targets are whole multiples of 1 / FINE.
    """
    size, first = len(names), (1 << level) - 1
    tried = _tried(spec, number, level, 1 << level, len(flat) // size)[nodes - first]
    wide = tried.shape[1]
    slots = np.full(1 << level, -1, np.int64)
    slots[nodes - first] = np.arange(len(nodes))
    times = lots(spec.seed, number, names)
    rows = np.flatnonzero(times)
    at = slots.take(tree.place(flat, rows, size, level) - first)
    if len(nodes) < 1 << level:
        stay = np.flatnonzero(at >= 0)
        rows, at = rows.take(stay), at.take(stay)
    much = times.take(rows).astype(np.float64)
    aim = target.take(rows)
    if spec.classes:
        much *= weight.take(rows)
    else:
        aim = aim * much
    out = np.zeros((len(nodes), wide, n_bins, kinds))
    cells = len(nodes) * n_bins
    for place in range(wide):
        cell = flat.take((tried[:, place] * size).take(at) + rows) + at * n_bins
        if spec.classes:
            cell *= kinds
            cell += aim
            out[:, place] = np.bincount(cell, much, cells * kinds).reshape(len(nodes), n_bins, kinds)
        else:
            out[:, place, :, 0] = np.bincount(cell, much, cells).reshape(len(nodes), n_bins)
            out[:, place, :, 1] = np.bincount(cell, aim, cells).reshape(len(nodes), n_bins)
    return out


def best_cuts(spec: Spec, total: np.ndarray) -> np.ndarray:
    """For every node: gain (0: none), place of the feature, bin, and the sums of both sides (a column a kind, left first)."""
    nodes, _, n_bins, kinds = total.shape
    through = total.cumsum(axis=2)
    left, whole = through[:, :, :-1], through[:, :, -1:]
    right = whole - left

    def much(x: np.ndarray) -> np.ndarray:
        return x.sum(axis=-1) if spec.classes else x[..., 0]

    def square(x: np.ndarray) -> np.ndarray:
        of = x if spec.classes else x[..., 1:]
        return (of * of).sum(axis=-1) / np.maximum(much(x), 1e-300)

    there = (much(left) > 0) & (much(right) > 0)
    gain = np.where(there, square(left) + square(right) - square(whole), 0.0)
    gain = np.where(gain > 1e-9 * np.maximum(np.abs(square(whole)), 1e-300), gain, 0.0).reshape(nodes, -1)
    first = gain.argmax(axis=1)  # of equal gains the first feature and bin
    place, cut = np.divmod(first, n_bins - 1)
    some = np.arange(nodes)
    return np.column_stack([gain[some, first], place, cut, left[some, place, cut], right[some, place, cut]])


def take_cuts(spec: Spec, number: int, tree: Tree, level: int, nodes: np.ndarray, features: int, found: np.ndarray, kinds: int) -> np.ndarray:
    """Cut the nodes of a level where there is a gain; the nodes of the next level."""
    first = (1 << level) - 1
    tried = _tried(spec, number, level, 1 << level, features)
    after = []
    for node, row in zip(nodes.tolist(), found):
        sides = row[3 : 3 + kinds], row[3 + kinds :]
        if node == 0:
            _hold(spec, tree, 0, sides[0] + sides[1])
        if row[0] > 0:
            tree.feature[node], tree.bin[node], tree.gain[node] = tried[node - first, int(row[1])], row[2], row[0]
            for child, sums in zip((2 * node + 1, 2 * node + 2), sides):
                _hold(spec, tree, child, sums)
                after.append(child)
    return np.array(after, np.int64)


def _hold(spec: Spec, tree: Tree, node: int, sums: np.ndarray) -> None:
    much = sums.sum() if spec.classes else sums[0]
    tree.cover[node] = much / FINE if spec.classes else much
    if much > 0:
        tree.value[node] = sums / much if spec.classes else sums[1] / much / FINE
