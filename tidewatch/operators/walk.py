"""Trees as flat arrays, walked for a whole Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa


class Flat(NamedTuple):
    """Node i is a leaf if ``feature[i] < 0``, else rows with ``x <= cut[i]`` go to ``left[i]``, the others to ``right[i]``."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def nbytes(self) -> int:
        return sum(a.nbytes for a in self)


def flat_from_table(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> Flat:
    return Flat(feature.astype(np.int16), cut, left.astype(np.int32), right.astype(np.int32), value)


def leaves(tree: Flat, columns: np.ndarray) -> np.ndarray:
    """The leaf each row ends in; ``columns`` is (features, rows)."""
    n = columns.shape[1]
    at = np.zeros(n, dtype=np.int32)
    if tree.feature[0] < 0:
        return at
    flat, open_, here = columns.reshape(-1), np.arange(n), at.copy()
    while len(open_):
        down = flat[tree.feature[here].astype(np.int64) * n + open_] <= tree.cut[here]
        here = np.where(down, tree.left[here], tree.right[here])
        inner = tree.feature[here] >= 0
        done = ~inner
        at[open_[done]] = here[done]
        open_, here = open_[inner], here[inner]
    return at


class Masks(NamedTuple):
    """A tree as sets of leaves, numbered from the left: per feature, the leaves left over by the cuts below a value.

    The row's leaf is the first that all features leave over, so a tree costs one
    lookup per feature however deep it is.
    """
    place: list[np.ndarray]   # per feature: of this tree's cuts, how many are below a value of that rank among all cuts
    left_over: list[np.ndarray]  # per feature: (cuts + 1, words) of 64 leaves each
    value: np.ndarray         # (leaves, width)


class Prepared(NamedTuple):
    cuts: list[np.ndarray]    # per feature, those of all trees
    trees: list[Masks | Flat]


MOST_WORDS = 4  # larger trees are walked


def _ranges(tree: Flat) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """Leaves from the left, and for each inner node the range of leaves below its left child."""
    order, first, mid, todo = [], {}, {}, [(0, False)]
    while todo:
        node, back = todo.pop()
        if back:
            mid[node] = len(order)
        elif tree.feature[node] < 0:
            order.append(node)
        else:
            first[node] = len(order)
            todo += [(int(tree.right[node]), False), (node, True), (int(tree.left[node]), False)]
    return np.array(order), {node: (first[node], mid[node]) for node in first}


def _masks(tree: Flat, cuts: list[np.ndarray]) -> Masks:
    order, below = _ranges(tree)
    words = -(-len(order) // 64)
    every = (1 << 64 * words) - 1
    place, left_over = [], []
    for f, known in enumerate(cuts):
        nodes = np.flatnonzero(tree.feature == f)
        nodes = nodes[np.argsort(tree.cut[nodes], kind="stable")]
        sets = [every]
        for node in nodes.tolist():
            lo, hi = below[node]
            sets.append(sets[-1] & ~(((1 << hi - lo) - 1) << lo))
        left_over.append(np.frombuffer(b"".join(x.to_bytes(8 * words, "little") for x in sets), dtype="<u8").reshape(-1, words))
        place.append(np.concatenate([[0], np.searchsorted(tree.cut[nodes], known, side="right")]).astype(np.intp))
    return Masks(place, left_over, tree.value[order])


def prepared(trees: Sequence[Flat], features: int) -> Prepared:
    """Trees made ready for :func:`summed`; done once per task."""
    cuts = [np.unique(np.concatenate([np.empty(0), *[t.cut[t.feature == f] for t in trees]])) for f in range(features)]
    return Prepared(cuts, [_masks(t, cuts) if (t.feature < 0).sum() <= 64 * MOST_WORDS else t for t in trees])


def _first_leaf(tree: Masks, ranks: Sequence[np.ndarray]) -> np.ndarray:
    left = None
    for place, sets, rank in zip(tree.place, tree.left_over, ranks):
        if len(sets) > 1:
            found = sets.take(place.take(rank), axis=0)
            left = found if left is None else np.bitwise_and(left, found, out=left)
    if left is None:
        return np.zeros(len(ranks[0]), dtype=np.intp)
    word = (left != 0).argmax(axis=1) if left.shape[1] > 1 else np.zeros(len(left), dtype=np.intp)
    bits = left[np.arange(len(left)), word] if left.shape[1] > 1 else left[:, 0]
    lowest = bits & (~bits + np.uint64(1))
    return word * 64 + (np.frexp(lowest.astype(np.float64))[1] - 1)


def summed(trees: Prepared | Sequence[Flat], columns: np.ndarray, width: int) -> np.ndarray:
    """Sum over all trees of the values of the leaves each row ends in: (rows, width)."""
    ready = trees if isinstance(trees, Prepared) else prepared(trees, len(columns))
    total = np.zeros((columns.shape[1], width))
    ranks = [np.searchsorted(cuts, x, side="left") for cuts, x in zip(ready.cuts, columns)]  # NaN is above all
    for tree in ready.trees:
        at = _first_leaf(tree, ranks) if isinstance(tree, Masks) else leaves(tree, columns)
        total += tree.value.take(at, axis=0)
    return total


def columns_of(arrays: Sequence[pa.Array]) -> np.ndarray:
    """Columns of numbers as (features, rows); NULL becomes NaN, which goes to the right everywhere."""
    return np.array([a.cast(pa.float64()).to_numpy(zero_copy_only=False) for a in arrays], dtype=np.float64)
