"""Gradient-boosted trees on binned features, as plain arrays a task can carry.

A level of a tree needs sums of gradients per node, feature and bin and nothing else of the
cases, so these sums are made block by block and added up: for one block in place, for many
by a job over a cached RDD of blocks. A case may stand for ``n`` equal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
from pyspark import RDD, StorageLevel

TREES, DEPTH, RATE, CUTS = 40, 3, 0.2, 16
RIDGE = 1.0
MIN_GAIN = 1e-6
FIXED = float(1 << 20)  # gradients are added up in such parts
PROBS = np.linspace(0, 1, CUTS + 1)[1:-1]  # where features are cut


class Boosted(NamedTuple):
    """Complete binary trees: split feature and cut per inner node, value per leaf."""
    start: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray     # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            total += leaf[_node(x, feature, cut, int(np.log2(len(leaf)))) - len(feature)]
        return total


class Block(NamedTuple):
    bins: np.ndarray     # (cases, features): cuts below the value
    y: np.ndarray
    n: np.ndarray
    margin: np.ndarray


class Tree(NamedTuple):
    feature: np.ndarray
    bin: np.ndarray      # cases of a higher bin go right
    leaf: np.ndarray


def _node(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def sums(block: Block, tree: Tree, level: int) -> np.ndarray:
    """Gradient and curvature per node of the level, feature and bin."""
    nodes, features = 2 ** level, block.bins.shape[1]
    node = (_node(block.bins, tree.feature, tree.bin, level) - (nodes - 1)) * CUTS
    p = 1 / (1 + np.exp(-block.margin))
    out = np.zeros((2, nodes, features, CUTS))
    for part, each in zip(out, (block.y - p, p * (1 - p))):
        weight = block.n * np.rint(each * FIXED)  # whole numbers, whose sums do not depend on their order
        for f in range(features):
            part[:, f] = np.bincount(node + block.bins[:, f], weight, nodes * CUTS).reshape(nodes, CUTS)
    return out


def advanced(block: Block, tree: Tree) -> Block:
    at = _node(block.bins, tree.feature, tree.bin, int(np.log2(len(tree.leaf)))) - len(tree.feature)
    return block._replace(margin=block.margin + tree.leaf[at])


def boost(total: Callable[[Callable[[Block], np.ndarray]], np.ndarray], advance: Callable[[Tree], None],
          edges: Sequence[np.ndarray], start: float, trees: int, depth: int, rate: float) -> Boosted:
    """Logistic loss, Newton steps. ``total`` adds up a function of all blocks, ``advance`` adds a tree to their margins."""
    inner, grown = 2 ** depth - 1, []
    for _ in range(trees):
        tree = Tree(np.zeros(inner, np.int64), np.full(inner, CUTS), np.zeros(inner + 1))
        for level in range(depth):
            gradient, curve = total(partial(sums, tree=tree, level=level)) / FIXED
            for i in range(2 ** level):
                at, g, h = 2 ** level - 1 + i, gradient[i, 0].sum(), curve[i, 0].sum()
                gl, hl = np.cumsum(gradient[i], axis=1), np.cumsum(curve[i], axis=1)
                gain = gl ** 2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g ** 2 / (h + RIDGE)
                for f, e in enumerate(edges):
                    gain[f, len(e):] = -np.inf
                f, k = np.unravel_index(int(gain.argmax()), gain.shape)
                left = (g, h)
                if gain[f, k] > MIN_GAIN:
                    tree.feature[at], tree.bin[at], left = f, k, (gl[f, k], hl[f, k])
                if level == depth - 1:
                    tree.leaf[2 * i:2 * i + 2] = [rate * left[0] / (left[1] + RIDGE),
                                                  rate * (g - left[0]) / (h - left[1] + RIDGE)]
        advance(tree)
        grown.append(tree)
    cut = [[float(edges[f][k]) if k < CUTS else np.inf for f, k in zip(t.feature, t.bin)] for t in grown]
    return Boosted(start, np.array([t.feature for t in grown]), np.array(cut), np.array([t.leaf for t in grown]))


def log_odds(share: float) -> float:
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    return float(np.log(share / (1 - share)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Trees for cases at hand; cuts at quantiles of each feature."""
    edges = [np.unique(np.quantile(x[:, f], PROBS)) for f in range(x.shape[1])]
    start = log_odds(y.mean())
    held = [Block(binned(x, edges), y, np.ones(len(y)), np.full(len(y), start))]

    def advance(tree: Tree) -> None:
        held[0] = advanced(held[0], tree)

    return boost(lambda use: use(held[0]), advance, edges, start, trees, depth, rate)


def fit_blocks(blocks: RDD, edges: Sequence[np.ndarray], start: float, trees: int = TREES, depth: int = DEPTH,
               rate: float = RATE) -> Boosted:
    """Trees for all cases of an RDD of ``(bins, y, n)``, which stay where they are; a job adds up one level.

    A job is one stage: each partition sends its sums, whose size does not depend on the cases, to the driver. A shuffle
    of them would cost more than they do, at every level. So partitions should hold many cases.
    """
    level = StorageLevel.MEMORY_AND_DISK
    held = [blocks.map(lambda b: Block(*b, np.full(len(b[1]), start))).persist(level)]

    def advance(tree: Tree) -> None:
        held.append(held[-1].map(partial(advanced, tree=tree)).persist(level))
        if len(held) > 2:  # the one before was read to the end
            held.pop(0).unpersist()

    try:
        return boost(lambda use: held[-1].map(use).reduce(np.add), advance, edges, start, trees, depth, rate)
    finally:
        for part in held:
            part.unpersist()


def threshold(score: np.ndarray, truth: np.ndarray, precision: float, least: int, n: np.ndarray | None = None) -> float:
    """Smallest score from which at least ``least`` held-out cases reach ``precision``; infinite if none.

    With ``n``, an entry stands for so many cases, of which ``truth`` are true.
    """
    if not len(score):
        return np.inf
    order = np.argsort(-score, kind="stable")
    score, truth = score[order], truth[order]
    cases = np.cumsum(np.ones(len(score)) if n is None else n[order])
    right = np.cumsum(truth) / cases
    last = np.append(score[1:] != score[:-1], True)  # ties stand or fall together
    good = np.flatnonzero(last & (right >= precision) & (cases >= least))
    return float(score[good[-1]]) if len(good) else np.inf
