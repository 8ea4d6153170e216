"""The table-held forest: equal to a plain recursion, wherever a node is grown."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import forest, growth, walk
from tidewatch.spec import TrainingPolicy

RULES = growth.Rules(classes=3, features=3, tried=1, min_leaf=1, max_depth=6, seed=9)
FEATURES = ["a", "b", "c"]
POLICY = TrainingPolicy(trees=5, max_depth=8, min_leaf=2, seed=7)


@pytest.fixture(scope="module")
def rows(spark):
    """Classes of very different size, noise, a constant third feature for most rows."""
    i = F.col("id")
    return spark.range(0, 4000, 1, 7).select(
        "id", (F.pmod(F.hash("id"), F.lit(40)) / 4).alias("a"), F.log1p(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("b"),
        F.when(i % 50 == 0, 1.0).otherwise(0.0).alias("c")).withColumn(
        "threat_class", F.when(i % 97 == 0, "odd").when((F.col("a") > 6) & (F.col("b") < 8), "high").when(F.col("a") < 2, "low").otherwise("odd"))


def naive(tree, node, depth, bins, y, drawn, weights, rules):
    """One node at a time, every cut tried by itself."""
    counts = np.bincount(y, drawn, rules.classes)
    out = {node: (-1, 0, len(y), counts.tolist())}
    if np.count_nonzero(counts) < 2 or len(y) < 2 * rules.min_leaf or depth == rules.max_depth:
        return out
    best = None
    order = growth.feature_order(tree, np.array([node]), rules)[0]
    for slot, f in enumerate(order.tolist()):
        if slot % rules.tried == 0 and best:
            break
        for cut in np.unique(bins[:, f]).tolist():
            left = bins[:, f] <= cut
            if min(left.sum(), (~left).sum()) < rules.min_leaf:
                continue
            value = 0.0
            for side in (left, ~left):
                w = np.bincount(y[side], drawn[side], rules.classes) * weights
                value += (w ** 2).sum() / w.sum()
            if best is None or value > best[0]:
                best = (value, f, cut)
    if best is None:
        return out
    _, f, cut = best
    out[node] = (f, cut, len(y), counts.tolist())
    left = bins[:, f] <= cut
    for child, side in ((2 * node, left), (2 * node + 1, ~left)):
        out |= naive(tree, child, depth + 1, bins[side], y[side], drawn[side], weights, rules)
    return out


@pytest.mark.parametrize("n,kinds,min_leaf,tried", [(1, 3, 1, 1), (60, 4, 1, 1), (400, 256, 1, 2), (400, 6, 5, 3), (3000, 30, 2, 1)])
def test_levels_equal_recursion(n, kinds, min_leaf, tried):
    rng = np.random.default_rng(n + kinds)
    bins = rng.integers(0, kinds, (n, 3)).astype(np.uint8)
    bins[:, 1] = 4
    y, drawn = rng.integers(0, 3, n).astype(np.uint8), rng.integers(1, 4, n).astype(np.uint8)
    rules, weights = RULES._replace(min_leaf=min_leaf, tried=tried), np.array([1.0, 0.25, 3.0])
    got = {}
    for level in growth.grow(3, 1, 0, bins, y, drawn, weights, rules):
        for node, f, b, rows, counts in zip(level.node.tolist(), level.feature.tolist(), level.bin.tolist(), level.rows.tolist(), level.counts.tolist()):
            got[node] = (f, b if f >= 0 else 0, rows, counts)
    assert got == naive(3, 1, 0, bins, y.astype(int), drawn, weights, rules)


def nodes_of(model):
    return sorted((r.tree, r.node, r.depth, r.feature, r.threshold, r.rows, tuple(r.drawn), round(r.gain, 6)) for r in model.nodes.collect())


def test_nodes_do_not_depend_on_where_they_are_grown(spark, rows):
    whole = forest.fit_forest(rows, FEATURES, POLICY, ["id"])
    for bound in (1500, 100, 0):
        parts = forest.fit_forest(rows.repartition(3), FEATURES, POLICY, ["id"], local_rows=bound)
        assert nodes_of(parts) == nodes_of(whole)
    assert forest.soundness(whole).filter("broken > 0 OR drawn <> in_leaves").isEmpty()
    assert whole.nodes.filter("feature < 0 AND rows < 2").isEmpty() and whole.nodes.agg(F.max("depth")).first()[0] <= 8


def test_scores_equal_a_walk_by_hand(spark, rows, monkeypatch):
    model = forest.fit_forest(rows, FEATURES, POLICY, ["id"])
    trees = {}
    for r in model.nodes.collect():
        trees.setdefault(r.tree, {})[r.node] = r
    scored = forest.score(rows, model, model.classes).collect()
    assert len(scored) == 4000
    for r in scored[::37]:
        total = np.zeros(3)
        for tree in trees.values():
            at = tree[1]
            while at.feature >= 0:
                at = tree[2 * at.node + (r[FEATURES[at.feature]] > at.threshold)]
            total += np.array(at.weight) / sum(at.weight)
        assert np.isclose(r.confidence, total.max() / 5) and model.classes[int(total.argmax())] == r.model_prediction
    monkeypatch.setattr(forest, "BROADCAST_BYTES", 1)  # each tree a broadcast of its own
    model._packs.clear()
    again = {r.id: r for r in forest.score(rows, model, model.classes).collect()}
    assert len(model._packs) == 5
    assert all(np.isclose(again[r.id].confidence, r.confidence) for r in scored)


def test_draws_are_those_of_a_poisson_variable(spark):
    bits = spark.range(20_000).select(forest.draw_bits(["id"], 1, 11).alias("b")).toArrow().column("b").to_pylist()
    drawn = np.searchsorted(forest.POISSON, np.frombuffer(b"".join(bits), dtype=">u2"), side="right")
    assert len(bits[0]) == 32 and abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02


def test_importances_add_up_and_find_the_feature(spark, rows):
    table = forest.importances(forest.fit_forest(rows, FEATURES, POLICY, ["id"])).collect()
    assert [r["rank"] for r in table] == [1, 2, 3] and np.isclose(sum(r.importance for r in table), 1)
    assert table[0].feature == "a" and table[-1].feature == "c"


def test_one_leaf_and_nulls():
    leaf = walk.flat_from_table(*(np.array(x) for x in ([-1], [0.0], [0], [0])), np.array([[2.0]]))
    stump = walk.flat_from_table(*(np.array(x) for x in ([0, -1, -1], [1.5, 0, 0], [1, 0, 0], [2, 0, 0])), np.array([[0.0], [1.0], [10.0]]))
    got = walk.summed([leaf, stump], np.array([[1.0, 2.0, np.nan]]), 1)
    assert got[:, 0].tolist() == [3.0, 12.0, 12.0]


def test_one_class_is_refused(spark, rows):
    with pytest.raises(ValueError):
        forest.fit_forest(rows.filter("threat_class = 'low'"), FEATURES, POLICY, ["id"])
    with pytest.raises(ValueError):
        forest.fit_forest(rows, FEATURES, TrainingPolicy(trees=0), ["id"])


@pytest.mark.parametrize("size", [1, 2, 64, 65, 200, 300])
def test_leaf_sets_end_where_the_walk_ends(size):
    """One lookup per feature in place of a step per level; only the largest trees are walked."""
    rng = np.random.default_rng(size)
    feature, cut, left, ends = [-1], [0.0], [0], [0]
    while len(ends) < size:
        node = ends.pop(int(rng.integers(len(ends))))
        feature[node], cut[node], left[node] = int(rng.integers(3)), float(rng.integers(20)), len(feature)
        for _ in range(2):
            ends.append(len(feature))
            feature, cut, left = [*feature, -1], [*cut, 0.0], [*left, 0]
    below = np.array(left)
    tree = walk.flat_from_table(np.array(feature), np.array(cut), below, below + 1, np.arange(len(feature), dtype=float)[:, None])
    rows = rng.integers(-1, 21, (3, 500)).astype(float)
    rows[0, :5], rows[1, 5:9], rows[2, 9:12] = np.nan, np.inf, -np.inf
    ready = walk.prepared([tree], 3)
    assert isinstance(ready.trees[0], walk.Masks) == (size <= 64 * walk.MOST_WORDS)
    assert (walk.summed(ready, rows, 1)[:, 0] == tree.value[walk.leaves(tree, rows), 0]).all()


def test_no_leaf_is_mixed_for_want_of_levels():
    """Two levels and one feature tried at a time: unlucky draws used to end in mixed leaves."""
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 200, (300, 4)).astype(np.uint8)
    y = (bins[:, 0] > 90).astype(np.uint8)
    rules = growth.Rules(classes=2, features=4, tried=1, min_leaf=1, max_depth=2, seed=42)
    for tree in range(12):
        for level in growth.grow(tree, 1, 0, bins, y, np.ones(300, dtype=np.uint8), np.ones(2), rules):
            assert (np.count_nonzero(level.counts[level.feature < 0], axis=1) == 1).all()
