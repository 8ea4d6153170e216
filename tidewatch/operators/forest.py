"""The classifier: a random forest grown level by level, its nodes held in a table.

Features are cut into at most 256 bins at quantiles of the training rows. A row is
drawn for a tree as often as bits of its key's md5 say (Poisson with mean 1), so
samples repeat anywhere. Nodes reached by more than ``LOCAL_ROWS`` rows are split from
histograms added up over all tasks, one pass per level; what is smaller is shuffled
to one task per subtree and grown there. Nodes are written as they are found; only
splits of nodes above that bound, and sums per tree and class, pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import growth, walk
from tidewatch.operators.rows import contract, q
from tidewatch.session import BROADCAST_BYTES, materialize
from tidewatch.spec import TARGET, TrainingPolicy

LOCAL_ROWS = 1 << 20   # rows of a node that one task grows alone, some 40 bytes each
HELD_BYTES = 1 << 26   # histograms a task adds up before it hands them on
PER_HASH = 8           # trees served by one md5
# Draws by 16 bits: 65536 times the Poisson distribution function with mean 1, rounded down.
POISSON = np.array([24109, 48218, 60273, 64291, 65296, 65496, 65530, 65535])
NODE_SCHEMA = ("tree int, node long, depth int, feature int, threshold double, gain double, rows long, "
               "drawn array<long>, weight array<double>")


@dataclass(frozen=True)
class Forest:
    """A fitted forest. Node n of a tree has the children 2n and 2n+1; a leaf's feature is -1."""
    nodes: DataFrame
    features: tuple[str, ...]
    classes: tuple[str, ...]
    trees: int
    max_depth: int
    rows: int
    _packs: list = field(default_factory=list, compare=False, repr=False)


def class_counts(df: DataFrame, target: str = TARGET) -> dict[str, int]:
    """Rows per class. The class domain is fixed and small by the spec."""
    return {r[0]: r[1] for r in df.filter(F.col(target).isNotNull()).groupBy(target).count().collect()}


def class_weight(counts: dict[str, int], target: str = TARGET) -> Column:
    """Balanced weight n / (classes * class rows), as a literal per class."""
    total, out = sum(counts.values()), F.lit(0.0)
    for cls, n in counts.items():
        out = F.when(F.col(target) == cls, F.lit(total / (len(counts) * n))).otherwise(out)
    return out


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Cuts between bins, halfway between neighbouring quantiles; one scan, a sketch per feature."""
    probs = F.array(*[F.lit(i / growth.BINS) for i in range(growth.BINS + 1)])
    got = rows.agg(*[F.percentile_approx(q(f), probs, F.lit(10_000)).alias(f"v{i}") for i, f in enumerate(features)]).first()
    values = [np.unique(np.array(v or [], dtype=np.float64)) for v in got]
    return [((v[:-1] / 2 + v[1:] / 2))[:growth.BINS - 1] for v in values]


def draw_bits(key: Sequence[str], seed: int, trees: int) -> Column:
    """16 bits per tree from md5 values of the row's key."""
    parts = [F.coalesce(q(c).cast("string"), F.lit("~")) for c in key]
    return F.concat(*[F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(f"bag{j}"), *parts)))
                      for j in range(-(-trees // PER_HASH))])


def _arrays(batch: pa.RecordBatch, edges: list[np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (rows, features), class numbers, and draws (rows, trees) of a batch ``f0.., y, bits``."""
    bins = np.stack([np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False), side="left")
                     for i, e in enumerate(edges)], axis=1).astype(np.uint8)
    y = batch.column(len(edges)).to_numpy(zero_copy_only=False).astype(np.uint8)
    bits = np.frombuffer(b"".join(batch.column(len(edges) + 1).to_pylist()), dtype=">u2").reshape(batch.num_rows, -1)[:, :trees]
    return bins, y, np.searchsorted(POISSON, bits, side="right").astype(np.uint8)


class _Top:
    """Inner nodes above ``LOCAL_ROWS`` and leaves among their children, per tree."""

    def __init__(self) -> None:
        self.splits: dict[int, dict[int, tuple[int, int]]] = {}

    def add(self, tree: int, node: int, feature: int, bin_: int) -> None:
        self.splits.setdefault(tree, {})[node] = (feature, bin_)

    def reached(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The open node each row is in; 0 if it ended in a leaf."""
        at = np.ones(len(bins), dtype=np.int64)
        known = self.splits.get(tree)
        if not known:
            return at
        ids = np.array(sorted(known))
        feature, cut = (np.array([known[i][j] for i in ids.tolist()]) for j in (0, 1))
        open_ = np.arange(len(bins))
        while len(open_):
            place = np.minimum(np.searchsorted(ids, at[open_]), len(ids) - 1)
            inside = ids[place] == at[open_]
            open_, place = open_[inside], place[inside]
            f = feature[place]
            at[open_[f < 0]] = 0
            open_, place, f = open_[f >= 0], place[f >= 0], f[f >= 0]
            at[open_] = 2 * at[open_] + (bins[open_, f] > cut[place])
        return at


def fit_forest(train: DataFrame, features: Sequence[str], policy: TrainingPolicy, key: Sequence[str], target: str = TARGET,
               local_rows: int = LOCAL_ROWS) -> Forest:
    """Forest on the training rows; class weights balance each tree's own sample.

    ``key`` names what tells rows apart; rows that share it are drawn together.
    Classes are in alphabetical order. The result does not depend on ``local_rows``.
    """
    if policy.trees < 1:
        raise ValueError("a forest needs at least one tree")
    contract(train, features)
    slim = train.filter(F.col(target).isNotNull()).select(
        *[q(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(target).alias("class"),
        draw_bits(key, policy.seed, policy.trees).alias("bits"))
    slim = materialize(slim, "forest-rows")
    found = class_counts(slim, "class")
    classes = tuple(sorted(found))
    if len(classes) < 2:
        raise ValueError(f"{len(classes)} class present; classification needs two")
    names = [f"f{i}" for i in range(len(features))]
    edges = bin_edges(slim, names)
    rows = slim.select(*names, (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")) - 1).alias("y"), "bits")
    depth = growth.DEEPEST if policy.max_depth is None else min(policy.max_depth, growth.DEEPEST)
    rules = growth.Rules(len(classes), len(features), max(1, int(len(features) ** 0.5)), policy.min_leaf, depth, policy.seed)
    drawn, reached = _tree_sums(rows, edges, policy.trees, rules.classes)
    weights = drawn.sum(axis=1, keepdims=True) / np.maximum(rules.classes * drawn, 1) * (drawn > 0)
    top, ready = _grow_top(rows, edges, drawn, reached, weights, rules, local_rows)
    nodes = _grow_rest(rows, edges, top, weights, rules)
    if ready:
        nodes = nodes.unionByName(train.sparkSession.createDataFrame(ready, NODE_SCHEMA))
    return Forest(materialize(nodes, "forest-nodes"), tuple(features), classes, policy.trees, depth, sum(found.values()))


def _tree_sums(rows: DataFrame, edges: list[np.ndarray], trees: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws per tree and class, and rows per tree: one number for each passes the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees, classes + 1), dtype=np.int64)
        for batch in batches:
            _, y, drawn = _arrays(batch, edges, trees)
            for c in range(classes):
                sums[:, c] += drawn[y == c].sum(axis=0, dtype=np.int64)
            sums[:, classes] += (drawn > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["i", "n"])

    out = np.zeros(trees * (classes + 1), dtype=np.int64)
    for r in rows.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    out = out.reshape(trees, classes + 1)
    return out[:, :classes], out[:, classes]


def _grow_top(rows: DataFrame, edges: list[np.ndarray], drawn: np.ndarray, reached: np.ndarray, weights: np.ndarray,
              rules: growth.Rules, local_rows: int) -> tuple[_Top, list[tuple]]:
    """Split what is too large for one task, level by level; finished nodes as rows of the node table."""
    top, ready = _Top(), []
    spark = rows.sparkSession
    c = [f"c{i}" for i in range(rules.classes)]
    large = [(t, 1, drawn[t], int(reached[t])) for t in range(len(drawn)) if reached[t] > local_rows]
    depth = 0
    while large:
        wanted: dict[int, dict[int, np.ndarray]] = {}
        for t, node, counts, n in large:
            if np.count_nonzero(counts) > 1 and n >= 2 * rules.min_leaf and depth < rules.max_depth:
                wanted.setdefault(t, {})[node] = counts
        shared = spark.sparkContext.broadcast((top, {t: np.array(sorted(ids)) for t, ids in wanted.items()}))

        def cells_table(t: int, f: int, ids: np.ndarray, cells: np.ndarray, counts: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            size = len(cells)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, t), pa.int32()), pa.array(ids[cells // growth.BINS]), pa.array(np.full(size, f), pa.int32()),
                 pa.array(cells % growth.BINS, pa.int32()), pa.array(n, pa.int64()),
                 *[pa.array(counts[:, i].astype(np.int64)) for i in range(rules.classes)]],
                names=["tree", "node", "feature", "bin", "rows", *c])

        def histograms(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            top, wanted = shared.value
            cells_held = sum(map(len, wanted.values())) * rules.features * growth.BINS
            hold = cells_held * (rules.classes + 1) * 8 <= HELD_BYTES
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                bins, y, drawn = _arrays(batch, edges, len(weights))
                for t, ids in wanted.items():
                    at = top.reached(t, bins)
                    place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                    mine = np.flatnonzero((ids[place] == at) & (drawn[:, t] > 0))
                    for f in range(rules.features):
                        cells, counts, n = growth.cells_of(place[mine], bins[mine, f].astype(np.int64), y[mine].astype(np.int64),
                                                           drawn[mine, t], len(ids), rules.classes)
                        if not hold:
                            yield cells_table(t, f, ids, cells, counts, n)
                            continue
                        if (t, f) not in held:
                            held[t, f] = np.zeros((len(ids) * growth.BINS, rules.classes + 1), dtype=np.int64)
                        held[t, f][cells] += np.column_stack([counts.astype(np.int64), n])
            for (t, f), sums in held.items():
                cells = np.flatnonzero(sums[:, -1])
                yield cells_table(t, f, wanted[t], cells, sums[cells, :-1], sums[cells, -1])

        def split(key: tuple, table: pa.Table) -> pa.Table:
            t, node = key[0].as_py(), key[1].as_py()
            column = {n: table.column(n).to_numpy() for n in ("feature", "bin", "rows", *c)}
            by = np.lexsort((column["bin"], column["feature"]))
            column = {n: v[by] for n, v in column.items()}
            counts = np.stack([column[n] for n in c], axis=1)

            def cut_of(todo: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = column["feature"] == wanted[0]
                return growth.best_cut(column["bin"][at].astype(np.int64), counts[at], column["rows"][at], 1, weights[t], rules.min_leaf)

            whole = counts[column["feature"] == 0].sum(axis=0)
            found = growth.choose(growth.feature_order(t, np.array([node]), rules), cut_of, whole[None] * weights[t],
                                  growth.at_depth(rules, node.bit_length() - 1))
            left = (column["feature"] == found.feature[0]) & (column["bin"] <= found.bin[0])
            return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int64()), "feature": pa.array(found.feature, pa.int32()),
                             "bin": pa.array(found.bin, pa.int32()), "gain": pa.array(found.gain), "rows": pa.array([int(column["rows"][left].sum())], pa.int64()),
                             "left": pa.array([counts[left].sum(axis=0).tolist()], pa.list_(pa.int64()))})

        sums = rows.mapInArrow(histograms, "tree int, node long, feature int, bin int, rows long, " + ", ".join(f"{x} long" for x in c))
        sums = sums.groupBy("tree", "node", "feature", "bin").agg(F.sum("rows").alias("rows"), *[F.sum(x).alias(x) for x in c])
        found = {(r["tree"], r["node"]): r for r in sums.groupBy("tree", "node").applyInArrow(
            split, "tree int, node long, feature int, bin int, gain double, rows long, left array<long>").collect()} if wanted else {}
        shared.unpersist()
        children = []
        for t, node, counts, n in large:
            r = found.get((t, node))
            feature = r["feature"] if r is not None else -1
            top.add(t, node, feature, r["bin"] if r is not None else 0)
            threshold = float(edges[feature][r["bin"]]) if feature >= 0 else 0.0
            ready.append((t, node, depth, feature, threshold, float(r["gain"]) if feature >= 0 else 0.0, n,
                          [int(x) for x in counts], [float(x) for x in counts * weights[t]]))
            if feature >= 0:
                left = np.array(r["left"])
                children += [(t, 2 * node, left, r["rows"]), (t, 2 * node + 1, counts - left, n - r["rows"])]
        large = [x for x in children if x[3] > local_rows]
        depth += 1
    return top, ready


def _grow_rest(rows: DataFrame, edges: list[np.ndarray], top: _Top, weights: np.ndarray, rules: growth.Rules) -> DataFrame:
    """Nodes below the top, one task per subtree. The rows of a subtree travel as packed bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(top)
    trees = len(weights)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for batch in batches:
            bins, y, drawn = _arrays(batch, edges, trees)
            out = []
            for t in range(trees):
                at = np.where(drawn[:, t] > 0, top.reached(t, bins), 0)
                for node in np.unique(at[at > 0]).tolist():
                    mine = np.flatnonzero(at == node)
                    out.append((t, node, bins[mine].tobytes(), y[mine].tobytes(), drawn[mine, t].tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [()] * 5, kinds)],
                                             names=["tree", "node", "bins", "y", "drawn"])

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        t, root = key[0].as_py(), key[1].as_py()
        bins, y, drawn = (np.frombuffer(b"".join(table.column(n).to_pylist()), dtype=np.uint8) for n in ("bins", "y", "drawn"))
        bins = bins.reshape(-1, rules.features)
        parts = []
        for i, level in enumerate(growth.grow(t, root, root.bit_length() - 1, bins, y, drawn, weights[t], rules)):
            n = len(level.node)
            threshold = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(level.feature.tolist(), level.bin.tolist())]
            offsets = pa.array(np.arange(n + 1) * rules.classes, pa.int32())
            parts.append(pa.table({
                "tree": pa.array(np.full(n, t), pa.int32()), "node": pa.array(level.node), "depth": pa.array(np.full(n, root.bit_length() - 1 + i), pa.int32()),
                "feature": pa.array(level.feature, pa.int32()), "threshold": pa.array(threshold, pa.float64()), "gain": pa.array(level.gain),
                "rows": pa.array(level.rows, pa.int64()),
                "drawn": pa.ListArray.from_arrays(offsets, pa.array(level.counts.ravel().astype(np.int64))),
                "weight": pa.ListArray.from_arrays(offsets, pa.array((level.counts * weights[t]).ravel()))}))
        return pa.concat_tables(parts)

    dealt = rows.mapInArrow(deal, "tree int, node long, bins binary, y binary, drawn binary")
    # So many partitions that trees spread over all cores; a set number is not coalesced.
    parts = max(trees, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(grow, NODE_SCHEMA)


def argmax_class(probabilities: Column, classes: Sequence[str]) -> Column:
    """First class of the highest probability (``max_by`` would take the last)."""
    first = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), first)


def probability_map(probabilities: Column, classes: Sequence[str]) -> Column:
    values = F.transform(probabilities, lambda p: F.bround(p, 4))
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), values)


def _packed(forest: Forest) -> list:
    """Broadcasts of the trees as flat arrays, each of at most about ``BROADCAST_BYTES`` (or of one tree).

    Trees are packed in tasks. Leaves carry class shares over the number of trees.
    """
    if forest._packs:
        return forest._packs
    scale, classes = 1.0 / forest.trees, len(forest.classes)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        node, feature, cut = (table.column(n).to_numpy() for n in ("node", "feature", "threshold"))
        weight = table.column("weight").combine_chunks().flatten().to_numpy().reshape(len(node), classes)
        by = np.argsort(node)
        node, feature, cut, weight = node[by], feature[by], cut[by], weight[by]
        left = np.where(feature >= 0, np.searchsorted(node, 2 * node), 0)
        share = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-300) * scale
        arrays = (feature.astype(np.int16), cut, left.astype(np.int32), (left + 1).astype(np.int32), share)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "bytes": [sum(a.nbytes for a in arrays)],
                         **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip("abcde", arrays)}})

    packed = forest.nodes.groupBy("tree").applyInArrow(
        pack, "tree int, bytes long, a binary, b binary, c binary, d binary, e binary")
    packed = materialize(packed, "forest-packed")
    groups: list[list[int]] = [[]]
    total = 0
    for r in packed.select("tree", "bytes").orderBy("tree").collect():  # one row per tree
        if groups[-1] and total + r["bytes"] > BROADCAST_BYTES:
            groups.append([])
            total = 0
        groups[-1].append(r["tree"])
        total += r["bytes"]
    for group in groups:
        trees = []
        for r in packed.filter(F.col("tree").isin(group)).orderBy("tree").collect():
            arrays = [np.frombuffer(r[n], dtype=d) for n, d in zip("abcde", (np.int16, np.float64, np.int32, np.int32, np.float64))]
            trees.append(walk.Flat(*arrays[:4], arrays[4].reshape(-1, classes)))
        forest._packs.append(packed.sparkSession.sparkContext.broadcast(trees))
    return forest._packs


def shares(shared, classes: int, features: Sequence[str]) -> Column:
    """Class shares added up over the trees of one broadcast, a whole Arrow batch at a time."""

    @F.arrow_udf("array<double>")
    def vote(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        ready = walk.prepared(shared.value, len(features))
        for arrays in batches:
            total = walk.summed(ready, walk.columns_of(arrays), classes)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * classes, pa.int32()), pa.array(total.ravel()))

    return vote(*[q(f) for f in features])


def score(df: DataFrame, model: Forest, classes: Sequence[str]) -> DataFrame:
    """Add ``model_prediction, confidence, class_probabilities``. Works on streams.

    A forest too large for one broadcast is walked in parts, whose shares are added.
    """
    parts = [shares(b, len(classes), model.features) for b in _packed(model)]
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    scored = df.withColumn("_p", total)
    return scored.withColumns({
        "model_prediction": argmax_class(F.col("_p"), classes),
        "confidence": F.array_max("_p"),
        "class_probabilities": probability_map(F.col("_p"), classes),
    }).drop("_p")


def importances(model: Forest) -> DataFrame:
    """``rank, feature, importance``, largest first: mean share of each feature in what a tree's splits gain."""
    gains = model.nodes.groupBy("tree", "feature").agg(F.sum(F.when(F.col("feature") >= 0, F.col("gain")).otherwise(0.0)).alias("g"))
    share = F.coalesce(F.try_divide("g", F.sum("g").over(Window.partitionBy("tree"))), F.lit(0.0))
    each = gains.withColumn("s", share).filter("feature >= 0").groupBy("feature").agg(F.sum("s").alias("s"))
    spark = model.nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(model.features)), "feature int, name string")
    every = Window.partitionBy()  # one row per feature
    value = F.coalesce(F.try_divide(F.coalesce("s", F.lit(0.0)), F.sum("s").over(every)), F.lit(0.0))
    table = names.join(F.broadcast(each), "feature", "left").select("feature", "name", value.alias("importance"))
    rank = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    return table.select(rank.alias("rank"), F.col("name").alias("feature"), "importance")


def soundness(model: Forest) -> DataFrame:
    """Per tree and class: draws at the root and in the leaves, and nodes whose children do not add up to them."""
    counts = model.nodes.select("tree", "node", "feature", F.posexplode("drawn").alias("c", "n"))
    leaf, root = F.col("feature") < 0, F.col("node") == 1
    # Inner nodes and pairs of children meet under the number of the parent.
    own = F.when(~leaf, F.col("n")).otherwise(0)
    at_parent = counts.select("tree", "c", F.shiftright("node", 1).alias("at"), F.col("n").alias("below"), F.lit(0).alias("own")).filter("at > 0")
    both = at_parent.unionByName(counts.filter(~leaf).select("tree", "c", F.col("node").alias("at"), F.lit(0).alias("below"), own.alias("own")))
    broken = both.groupBy("tree", "c", "at").agg(F.sum("below").alias("b"), F.sum("own").alias("o")).groupBy("tree", "c").agg(
        F.count_if(F.col("b") != F.col("o")).alias("broken"))
    sums = counts.groupBy("tree", "c").agg(F.sum(F.when(root, F.col("n")).otherwise(0)).alias("drawn"),
                                           F.sum(F.when(leaf, F.col("n")).otherwise(0)).alias("in_leaves"))
    named = F.element_at(F.array(*[F.lit(x) for x in model.classes]), F.col("c") + 1)
    return sums.join(broken, ["tree", "c"], "left").select("tree", named.alias("class"), "drawn", "in_leaves",
                                                           F.coalesce("broken", F.lit(0)).alias("broken"))


def save(model: Forest, path: str) -> None:
    model.nodes.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, features: Sequence[str], classes: Sequence[str], trees: int, max_depth: int, rows: int) -> Forest:
    return Forest(spark.read.parquet(path), tuple(features), tuple(classes), trees, max_depth, rows)
