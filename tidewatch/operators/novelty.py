"""Isolation forest over benign training rows; Spark ML has none.

Trees are grown from at most ``sample_rows`` rows each, so fitting is a sampling
job plus one small task per tree. Sampling hashes the row key once per row and gives
each tree an arc of the hash circle; arcs overlap where rows are few. Draws are bits
of md5 values of stated texts, so any engine with md5 grows the same trees.
The grown forest holds at most trees x 2 x sample_rows nodes whatever the input,
which is why it may pass through the driver; scoring is one Arrow-batched pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import walk
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.rows import q
from tidewatch.session import materialize
from tidewatch.spec import NoveltyPolicy

NODE_SCHEMA = "tree int, node long, feature int, threshold double, left long, right long, depth double"
SLACK = 2.0          # candidates drawn per wanted row
EULER = 0.5772156649015329


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _keyed(seed: int, what: Column, key: Sequence[str]) -> Column:
    parts = [F.coalesce(q(c).cast("string"), F.lit("~")) for c in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("novelty"), what, *parts))


def tree_samples(rows: DataFrame, features: Sequence[str], key: Sequence[str], n_rows: int,
                 policy: NoveltyPolicy, seed: int) -> DataFrame:
    """``tree`` and feature columns: up to ``sample_rows`` rows of each tree."""
    base = rows.select(*[q(c) for c in dict.fromkeys([*features, *key])])
    share = min(1.0, SLACK * policy.sample_rows / max(n_rows, 1))
    # Tree t draws from the arc [t/trees, t/trees + share) of the hash circle: one hash
    # per row tells its trees, few of them where the table is large.
    bits = F.conv(F.substring(_keyed(seed, F.lit("arc"), key), 1, 8), 16, 10).cast("double")
    at = bits * policy.trees / F.lit(float(1 << 32))
    last = F.floor(at).cast("int")
    first = F.greatest(F.floor(at - share * policy.trees).cast("int") + 1, last - (policy.trees - 1))
    draws = base.withColumn("_a", F.array(first, last)).filter(F.col("_a")[0] <= F.col("_a")[1]).drop("_a")
    draws = draws.select("*", F.explode(F.sequence(first, last)).alias("_e"))
    draws = draws.withColumn("tree", F.pmod("_e", F.lit(policy.trees)).cast("int")).drop("_e")
    order = F.row_number().over(Window.partitionBy("tree").orderBy(
        _keyed(seed, F.col("tree").cast("string"), key), *[q(c) for c in key]))
    return (draws.withColumn("_r", order).filter(F.col("_r") <= policy.sample_rows)
            .select("tree", *[q(f) for f in features]))


def _grow(tree: int, data: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one tree; node n splits into 2n and 2n + 1, a leaf's feature is -1."""
    limit = (max(len(data), 2) - 1).bit_length()
    nodes, todo = [], [(1, 0, data)]
    while todo:
        node, depth, rows = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or not len(splittable):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        bits = hashlib.md5(f"{seed}|split|{tree}|{node}".encode()).hexdigest()
        feature = int(splittable[int(bits[:8], 16) % len(splittable)])
        a, b = float(low[feature]), float(high[feature])
        threshold = a + int(bits[8:16], 16) / float(1 << 32) * (b - a)
        if threshold >= b:  # the sum may round up to the maximum
            threshold = a
        nodes.append((tree, node, feature, threshold, 2 * node, 2 * node + 1, depth + average_path(len(rows))))
        below = rows[:, feature] <= threshold
        todo += [(2 * node, depth + 1, rows[below]), (2 * node + 1, depth + 1, rows[~below])]
    return nodes


def fit(rows: DataFrame, features: Sequence[str], key: Sequence[str], policy: NoveltyPolicy, seed: int,
        n_rows: int | None = None) -> DataFrame | None:
    """Node table of the forest, or None when there are too few benign rows."""
    n = rows.count() if n_rows is None else n_rows
    if n < policy.min_rows:
        return None
    samples = tree_samples(rows, features, key, n, policy, seed)
    names = list(features)

    def grow(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _grow(int(key_[0]), pdf[names].to_numpy(dtype="float64"), seed)
        return pd.DataFrame(found, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def score_expression(nodes: DataFrame, features: Sequence[str], policy: NoveltyPolicy) -> Column:
    """``-2**(-E[h]/c)`` for the feature columns, as a vectorised expression.

    Collects the node table: a fitted model of bounded size, no data.
    """
    table = nodes.select("tree", "node", "feature", "threshold", "depth").orderBy("tree", "node").toArrow()
    ends = np.append(np.flatnonzero(np.diff(table.column("tree").to_numpy())) + 1, table.num_rows)
    columns = [table.column(n).to_numpy() for n in ("node", "feature", "threshold", "depth")]
    trees = []
    for i, j in zip([0, *ends[:-1]], ends):
        node, feature, threshold, depth = (c[i:j] for c in columns)
        left = np.where(feature >= 0, np.searchsorted(node, 2 * node), 0)
        trees.append(walk.flat_from_table(feature, threshold, left, left + 1, depth[:, None]))
    shared = nodes.sparkSession.sparkContext.broadcast(trees)
    scale = average_path(policy.sample_rows)

    @F.arrow_udf("double")
    def anomaly(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        ready = walk.prepared(shared.value, len(features))
        for batch in batches:
            depth = walk.summed(ready, walk.columns_of(batch), 1)[:, 0]
            yield pa.array(-np.exp2(-(depth / max(len(shared.value), 1)) / scale))

    return anomaly(*[q(f) for f in features])


def with_novelty(df: DataFrame, nodes: DataFrame, features: Sequence[str], policy: NoveltyPolicy,
                 threshold: float | None = None) -> DataFrame:
    out = df.withColumn("novelty_score", score_expression(nodes, features, policy))
    return out if threshold is None else out.withColumn("novelty_flagged", F.col("novelty_score") < threshold)


def reference(rows: DataFrame, nodes: DataFrame, features: Sequence[str], policy: NoveltyPolicy) -> DataFrame:
    """One row: threshold at the contamination quantile, median and 1st percentile.

    Scores are written once, so the passes of the exact quantile read a column
    instead of rescoring.
    """
    scored = materialize(with_novelty(rows.select(*[q(f) for f in features]), nodes, features, policy)
                         .select("novelty_score"), "novelty-scores")
    stats = exact_quantiles(scored, ["novelty_score"], [policy.contamination, 0.5, 0.01])
    return stats.select(F.col("n").alias("n_rows"), F.lit(policy.contamination).alias("contamination"),
                        F.col("values")[0].alias("threshold"), F.col("values")[1].alias("benign_score_median"),
                        F.col("values")[2].alias("benign_score_p1"))
