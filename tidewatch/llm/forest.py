"""Nearest vectors by cosine, through forests of hash prefixes.

Vectors are dealt to shards of bounded size. In a shard every tree is a sorted array
of long hash strings (signs of random projections). A query finds its place in every
tree, which is its longest prefix match, and all trees then ascend together, one bit
at a time, until enough entries share a prefix with the query; those are scored with
the exact cosine. Queries come in blocks of bounded size, each block to every shard,
and only the few best of a shard leave it.

Equal vectors are one entry with its least ids, so a vector that makes up a third
of the table neither fills a shard's prefixes nor multiplies the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col, materialize

TREES, BITS = 128, 32
VISITS = 4000         # entries met over all trees of a shard before the ascent ends
SHARD_ROWS = 8192
QUERY_BLOCK = 4096


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits)).astype(np.float32)
        self.planes, self.trees, self.bits = planes, trees, bits
        keys = self.keys(vectors)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors.astype(np.float32) @ self.planes > 0).reshape(len(vectors), self.trees, self.bits)
        weight = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return signs.astype(np.int64) @ weight

    def candidates(self, queries: np.ndarray, visits: int) -> Iterator[np.ndarray]:
        """Per query the entries of the deepest common level with enough of them."""
        keys = self.keys(queries)
        low = np.zeros((len(keys), self.trees), dtype=np.int64)
        high = np.full((len(keys), self.trees), len(self.order), dtype=np.int64)
        todo = np.arange(len(keys))
        for level in range(1, self.bits + 1):  # descend while enough entries stay
            rest = self.bits - level
            start = (keys[todo] >> rest) << rest
            a, b = np.empty_like(start), np.empty_like(start)
            for t in range(self.trees):
                a[:, t] = np.searchsorted(self.sorted[:, t], start[:, t])
                b[:, t] = np.searchsorted(self.sorted[:, t], start[:, t] + (1 << rest))
            enough = (b - a).sum(axis=1) >= visits
            todo, a, b = todo[enough], a[enough], b[enough]
            if not len(todo):
                break
            low[todo], high[todo] = a, b
        for q in range(len(keys)):
            mark = np.zeros(len(self.order), dtype=bool)
            for t in range(self.trees):
                mark[self.order[low[q, t]:high[q, t], t]] = True
            yield np.flatnonzero(mark)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(id, v)`` of vectors with an id, a direction and finite components."""
    v = F.transform(col(embedding), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("v", lambda x: x != 0)
    return vectors.select(col(vec_id).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").filter(ok & some)


def nearest(vectors: DataFrame, is_query, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
            trees: int = TREES, bits: int = BITS, visits: int = VISITS, shard_rows: int = SHARD_ROWS,
            block: int = QUERY_BLOCK, seed: int = 29) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query row.

    ``is_query`` is a condition on ``id``. Ties go to the smaller id. Vectors without
    id, NULL, zero or with NULL or non-finite components take no part; vectors are
    compared with those of their own length only; repeated rows count once. Fewer
    candidates give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding).distinct()
    # The k+1 least ids of equal vectors: k besides the query's own.
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("r", order).filter(F.col("r") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    few = materialize(few.withColumn("key", F.xxhash64("v")), "forest-vectors")
    entries = few.repartition(max(1, -(-few.count() // shard_rows)), "key").select("v", "ids")
    asked = materialize(rows.filter(is_query).select("id", "v", F.xxhash64("v").alias("key")), "forest-queries")
    wanted = asked.select("key", "v").dropDuplicates(["key"])
    blocks = -(-wanted.count() // block)

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                while batch.num_rows:
                    part = batch.slice(0, shard_rows - n)
                    held.append(part)
                    n += part.num_rows
                    batch = batch.slice(part.num_rows)
                    if n == shard_rows:
                        yield from shard(held)
                        held, n = [], 0
            if held:
                yield from shard(held)

        def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            vs, ids = whole.column("v").to_pylist(), whole.column("ids").to_pylist()
            keys, asking = shared.value
            out: list[tuple] = []
            for size in sorted({len(v) for v in asking} & {len(v) for v in vs}):
                at = [i for i, v in enumerate(vs) if len(v) == size]
                x = np.array([vs[i] for i in at], dtype=np.float64)
                # Scaled first, so no square leaves the range of doubles.
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                which = [i for i, v in enumerate(asking) if len(v) == size]
                q = np.array([asking[i] for i in which], dtype=np.float64)
                q /= np.abs(q).max(axis=1, keepdims=True)
                q /= np.linalg.norm(q, axis=1, keepdims=True)
                least = np.array([ids[i][0] for i in at])
                forest = Forest(x, trees, bits, seed)
                for i, found in zip(range(len(q)), forest.candidates(q, visits)):
                    score = x[found] @ q[i]
                    if len(score) > 4 * k + 4:  # ties with the last place stay in
                        near = score >= np.partition(score, -(k + 1))[-(k + 1)]
                        found, score = found[near], score[near]
                    for j in np.lexsort((least[found], -score))[:k + 1].tolist():
                        out += [(keys[which[i]], one, float(score[j])) for one in ids[at[found[j]]]]
            names = ["key", "vec_id", "score"]
            cols = zip(*out) if out else ((), (), ())
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        return run

    results = None
    for b in range(blocks):
        got = wanted.filter(F.pmod("key", F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((got.column("key").to_pylist(), got.column("v").to_pylist()))
        part = entries.mapInArrow(search(shared), "key long, vec_id long, score double")
        results = part if results is None else results.union(part)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by = [F.col("score").desc(), F.col("vec_id")]
    best = F.row_number().over(Window.partitionBy("key").orderBy(*by))
    best = materialize(results.withColumn("r", best).filter(F.col("r") <= k + 1), "forest-best")
    pairs = asked.select(F.col("id").alias("query_id"), "key").join(best, "key").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op9_nearest_vectors")
def op9_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
