import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm.forest import nearest

SCHEMA = "vec_id long, embedding array<float>, v string, key string, ids string, id string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "c", "c", "c", "c") for i, v in rows], SCHEMA)


def brute(rows, queries, k=5):
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    out = {}
    for q in queries:
        s = sorted(((-float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), i) for i, v in x.items() if i != q))
        out[q] = s[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + 0.5 * rng.standard_normal(24)).tolist()) for i in range(4000)]
    got = nearest(table(spark, rows), F.col("id") % 50 == 0, visits=1500, shard_rows=1500, block=30).collect()
    want = brute(rows, range(0, 4000, 50))
    assert len(got) == 80 * 5
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert hits >= 0.95 * len(got)
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    for r in got:
        a, b = x[r["query_id"]], x[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_small_tables_are_exact_with_ties_and_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 200, 10)] + [(i, [float(i), 1.0, 0.0]) for i in range(1, 30, 2)]
    got = nearest(table(spark, rows + rows[:4]), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [10, 20, 30, 40, 50]
    assert [r["vec_id"] for r in got if r["query_id"] == 50] == [0, 10, 20, 30, 40]
    assert [r["rank"] for r in got if r["query_id"] == 150] == [1, 2, 3, 4, 5]


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, []), (1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 1.0]), (None, [1.0, 0.1]), (5, [1.0, 0.5]), (6, [1.0, 0.5, 0.0]), (150, [2.0, 1.0, 1.0])]
    got = sorted((r["query_id"], r["vec_id"]) for r in nearest(table(spark, rows), F.col("id") % 50 == 0).collect())
    assert got == [(0, 5), (150, 6)]
    assert nearest(table(spark, rows).limit(0), F.col("id") % 50 == 0).count() == 0
