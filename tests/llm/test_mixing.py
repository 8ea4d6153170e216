import pytest
from pyspark.sql import functions as F

from tidewatch.llm.mixing import CYCLE, cycled, mix, repeated


def water(sizes, weights, epochs):
    clamped, total = set(), sum(sizes)
    while True:
        rest = total - epochs * sum(sizes[i] for i in clamped)
        weight = sum(w for i, w in enumerate(weights) if i not in clamped)
        level = rest / weight if weight else 0
        more = {i for i, w in enumerate(weights) if i not in clamped and level * w > epochs * sizes[i]}
        if not more:
            return [epochs * s if i in clamped else level * w for i, (s, w) in enumerate(zip(sizes, weights))]
        clamped |= more


@pytest.mark.parametrize("counts", [(3, 400, 50), (1, 1, 900), (200, 200, 200), (2, 3, 5, 800)])
def test_targets_and_words_taken(spark, counts):
    rows = [(100 * s + 7 * i, "w " * (1 + i % 9), f"s{s}") for s, n in enumerate(counts) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, weigh=cycled(CYCLE)).select("row.source", "size", "source_size", "target", "taken", "copies").toPandas()
    per = got.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    want = water(per["size"].tolist(), [CYCLE[i % 3] for i in range(len(counts))], 3)
    assert per["target"].tolist() == pytest.approx(want)
    assert got["size"].sum() == per["size"].sum() == pytest.approx(sum(want))
    assert (abs(per["taken"] - per["target"]) <= 9).all()  # within the longest document
    assert (got["taken"] <= 3 * got["size"]).all()


def test_odd_rows_and_reruns(odd, nothing):
    def taken():
        got = mix(odd, weigh=cycled(CYCLE))
        return got.select("row.doc_id", "row.text", F.col("row.size").alias("own"), "size", "copies", "taken", "source_size").collect()

    rows = taken()
    assert len(rows) == odd.count()
    assert all(r["own"] == "clash" for r in rows)
    assert all(r["copies"] == 0 == r["taken"] for r in rows if not (r["text"] or "").strip())
    twins = [r["copies"] for r in rows if r["doc_id"] == 5]
    assert twins[0] == twins[1]
    assert sorted(map(str, rows)) == sorted(map(str, taken()))
    assert mix(nothing, weigh=cycled(CYCLE)).count() == 0
    assert repeated(mix(odd, weigh=cycled(CYCLE))).count() == sum(r["copies"] for r in rows)
