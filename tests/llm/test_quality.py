import numpy as np
import pyarrow as pa
from tidewatch.llm.quality import TERMS, TIE, Model, blocks, fit, op13_quality_vote, scored, term_counts


def test_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    labelled, asked = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((300, 8)), rng.standard_normal((70, 8))))
    y = rng.integers(0, 2, 300).astype(float)
    score, nearest, voters = Model(None, None, labelled, y, 0.5).vote(asked, 9)
    for v, s, n, c in zip(asked, score, nearest, voters):
        cosine = labelled @ v
        best = np.flatnonzero(cosine >= np.sort(cosine)[-9] - TIE)
        weight = np.exp(20 * (cosine[best] - cosine.max()))
        assert np.isclose(s, (weight * y[best]).sum() / weight.sum()) and np.isclose(n, cosine.max()) and c == len(best) >= 9


def test_counts_do_not_depend_on_blocks():
    texts = ["The the the cat, 12 cats.", "", None, "ab", "Ö Ö Ö " * 200_000, "x y z"]
    whole = [term_counts(b) for b in blocks(pa.array(texts))]
    single = [term_counts(b) for t in texts for b in blocks(pa.array([t], pa.string()))]
    assert np.array_equal(np.concatenate(whole), np.concatenate(single))
    counts = np.concatenate(whole)
    assert counts.shape == (6, TERMS) and counts[1].sum() == counts[2].sum() == counts[3].sum() == 0
    assert counts[4, -1] == 599_999 and counts[0, -1] == 1  # "The" and "the" differ


def test_held_out_rows_are_told_apart(spark, small):
    path = small.replace("sf0.001", "sf0.01")
    rows = op13_quality_vote(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").collect()
    bad = [r for r in rows if r.quality == 0]
    assert len(rows) > 50 and len(bad) > 5
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_held_out_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels, sample_rows=40)
    assert len(model.labels) <= 40
    again = fit(docs, labels.repartition(5), sample_rows=40)
    assert np.array_equal(model.labels, again.labels) and np.allclose(model.vectors, again.vectors)
    doubled = fit(docs, labels.union(labels), sample_rows=40)
    assert np.array_equal(model.labels, doubled.labels)


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 1), (6, None), (99, 0), (2, 1)], "doc_id long, quality int")
    model = fit(odd, labels)
    found = scored(odd, model)
    assert found.select("row.*").columns == odd.columns
    rows = {r.doc_id: r for r in found.select("row.doc_id", "found.*").collect()}
    assert rows[5].score > 0.5 > rows[7].score
    assert np.isclose(rows[1].score, 2 / 3) and rows[1].voters == 0 and np.isclose(rows[2].score, 2 / 3)
    none = fit(odd, labels.limit(0))
    assert {r.score for r in scored(odd, none).select("found.*").collect()} == {0.5}
    assert scored(nothing, model).count() == 0
    assert len(fit(nothing, labels).labels) == 0
