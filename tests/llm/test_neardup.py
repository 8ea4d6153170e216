import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tidewatch.llm import neardup
from tidewatch.llm.components import components
from tidewatch.llm.neardup import classes, deduplicated, probability_jaccard, registers


def shingles(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in a if i in b)


def brute(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if set(sets[i]) & set(sets[j]) and similarity(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus():
    rng, rows = random.Random(5), []
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 30, 120, 250]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(9)}"
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows.append((1000, "a a a a a a a a a a b c d e f"))
    rows.append((1001, "a a a a a a a a a a b c d e f g"))
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)
    sizes = Counter(r["class_id"] for r in got)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["first"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    for shared in (10, 60, 95):
        h = rng.integers(1, 1 << 63, 200 - shared, dtype=np.uint64)
        a, b = np.arange(100), np.concatenate([np.arange(shared), np.arange(100, 200 - shared)])
        x, y = rng.integers(1, 4, 100).astype(float), rng.integers(1, 4, 100).astype(float)
        who = registers(np.concatenate([h[a], h[b]]), np.repeat([0, 1], 100), np.concatenate([x, y]), 2, 4096)
        oa, ob = np.argsort(h[a]), np.argsort(h[b])
        exact = probability_jaccard(h[a][oa], x[oa], h[b][ob], y[ob])
        assert abs((who[0] == who[1]).mean() - exact) < 0.04
        assert exact == pytest.approx(similarity(Counter(dict(zip(h[a].tolist(), x))), Counter(dict(zip(h[b].tolist(), y)))))


def test_odd_rows(odd, nothing):
    got = classes(odd).collect()
    assert len(got) == len(ODD)
    said = {r["doc_id"]: r["class_id"] for r in got}
    assert said[1] == 1 and said[2] == 2 and said[3] == 3 and said[5] == said[6] == 5 and said[None] is None
    assert classes(nothing).count() == 0 and deduplicated(nothing).count() == 0
    kept = deduplicated(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9, None])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [2048, 7])
def test_copies_further_from_each_other_than_from_their_source(spark, monkeypatch, tile):
    """Copies at about 0.8 from their source, some linked only through one another; weights beyond 1."""
    monkeypatch.setattr(neardup, "TILE_ROWS", tile)
    rng, base = random.Random(11), [f"w{i % 90}" for i in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(rows[rng.randrange(len(rows))][1].split()) if i % 5 == 0 else list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(5)}"
        rows.append((i, " ".join(copy)))
    got = classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)
