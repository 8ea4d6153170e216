import math
import random
import re
from collections import Counter

from tidewatch.llm import ranking
from tidewatch.llm.ranking import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    rows, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in counts:
            m = 50 + (50 * n * rows) // total
            score = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 20 * m))
                        for w in set(words(text)) if w in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out)


def got(spark, docs, items, k, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked(docs, items, k=k, **options).collect()), key=lambda r: r[:2])


def test_equals_brute_force_over_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 16)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]

    def text(n):
        return " ".join(rng.choices(vocabulary, weights, k=n))

    docs = [(i, text(rng.randint(0, 40))) for i in range(400)] + [(400 + i, "w7 w8 w9 and more") for i in range(90)]
    items = [(i, text(rng.randint(1, 30))) for i in range(20)] + [(20, "w7 w8 w9"), (21, "nowhere"), (22, "")]
    for k in (1, 5, 50):
        assert got(spark, docs, items, k) == brute(docs, items, k)
    assert got(spark, docs, items, 5, group_bytes=200) == brute(docs, items, 5)


def test_a_floor_lets_in_what_reaches_it():
    group = ranking.Group([0], [b"a", b"b", b"c"], [ranking.np.array([0, 1, 2])])
    plan = ranking.Plan(group, ranking.np.array([10, 20, 30]), ranking.np.array([[0, 1], [0, 2], [1, 2]]),
                        [ranking.np.array([0, 1, 2])], 4, 10)
    owner, terms = ranking.np.array([0, 1, 1, 2, 3]), ranking.np.array([0, 1, 2, 2, 1])
    made = ranking.indexed([5, 6, 7, 8], ranking.np.array([1, 2, 1, 1]), owner, terms, ranking.np.ones(5, dtype=int), plan, 1)
    block = ranking.Block({f: ranking.np.asarray(v) for f, v in made.items()})
    whole = dict(zip(*(x.tolist() for x in ranking.best_of(block, plan, 0, 1))))
    assert set(whole) == {0, 1, 2, 3}
    for floor in sorted(set(whole.values())) + [max(whole.values()) + 1]:
        found, score = ranking.best_of(block, plan, 0, floor)
        assert dict(zip(found.tolist(), score.tolist())) == {d: s for d, s in whole.items() if s >= floor}
    assert made["pair_max"][0] == 0 and made["pair_max"][2] == whole[1]  # a and b never meet, b and c do


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([("x", "the CAT"), ("x2", "ñandú wort1x1"), (None, "cat"), ("y", None)], "item_id string, text string")
    rows = ranked(odd, items).collect()
    assert [r.doc_id for r in sorted((r for r in rows if r.item_id == "x"), key=lambda r: r["rank"])] == [5, 5, 6]
    assert {r.doc_id for r in rows if r.item_id == "x2"} == {7, 9}
    assert sum(r.item_id is None for r in rows) == 3 and not any(r.item_id == "y" for r in rows)
    assert ranked(nothing, items).count() == 0 and ranked(odd, items.limit(0)).count() == 0
    assert ranked(odd, items).schema["item_id"].dataType.simpleString() == "string"
