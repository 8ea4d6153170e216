import re

import numpy as np

from tests.llm.conftest import ODD
from tidewatch.llm.pii import KINDS, best_apart, find_personal, loose, luhn, strict, written

PATTERNS = [re.compile(x) for x in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
TEXTS = [
    "a@b.c@d.e @x.y b@c d%e+f@g-h.i.j", "x@@y.z.w@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.0003.4 999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111", "+1 (736) 555-2678 +1+22 345 6789) +12 3",
    "\U0001F600 +49 (0)30 123456-78 \U0001F600 é@é.é a.b@c.d.", "7" * 5000, "a" * 5000 + "@b.cc", "1-1 1-1", "1.1.1.255 1.1.1.256",
]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and luhn(d), 8 <= len(d) <= 15][k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_strict_equals_plain_search():
    for text in [*TEXTS, *(r[1] or "" for r in ODD), " ".join(TEXTS)]:
        assert sorted(tuple(f) for f in strict(text)[0]) == plain(text), text[:60]


def test_odd_rows(odd, nothing):
    got = find_personal(odd)
    rows = got.select("row.doc_id", "row.text", "row.spans", got["base"], got["spans"].alias("s")).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "clash" for r in rows)
    for r in rows:
        assert [tuple(s) for s in r["base"]] == plain(r["text"] or "")
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["s"]))
    assert find_personal(nothing).count() == 0


def test_trees_add_spans_of_the_same_format(spark):
    """Numbers formatted like known phones are selected though they lack the plus; look-alikes are not."""
    rows = [(i, f"please call +1 ({200 + i % 700}) 555-{1000 + i} today") for i in range(400)]
    rows += [(1000 + i, f"item +{i % 10}{'-0' * (i % 3 + 12)}.0.0.0.{i}-{i} in stock, ref 77{i}-{i * 7} x") for i in range(400)]
    rows += [(5000, "phone (212) 555-0134 today"), (5001, "nothing here")]
    got = find_personal(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("row.doc_id", "base", "spans")
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(by[5000]["base"]) == 0 and len(by[5000]["spans"]) == 1 and not by[5001]["spans"]
    assert all(len(by[i]["base"]) == 1 for i in range(400))


def card(n):
    body = f"4{n * 7919 % 10 ** 14:014d}"
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_planted_loose_spans(spark):
    """Forms that no strict pattern takes are learned from strict matches alone; other numbers and prose stay."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abdeilnorst"), 5))
    rows = []
    for i in range(1200):
        c = card(i)
        what = [f"{word()}.{i}@mail{i % 9}.example.com", ".".join(map(str, rng.integers(0, 256, 4))), c,
                f"+1 ({200 + i % 700}) 555-{1000 + i}"][i % 4]
        rows.append((i, f"{word()} {word()} {what} {word()}, {word()} {i * 37}. {word()}"))
    c = card(77)
    planted = {
        5000: ("phone", "(212) 555-0134"), 5001: ("phone", "1-212-555-0134"), 5002: ("card", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"),
        5003: ("email", "jo.doe (at) mail3.example.com"), 5004: ("email", "jo.doe at mail3 dot example dot com"),
        5005: ("ip", "10[.]20[.]131[.]244"), 5006: ("ip", "210-20-131-244")}
    rows += [(k, f"{word()} {word()} {v} {word()} {word()}") for k, (_, v) in planted.items()]
    clean = ["look at the house. Then go", "paid 12 on 2023-05-01 and 300", "room 12-34-56, floor 7", f"serial {'12345' * 5} x", "1, 2, 3, 4"]
    rows += [(6000 + i, t) for i, t in enumerate(clean)]
    rows += [(7000, f"{word()} (212) 555-0134 415-555-9999 {word()}"), (7001, f"{word()} {card(5)} {card(6)} {word()}")]
    got = find_personal(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "base", "spans", written("spans").alias("w"))
    by, texts = {r["doc_id"]: r for r in got.collect()}, dict(rows)
    for k, (kind, v) in planted.items():
        at = texts[k].index(v)
        assert not by[k]["base"] and f"{kind}:{at}:{at + len(v)}" in by[k]["w"].split(","), (k, by[k]["w"])
    assert not [by[6000 + i]["w"] for i in range(len(clean)) if by[6000 + i]["w"]]
    assert [texts[7000][s[1]:s[2]] for s in by[7000]["spans"] if s[0] == 3] == ["(212) 555-0134", "415-555-9999"]
    assert [texts[7001][s[1]:s[2]] for s in by[7001]["spans"]] == [card(5), card(6)] and not by[7001]["base"]
    assert all(len(by[i]["base"]) == 1 and by[i]["base"] == by[i]["spans"] for i in range(1200))


def test_generators_overlap():
    text = "415-555-1234 415-555-9999"
    assert {(0, 12), (13, 25), (4, 16)} <= {(f.start, f.end) for f in loose(text) if f.kind == 3}
    assert not list(loose("7" * 5000)) and len(list(loose("12 " * 3000))) < 7 * 3000


def test_best_apart():
    assert best_apart([(1.0, 3, 0, 9, 0), (2.0, 3, 5, 12, 1), (0.5, 3, 12, 20, 2), (0.1, 2, 0, 9, 3), (2.0, 3, 4, 12, 4)]) == [3, 4, 2]
    assert best_apart([]) == []


def test_written(spark):
    df = spark.createDataFrame([([(0, 1, 2), (3, 0, 9)],)], "s array<struct<kind:int,start:int,end:int>>")
    assert df.select(written("s")).first()[0] == "email:1:2,phone:0:9" and len(KINDS) == 4


def test_query_counts_each_kind(spark, small, tmp_path):
    from tidewatch.llm.catalog import QUERIES

    spark.createDataFrame([(1, "a@b.cc 1.2.3.4 5.6.7.8 +1 555 010 9999"), (2, None), (3, "4111 1111 1111 1111")],
                          "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in QUERIES["op3_personal_data"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2, 0, 1), 2: (0, 0, 0, 0), 3: (0, 0, 1, 0)}


def test_every_labelled_span_teaches(spark):
    """3,000 different addresses are 3,000 windows, and all cases of their views are counted."""
    from tidewatch.llm import pii
    from tidewatch.llm.text import annotate

    rows = [(f"write to user{i}@host{i % 50}.example.com or not",) for i in range(3000)]
    docs = spark.createDataFrame(rows * 2, "text string").repartition(3)
    windows = pii._windows(annotate(docs, "text", pii.PROPOSED, pii.proposed).select("found.*"))
    assert windows.count() == 3000
    want = sum(len(list(pii.cases(r.w_kind, r.w_good, r.w_text, r.w_at, r.w_size))) for r in windows.collect())
    assert pii._cases(windows).groupBy().sum("n").first()[0] == want > 3000


def test_a_few_cases_take_one_task_whatever_the_partitions(spark, monkeypatch):
    """Blocks follow the number of cases, not the files that a shuffle of many partitions leaves."""
    from tidewatch.llm import pii

    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (2000, pii.FEATURES)).astype(float)
    rows = [(i % 2, v, 1 + i % 3) for i, v in enumerate(x.tolist())]
    train = spark.createDataFrame(rows, "y int, x array<float>, n long").repartition(40)
    edges = [np.arange(8) + 0.5] * pii.FEATURES
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        few = pii._blocks(train, edges)
        monkeypatch.setattr(pii, "PART", 500)
        more = pii._blocks(train, edges)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert few.getNumPartitions() == 1 and few.count() == 1 and more.getNumPartitions() == 4
    want = sorted((v.astype(np.uint8).tobytes(), float(y), float(n)) for (y, _, n), v in zip(rows, x))
    for blocks in (few, more):
        got = blocks.collect()
        assert sorted((r.tobytes(), a, b) for bins, y, n in got for r, a, b in zip(bins, y, n)) == want
