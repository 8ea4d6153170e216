import hashlib
import random
import zlib

import numpy as np
from tidewatch.llm.periods import Ranks, Wavelet, op12_periodic_runs, periodic_runs, runs


def brute(words):
    """(start, length, period) of every run, each shift compared word by word."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    words, size, kinds = [], rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
    while len(words) < size:
        part = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.4:
            part = part * rng.randint(1, 5) + [rng.randrange(kinds)]
        words += part * rng.randint(1, 6)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        docs = [made(rng) for _ in range(rng.randint(1, 4))]
        sizes = [len(d) for d in docs]
        first = np.concatenate([[0], np.cumsum(sizes)])
        found = runs(np.array([w for d in docs for w in d], dtype=np.int64), np.repeat(np.arange(len(docs)), sizes))
        got = sorted(zip(found.start.tolist(), (found.end - found.start).tolist(), found.period.tolist()))
        assert got == sorted((s + int(f), n, q) for d, f in zip(docs, first) for s, n, q in brute(d))


def test_ranks_sort_suffixes_and_wavelet_finds_successors():
    rng = random.Random(6)
    words = np.array([rng.randrange(3) for _ in range(300)])
    ranks = Ranks(words, np.zeros(300, dtype=np.int64))
    assert ranks.order.tolist() == sorted(range(300), key=lambda i: words[i:].tolist())
    tree = Wavelet(ranks.order)
    for _ in range(200):
        a, b, x = rng.randrange(300), rng.randrange(301), rng.randrange(300)
        a, b = min(a, b), max(a, b)
        below = tree.below(np.array([a]), np.array([b]), np.array([x]))[0]
        part = sorted(ranks.order[a:b].tolist())
        assert below == sum(v < x for v in part)
        if below < len(part):
            assert tree.smallest(np.array([a]), np.array([b]), np.array([below]))[0] == part[below]


def test_one_word_for_a_whole_text(spark):
    docs = spark.createDataFrame([(1, "x " * 20_000), (2, "a b " * 3000 + "c"), (3, "x x x x x"), (4, "x x x x x x")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.starts, r.lengths, r.periods, bytes(r.collapsed).decode())
           for r in periodic_runs(docs).select("row.doc_id", "found.*").collect()}
    assert got == {1: ([0], [20_000], [1], "x"), 2: ([0], [6000], [2], "a b c"), 3: ([], [], [], "x x x x x"), 4: ([0], [6], [1], "x")}


def test_query_equals_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op12_periodic_runs(spark, small).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 3
    for r in rows:
        words = (texts[r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        words = [w.decode() for w in words]
        found = brute(words)
        best = max(found, key=lambda f: (f[1], -f[0], -f[2]), default=None)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()


def test_odd_rows(odd, nothing):
    found = periodic_runs(odd)
    assert found.select("row.*").columns == odd.columns
    rows = found.select("row.doc_id", "found.*").collect()
    assert len(rows) == odd.count() and all(r.starts == [] for r in rows)
    assert {(r.doc_id, r.n_words) for r in rows} >= {(1, 0), (2, 0), (3, 0), (4, 1), (7, 30_000)}
    assert periodic_runs(nothing).count() == 0
