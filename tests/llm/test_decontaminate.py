import random
import re

import pyarrow as pa

from tests.llm.conftest import LONG, ODD
from tidewatch.llm import decontaminate
from tidewatch.llm.decontaminate import contamination, decontaminated
from tidewatch.llm.text import chunks
from tidewatch.llm.text import words as text_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(window, len(b))
        wins = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1 if b else 0):
            if tuple(w[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def test_equals_brute_force(spark, odd, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("Za", "ñu", "re", "x9") for b in ("", "t", "é")]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90)))) for i in range(120)]
    items = [(i, docs[i][1][5:120]) for i in range(0, 40, 3)] + [(77, "za ZA"), (78, "zat"), (79, ""), (80, None), (None, docs[9][1])]
    items += [(81, LONG[3000:3400]), (3, docs[3][1][5:120]), (82, docs[5][1]), (83, docs[5][1])]
    docs += [(500 + i, r[1]) for i, r in enumerate(ODD)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (8 << 20, 400):  # one block, and many
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (block,))
        got = contamination(table, bench).select("row.doc_id", "row.text", "found.*").collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items)


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(25)) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "q " + " ".join(f"w{i}" for i in range(3, 22)) + " q")], "item_id long, text string")
    r = contamination(docs, bench).select("found.*").first()
    assert (r["longest_words"], r["longest_item"], r["longest_at"], r["n_hit"]) == (19, "5", 5, 19)


def test_longest_match_through_shared_passages(spark):
    rng = random.Random(5)
    w = [f"w{i}" for i in range(30)]
    few = [[rng.choice("abc") for _ in range(60)] for _ in range(6)]
    items = [(1, ["q"] + w[8:22] + ["q"]), (2, ["r"] + w), (3, w[10:21] + w[10:21]), (4, ["s", "t"])]
    items += [(10 + i, f[5:45]) for i, f in enumerate(few)] + [(20 + i, f[:25] + few[i - 1][20:50]) for i, f in enumerate(few)]
    docs = [(0, ["x"] + w + ["y"]), (1, ["s", "t", "y"]), (2, ["a"] * 9)] + [(3 + i, f + few[i - 2]) for i, f in enumerate(few)]
    got = contamination(spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string"),
                        spark.createDataFrame([(i, " ".join(b)) for i, b in items], "item_id long, text string"))
    got = {r["doc_id"]: r for r in got.select("row.doc_id", "found.*").collect()}
    texts = [f" {' '.join(b)} " for _, b in items]
    for i, d in docs:
        runs = [(n, -at) for at in range(len(d)) for n in range(1, len(d) - at + 1)
                for t, (_, b) in zip(texts, items) if n >= min(10, len(b)) and f" {' '.join(d[at:at + n])} " in t]
        n, at = max(runs, default=(0, None))
        assert got[i]["longest_words"] == n and got[i]["longest_at"] == (None if at is None else -at)
        named = dict((str(k), f" {' '.join(b)} ") for k, b in items).get(got[i]["longest_item"])
        assert not n or f" {' '.join(d[-at:-at + n])} " in named
    assert (got[0]["longest_words"], got[0]["longest_item"]) == (30, "2")


def test_one_block_in_memory_at_a_time():
    class Kept:  # a broadcast as a worker sees it
        def __init__(self, block):
            self.block = block

        @property
        def value(self):
            if not hasattr(self, "_value"):
                assert not any(hasattr(b, "_value") for b in blocks)
                self._value = self.block._replace(flat=self.block.flat.copy())
            return self._value

    texts = [" ".join(f"w{i}" for i in range(n, n + 12)) for n in (0, 20, 40)]
    blocks = [Kept(decontaminate.block_of([i], pa.array([t]), 10)) for i, t in enumerate(texts)]
    shard = next(chunks(pa.array([texts[1] + " " + texts[2]])))
    for _ in range(2):
        found = decontaminate.scan(text_words(shard), decontaminate.one_by_one(blocks), 10)
        assert found["items"] == [["1", "2"]] and found["n_hit"] == [24]
    assert not any(hasattr(b, "_value") for b in blocks)


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog sat on the log")], "item_id long, text string")
    got = decontaminated(odd, bench)
    assert got.columns == odd.columns and got.count() == len(ODD) - 3
    assert decontaminated(odd, bench.limit(0)).count() == len(ODD) and decontaminated(nothing, bench).count() == 0
