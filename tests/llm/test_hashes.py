"""Texts that collide under every polynomial modulo a power of two are told apart."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_decontaminate import brute as contaminated
from tidewatch.llm import decontaminate, neardup, substrings
from tidewatch.llm.text import chunks, prefix_hashes, span_hash, words


def thue_morse(n, zero, one, flip=0, gap=""):
    return gap.join(one if bin(i).count("1") % 2 ^ flip else zero for i in range(n))


WORDS = [thue_morse(2048, "a", "b", flip) for flip in (0, 1)]
TEXTS = [thue_morse(2048, "alpha", "beta", flip, " ") for flip in (0, 1)]


def test_words_and_spans():
    found = words(next(chunks(pa.array(WORDS))))
    assert len(set(found.hashes.tolist())) == 2
    data = np.frombuffer("".join([*WORDS, WORDS[0]]).encode(), dtype=np.uint8)
    at = np.arange(0, 3 * 2048, 2048)
    a, b, c = span_hash(prefix_hashes(data), at, at + 2048).tolist()
    assert a == c != b


def test_every_span_of_a_text_equals_it_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    start = rng.integers(0, 380, 500)
    end = start + rng.integers(1, 20, 500)
    spans = span_hash(prefix_hashes(data), start, end).tolist()
    alone = [span_hash(prefix_hashes(data[a:b]), np.array([0]), np.array([b - a]))[0] for a, b in zip(start, end)]
    assert spans == [int(x) for x in alone]
    assert len(set(spans)) == len({data[a:b].tobytes() for a, b in zip(start, end)})


def test_a_word_hits_itself_only(spark):
    docs = spark.createDataFrame(list(enumerate([*WORDS, "x " + WORDS[1]])), "doc_id long, text string")
    bench = spark.createDataFrame([("i", WORDS[1])], "item_id string, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, bench).select("row.doc_id", "found.n_hit").collect()}
    assert got == {0: 0, 1: 1, 2: 1} == {i: contaminated(t, [("i", WORDS[1])])[1] for i, t in enumerate([*WORDS, "x " + WORDS[1]])}


def test_texts_are_nodes_of_their_own(spark):
    signed = neardup.signed(pa.array([*TEXTS, TEXTS[0]]))
    nodes, second = (signed.field(i).to_pylist() for i in (0, 1))
    assert nodes[0] == nodes[2] != nodes[1] and second[0] == second[2] != second[1] and nodes[0] != second[0]


def test_nodes_of_several_texts_are_parted(spark):
    sig = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 2), (4, 8, 5), (5, None, None)], "id long, node long, node2 long")
    got = {r["id"]: r["node"] for r in neardup.told_apart(sig).collect()}
    assert got[1] != got[2] == got[3] and got[4] == 8 and got[5] is None and len({got[1], got[2], got[4]}) == 3


@pytest.mark.parametrize("hot", [50_000, 0])
def test_strings_repeat_only_if_equal(spark, hot):
    docs = spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string")
    got = substrings.without_repeats(docs, length=1500, gram=50, hot=hot).select("row.doc_id", "found.n_removed").collect()
    seen = [w[i:i + 1500] for w in WORDS for i in range(len(w) - 1499)]
    assert len(set(seen)) == len(seen) and all(r["n_removed"] == 0 for r in got)
