import hashlib
import random
from collections import Counter

import pytest

from tests.llm.conftest import ODD
from tidewatch.llm.substrings import without_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdeñ ") for _ in range(n)) for n in (25, 40, 90, 200)]
    texts = []
    for _ in range(80):
        text = "".join(rng.choice("abcdefgh ñ") for _ in range(rng.randrange(0, 150)))
        for _ in range(rng.randrange(0, 3)):
            p, at = rng.choice(passages), rng.randrange(len(text) + 1)
            text = text[:at] + p[rng.randrange(5):] + text[at:]
        texts.append(text)
    return texts + ["a" * 500, "ab" * 120, "a" * 31, None, "", texts[0], texts[0], passages[1], "x" + passages[2], "abc" * 40 + texts[3]]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_equals_brute_force(spark, hot):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = without_repeats(docs, length=30, gram=8, hot=hot).select("row.doc_id", "found.*").collect()
    want = brute(texts, 30)
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], texts[r["doc_id"]]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_odd_rows(odd, nothing):
    got = without_repeats(odd, length=40, gram=10).select("row.doc_id", "row.text", "row.spans", "found.*").collect()
    want = brute([r["text"] for r in got], 40)
    assert len(got) == len(ODD) and all(r["spans"] == "clash" for r in got)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == want
    assert without_repeats(nothing).count() == 0
