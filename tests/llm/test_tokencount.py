import math
import random

import pytest

from tests.llm.conftest import ODD
from tidewatch.llm.tokencount import MARK, Trie, token_counts, vocabulary


def brute(text, scores):
    low = min(scores.values()) - 10.0
    total = 0
    for word in (text or "").encode().split():
        t = MARK + word.decode()
        best = [(0.0, 0)]
        for end in range(1, len(t) + 1):
            options = [(best[s][0] + scores[t[s:end]], -(best[s][1] + 1)) for s in range(end) if t[s:end] in scores]
            if t[end - 1] not in scores:
                n = len(t[end - 1].encode())
                options.append((best[end - 1][0] + low * n, -(best[end - 1][1] + n)))
            value, n = max(options)
            best.append((value, -n))
        total += best[-1][1]
    return total


@pytest.fixture(scope="module")
def scores():
    return vocabulary()


def test_counts_equal_brute_force(spark, odd, scores):
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoin shrdlué😀漢\n\t") for _ in range(rng.randrange(200))) for _ in range(60)] + ["x" * 700]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for bound in (1_000_000, 50):  # also with a trie that starts anew all the time
        for r in token_counts(docs, scores, max_nodes=bound).select("row.text", "found.*").collect():
            assert r["n_tokens"] == brute(r["text"], scores) and r["n_pretokens"] == len(r["text"].encode().split())


def test_same_split_as_a_public_unigram_model(scores):
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), *((f"<0x{b:02X}>", -1e3) for b in range(256)), *scores.items()]
    public = Tokenizer(models.Unigram(pieces, 0, True))
    trie, rng = Trie(scores), random.Random(8)
    words = ["the", "information", "retrieval", "Straßenbahn", "anthropomorphic", *("".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(200))]
    same = sum(trie.count([w.encode()]) == len(public.encode(MARK + w, add_special_tokens=False).ids) for w in words)
    assert same >= 0.99 * len(words)  # but for ties


def test_scores_are_log_probabilities(scores):
    assert math.isclose(sum(map(math.exp, scores.values())), 1.0, rel_tol=1e-9)


def test_odd_rows(odd, nothing, scores):
    got = token_counts(odd, scores).select("row.doc_id", "row.found", "row.text", "found.*").collect()
    assert len(got) == len(ODD) and all(r["found"] == "clash" for r in got)
    assert all((r["n_tokens"] == 0) == (not (r["text"] or "").strip()) for r in got)
    assert token_counts(nothing, scores).count() == 0
