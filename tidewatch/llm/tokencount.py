"""Unigram token counts, by forward scores shared along a trie of pre-tokens.

A pre-token is a word mark and a run of characters other than white space. The best
split of a pre-token into pieces of the vocabulary is found by dynamic programming
from the left, so two pre-tokens with a common prefix share all scores up to its
end: they are kept on the nodes of a trie, each computed once, and the terminal
nodes hold the token counts. Each worker keeps its trie from batch to batch and
starts a new one when it reaches its bound.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.registry import query, table
from tidewatch.llm.text import annotate, chunks, fields, structs

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
MAX_NODES = 1_000_000     # per worker; some 200 MB
MAX_SHARED = 256          # longer pre-tokens are scored without being kept
UNKNOWN_GAP = 10.0        # how far a byte scores below the rarest piece
FOUND = fields(n_tokens="long", n_pretokens="long")


def vocabulary(path: str | None = None) -> dict[str, float]:
    """Pieces with log probabilities from their rank (Zipf), as the file orders them.

    ``path`` names a sentencepiece model; by default the public one that is installed.
    Control, byte and unused pieces are left out.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
           and model.get_score(i) > -1e8]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    norm = math.log(sum(1.0 / (r + 1) for r in range(len(ids))))
    return {model.id_to_piece(i): -math.log(r + 1) - norm for r, i in enumerate(ids)}


class Trie:
    """Forward scores by prefix; node 0 is the empty prefix."""

    def __init__(self, scores: Mapping[str, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=0)
        self.byte = min(scores.values(), default=0.0) - UNKNOWN_GAP
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def _step(self, text: str, end: int, best: list[float], tokens: list[int], at: list[int]) -> tuple[float, int]:
        """Best score and its tokens for ``text[:end]``; ``at[i]`` is where prefix i is kept.

        Of equal scores the one of fewer tokens. A character in no piece is its bytes.
        """
        top, count, scores = -math.inf, 0, self.scores
        for start in range(max(0, end - self.longest), end):
            score = scores.get(text[start:end])
            if score is None:
                if start != end - 1:
                    continue
                size = len(text[start].encode("utf-8", "replace"))
                score, step = self.byte * size, size
            else:
                step = 1
            node = at[start]
            value, n = best[node] + score, tokens[node] + step
            if value > top or (value == top and n < count):
                top, count = value, n
        return top, count

    def insert(self, word: bytes) -> int:
        text = MARK + word.decode("utf-8", "replace")
        if len(text) > MAX_SHARED:
            best, tokens, at = [0.0], [0], range(len(text) + 1)
            for end in range(1, len(text) + 1):
                value, n = self._step(text, end, best, tokens, at)
                best.append(value)
                tokens.append(n)
            return tokens[-1]
        if len(self.best) >= self.max_nodes:
            self.clear()
        node, path = 0, [0]
        for end, char in enumerate(text, 1):
            key = (node << 21) | ord(char)
            following = self.child.get(key)
            if following is None:
                value, n = self._step(text, end, self.best, self.tokens, path)
                following = self.child[key] = len(self.best)
                self.best.append(value)
                self.tokens.append(n)
            node = following
            path.append(node)
        self.terminal[word] = self.tokens[node]
        return self.tokens[node]

    def count(self, words: list[bytes]) -> int:
        total, known = 0, self.terminal.get
        for w in words:
            n = known(w)
            if n is None:
                n = self.insert(w)
                known = self.terminal.get
            total += n
        return total


_TRIES: dict[int, Trie] = {}


def token_counts(docs: DataFrame, scores: Mapping[str, float], *, text: str = "text", max_nodes: int = MAX_NODES,
                 keep: list[str] | None = None) -> DataFrame:
    """``(row, found)``: tokens and pre-tokens of each whole text.

    Runs of ASCII white space separate pre-tokens and are not counted. NULL and empty
    texts have none. Repeated rows count alike; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(scores))
    key = hash((frozenset(scores.items()), max_nodes))

    def work(texts: pa.Array) -> pa.Array:
        trie = _TRIES.get(key)
        if trie is None:
            _TRIES.clear()
            trie = _TRIES[key] = Trie(shared.value, max_nodes)
        tokens, pre = [], []
        for chunk in chunks(texts):
            data, at = chunk.data.tobytes(), chunk.bounds.tolist()
            for a, b in zip(at, at[1:]):
                words = data[a:b].split()
                tokens.append(trie.count(words))
                pre.append(len(words))
        return structs(FOUND, {"n_tokens": tokens, "n_pretokens": pre})

    return annotate(docs, text, FOUND, work, keep=keep)


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), keep=["doc_id"])
    return found.select("row.doc_id", "found.n_tokens", "found.n_pretokens")
