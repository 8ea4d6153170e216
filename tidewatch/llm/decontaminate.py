"""Benchmark passages in training documents, by suffix arrays over the documents.

Each shard of documents (some megabytes of whole texts, inside a task) is turned
into a word-level suffix array. Every suffix of every benchmark item is looked up
in every shard by binary search; the range found holds all places where its first
ten words stand. The longest verbatim match comes from a second suffix array, over
the hit words of a shard and every place of the benchmark where their windows stand.
Nothing is shuffled: a document lies in one shard. The benchmark is cut into blocks
of bounded size, each broadcast and searched in turn, with one of them in a task's
memory at a time, so it may grow as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col
from tidewatch.llm.text import Words, annotate, chunks, fields, grams, structs, words

WINDOW = 10
SHARD_BYTES = (1 << 20) - 2  # of text; a task needs some 100 times as much
BLOCK_BYTES = 8 << 20
SLICE = 1 << 16

FOUND = fields(n_words="long", n_hit="long", items="string[]", longest_words="long", longest_item="string",
               longest_at="long")


class Block(NamedTuple):
    """Distinct windows of some items: words ``flat[start:start+length]``, and who holds them."""
    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray
    held_from: np.ndarray   # items of window w: held[held_from[w]:held_from[w+1]]
    held: np.ndarray
    names: list[str]
    placed_from: np.ndarray  # places of window w in flat: placed[placed_from[w]:placed_from[w+1]]
    placed: np.ndarray
    bounds: np.ndarray      # words of item i: flat[bounds[i]:bounds[i+1]]


def block_of(item_ids: list, texts: pa.Array, window: int) -> Block:
    flat, starts, lengths, hashes, owners, bounds, shift, first = [], [], [], [], [], [], 0, 0
    for part in chunks(texts):
        found = words(part)
        at, h = grams(found, window)
        owner = found.owner()
        flat.append(found.hashes)
        starts.append(at + shift)
        lengths.append(np.minimum(np.diff(found.bounds)[owner[at]], window))
        hashes.append(h)
        owners.append(owner[at] + first)
        bounds.append(found.bounds[:-1] + shift)
        shift, first = shift + len(found.hashes), first + len(part)
    if not shift:
        none = np.zeros(0, dtype=np.int64)
        return Block(np.zeros(0, dtype=np.uint64), none, none, np.zeros(1, dtype=np.int64), none, [],
                     np.zeros(1, dtype=np.int64), none, np.zeros(1, dtype=np.int64))
    starts, lengths, owners = np.concatenate(starts), np.concatenate(lengths), np.concatenate(owners)
    _, index, window_of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    pairs = np.unique(window_of.astype(np.int64) * (first + 1) + owners)
    held_from = np.searchsorted(pairs, np.arange(len(index) + 1) * (first + 1))
    placed_from = np.searchsorted(np.sort(window_of), np.arange(len(index) + 1))
    return Block(np.concatenate(flat), starts[index], lengths[index], held_from, pairs % (first + 1),
                 ["null" if i is None else str(i) for i in item_ids],
                 placed_from, starts[np.argsort(window_of, kind="stable")], np.append(np.concatenate(bounds), shift))


def blocks_of(bench: DataFrame, item_id: str, text: str, window: int, limit: int = BLOCK_BYTES) -> list:
    """Broadcasts of the benchmark, each of at most about ``limit`` bytes of text.

    Rows are dealt to blocks by hash; one block at a time passes through the driver.
    """
    spark = bench.sparkSession
    slim = bench.select(col(item_id).alias("item"), col(text).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // limit) + 1
    out = []
    for b in range(n):
        mine = F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b
        got = slim.filter(mine).toArrow()
        out.append(spark.sparkContext.broadcast(
            block_of(got.column("item").to_pylist(), got.column("text").combine_chunks(), window)))
    return out


class Shard:
    """Suffix array over the words of some texts, in the order of the first ``depth`` words.

    Words are numbered by the shard's own vocabulary; a 0 ends each text, so no
    match crosses texts.
    """

    def __init__(self, found: Words, depth: int):
        self.vocabulary, ids = np.unique(found.hashes, return_inverse=True)
        self.texts = len(found.bounds) - 1
        self.bounds = found.bounds + np.arange(self.texts + 1)  # with one 0 after each text
        self.words = np.zeros(int(self.bounds[-1]) + depth, dtype=np.int64)
        self.words[np.arange(len(ids)) + found.owner()] = ids + 1
        n = self.n = len(self.words) - depth
        bits = max(1, int(len(self.vocabulary)).bit_length())
        done = max(1, min(62 // bits, depth))
        key = np.zeros(n, dtype=np.int64)
        for i in range(done):
            key = (key << bits) | self.words[i:n + i]
        while True:
            self.order = np.argsort(key)
            if done >= depth:
                return
            ranked = key[self.order]
            rank = np.zeros(n + done, dtype=np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]])) if n else 0
            key = (rank[:n] << 31) | rank[done:]
            done *= 2

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The shard's numbers of some words; -1 for words it lacks."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def ranges(self, wanted: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part of the suffix array that starts with each row of ``wanted`` (to its length)."""
        inside = np.arange(wanted.shape[1]) < lengths[:, None]
        return self._bound(wanted, inside, False), self._bound(wanted, inside, True)

    def _bound(self, wanted: np.ndarray, inside: np.ndarray, past: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), self.n, dtype=np.int64)
        rows, steps = np.arange(len(wanted)), np.arange(wanted.shape[1])
        while True:
            todo = low < high
            if not todo.any():
                return low
            middle = (low + high) >> 1
            here = self.words[self.order[np.minimum(middle, self.n - 1)][:, None] + steps]
            gap = np.where(inside, here - wanted, 0)
            first = (gap != 0).argmax(axis=1)
            sign = gap[rows, first]
            right = (sign < 0) | ((sign == 0) if past else False)
            low, high = np.where(todo & right, middle + 1, low), np.where(todo & ~right, middle, high)


def search(shard: Shard, block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place where a window of the block stands: positions and window numbers."""
    number = shard.numbers(block.flat)
    lacking = np.concatenate([[0], np.cumsum(number < 0)])
    known = np.flatnonzero(lacking[block.start + block.length] == lacking[block.start])
    places, which = [], []
    padded = np.concatenate([number, np.zeros(window, dtype=number.dtype)])
    for i in range(0, len(known), SLICE):
        some = known[i:i + SLICE]
        wanted = padded[block.start[some][:, None] + np.arange(window)]
        low, high = shard.ranges(wanted, block.length[some])
        counts = high - low
        total = int(counts.sum())
        offset = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        places.append(shard.order[np.repeat(low, counts) + offset])
        which.append(np.repeat(some, counts))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(places), np.concatenate(which)) if places else (none, none)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``low[i]:high[i]``."""
    counts = high - low
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - low, counts)


def _covered(starts: np.ndarray, length: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions within ``length`` of some start, and where each goes if a gap follows every stretch of one text."""
    at = np.unique((starts[:, None] + np.arange(length)).ravel())
    owner = np.searchsorted(bounds, at, side="right")
    return at, np.arange(len(at)) + np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(owner) != 0))])


def extents(shard: Shard, block: Block, at: np.ndarray, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the text at each place goes on as in some item that holds the window there, and such an item.

    Both sides are cut to words under a hit window and sorted as suffixes together; the
    longest match of a place is with the nearest benchmark suffix before or behind it.
    """
    hit = np.unique(which)
    places = block.placed[_spread(block.placed_from[hit], block.placed_from[hit + 1])]
    theirs, to = _covered(places, window, block.bounds)
    ours, into = _covered(np.unique(at), window, shard.bounds)
    into = into + to[-1] + 2
    m = int(into[-1]) + 2
    rank = np.arange(m) + len(shard.vocabulary) + 1  # gaps differ from all else
    rank[to], rank[into] = shard.numbers(block.flat[theirs]), shard.words[ours]
    levels, step = [], 1
    while True:
        distinct, rank = np.unique(rank, return_inverse=True)
        levels.append(rank.astype(np.int32))
        if len(distinct) == m:
            break
        rank = rank * (m + 1) + np.concatenate([rank[step:] + 1, np.zeros(min(step, m), dtype=rank.dtype)])
        step *= 2
    order = np.empty(m, dtype=np.int64)
    order[levels[-1]] = np.arange(m)
    source = np.full(m, -1)  # the benchmark's place, by place in the joint text
    source[to] = theirs
    row, theirs_too = np.arange(m), source[order] >= 0
    before = np.maximum.accumulate(np.where(theirs_too, row, -1))
    behind = np.minimum.accumulate(np.where(theirs_too, row, m)[::-1])[::-1]
    mine = into[np.searchsorted(ours, at)]
    best, item = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for near in (before, behind):
        other = near[levels[-1][mine]]
        there = (other >= 0) & (other < m)
        partner = order[np.clip(other, 0, m - 1)]
        same = np.zeros(len(at), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            a, b = np.minimum(mine + same, m - 1), np.minimum(partner + same, m - 1)
            same += np.where(there & (levels[k][a] == levels[k][b]), 1 << k, 0)
        owner = np.searchsorted(block.bounds, source[partner], side="right") - 1
        better = (same > best) | ((same == best) & (owner < item))
        best, item = np.where(better, same, best), np.where(better, owner, item)
    return best, item


def one_by_one(blocks: list[Broadcast]) -> Iterator[Block]:
    """The blocks in turn; of several, each is unloaded before the next is read."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            del b._value  # it is read from the broadcast's file again


def scan(found: Words, blocks: Iterable[Block], window: int) -> dict[str, list]:
    """Counts, items and longest match per text of a shard."""
    n_words = np.diff(found.bounds)
    texts = len(n_words)
    out = {"n_words": n_words.tolist(), "n_hit": [0] * texts, "items": [[] for _ in range(texts)],
           "longest_words": [0] * texts, "longest_item": [None] * texts, "longest_at": [None] * texts}
    if not len(found.hashes):
        return out
    shard = Shard(found, window)
    steps = np.zeros(shard.n + 1, dtype=np.int64)
    for block in blocks:
        at, which = search(shard, block, window)
        if not len(at):
            del block
            continue
        length = block.length[which]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + length, -1)
        owner = shard.owner(at)
        pairs = np.unique(owner * len(block.start) + which)
        text_of, w = pairs // len(block.start), pairs % len(block.start)
        counts = block.held_from[w + 1] - block.held_from[w]
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        held = block.held[np.repeat(block.held_from[w], counts) + offset]
        both = np.unique(np.repeat(text_of, counts) * (len(block.names) + 1) + held)
        for p in both.tolist():
            out["items"][p // (len(block.names) + 1)].append(block.names[p % (len(block.names) + 1)])
        item = block.held[block.held_from[which]]
        whole = np.flatnonzero(length == window)  # a shorter window is an item's whole text
        if len(whole):
            length[whole], item[whole] = extents(shard, block, at[whole], which[whole], window)
        order = np.lexsort((item, at, -length, owner))
        for i in order[np.concatenate([[True], np.diff(owner[order]) != 0])].tolist():
            text = int(owner[i])
            if length[i] > out["longest_words"][text]:
                out["longest_words"][text] = int(length[i])
                out["longest_item"][text] = block.names[int(item[i])]
                out["longest_at"][text] = int(at[i] - shard.bounds[text])
        del block
    hit = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    out["n_hit"] = (hit[shard.bounds[1:]] - hit[shard.bounds[:-1]]).tolist()
    out["items"] = [sorted(set(i)) for i in out["items"]]
    return out


def contamination(docs: DataFrame, bench: DataFrame, *, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """``(row, found)`` per document: words, hit words, items and the longest verbatim match.

    A window is ``window`` consecutive item words, or a shorter item as a whole;
    items without words (NULL, empty) have none. A text that is NULL or has no word
    is never hit. Repeated items count once per id; an item without an id is named
    ``null``. ``longest_at`` counts words from 0. Empty tables give no rows, or no hits.
    """
    blocks = blocks_of(bench, item_id, item_text, window)

    def work(texts: pa.Array) -> pa.Array:
        parts: dict[str, list] = {f.name: [] for f in FOUND}
        for shard in chunks(texts, SHARD_BYTES):
            for name, values in scan(words(shard), one_by_one(blocks), window).items():
                parts[name] += values
        return structs(FOUND, parts)

    return annotate(docs, text, FOUND, work, keep=keep)


def decontaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents, all columns, without those that hold a window of the benchmark."""
    return contamination(docs, bench, **options).filter("found.n_hit = 0").select("row.*")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_decontaminate", f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
  k AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
    FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS p FROM i)),
  d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM k),
  q AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
    FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes)),
  m AS (SELECT rid, p, n, item_id FROM q JOIN k USING (n, win)),
  h AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS x FROM m) GROUP BY 1),
  t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)""")
def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"))
