"""Runs of repeated words, by internal pattern matching over a suffix array.

A run of period q and length 4q or more holds a dyadic block (words j*m to j*m+m,
m a power of two between 3q/4 and 3q/2) and the same words once more, q later. So
every block asks where it occurs next in the window right behind it. Its occurrences
are one range of the suffix array, and a wavelet matrix over that array gives the
first, second and last of them in the window (range successors). Occurrences so
close form one arithmetic progression: one or two of them are candidate periods as
they stand; of three or more the block has a short period of its own, and only the
member at which that shorter run ends again like the block's can be the period.
Longest common extensions then give each candidate's whole run.

The texts of a chunk share one suffix array, ranked within each text by prefix
doubling; the ranks of each doubling are kept and answer the extensions. Words are
compared as words, never by hash. A narrow map: nothing is shuffled, nothing but
whole texts is held. A task needs some 150 bytes for each word of a chunk, or of the
one text that is longer than a chunk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.text import annotate, chunks, fields, structs

LEAST_WORDS, LEAST_PERIODS = 6, 4
FOUND = fields(n_words="long", starts="long[]", lengths="long[]", periods="long[]", collapsed="binary")


class Ranks:
    """Suffix array of several word sequences, and the rank of every stretch of 2**k words.

    ``levels[k][i]`` is the place in ``order`` where suffixes with the same first 2**k
    words begin. Equal ranks mean equal stretches within one sequence; a stretch that
    runs past its sequence equals no other.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        first = owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(first, kind="stable")
        rank = _begin(first[self.order])
        self.levels = [_placed(self.order, rank)]
        tied = _tied(rank)
        step = 1
        while len(tied):
            now = self.levels[-1].copy()
            members = self.order[tied]
            ahead = members + step
            inside = ahead < n
            inside[inside] = owner[ahead[inside]] == owner[members[inside]]
            # A suffix that ends here sorts before those that go on; there is one per length.
            after = np.where(inside, self.levels[-1][np.minimum(ahead, n - 1)] + 1, 0)
            key = now[members].astype(np.int64) * (n + 1) + after
            by = np.argsort(key, kind="stable")
            self.order[tied] = members = members[by]
            key = key[by]
            head = np.ones(len(key), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            rank = np.maximum.accumulate(np.where(head, tied, 0))
            now[members] = rank
            self.levels.append(now)
            tied = tied[_tied(rank)]
            step *= 2

    def range(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of ``order`` that holds the occurrences of the 2**k words from ``at``."""
        low = self.levels[k][at]
        starts = np.unique(self.levels[k])
        return low, np.append(starts, len(self.order))[np.searchsorted(starts, low) + 1]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on are alike."""
        return self._extend(a, b, 1)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` are alike."""
        return self._extend(a, b, -1)

    def _extend(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        n, total = len(self.order), np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size, rank = 1 << k, self.levels[k]
            while True:  # the top level may be taken more than once
                x, y = (a + total, b + total) if way > 0 else (a - total - size, b - total - size)
                can = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
                can[can] = rank[x[can]] == rank[y[can]]
                if not can.any():
                    break
                total[can] += size
                if k < len(self.levels) - 1:
                    break
        return total


def _begin(ranked: np.ndarray) -> np.ndarray:
    """For sorted values, the place at which each one's group begins."""
    head = np.ones(len(ranked), dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    return np.maximum.accumulate(np.where(head, np.arange(len(ranked)), 0)) if len(ranked) else np.zeros(0, np.int64)


def _placed(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), dtype=np.int32)
    out[order] = rank
    return out


def _tied(rank: np.ndarray) -> np.ndarray:
    """Places whose rank another place shares."""
    same = np.zeros(len(rank) + 1, dtype=bool)
    same[1:-1] = rank[1:] == rank[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


class Wavelet:
    """Wavelet matrix over numbers below 2**bits: counts and order statistics of any range."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []  # per bit, from the highest: zeros before each place
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            before = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(1 - one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of ``[low, high)`` are less than ``bound``."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = (bound >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value of ``[low, high)`` with ``nth`` smaller ones in it."""
        low, high, nth, value = low.copy(), high.copy(), nth.copy(), np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = nth >= b - a
            nth -= np.where(one, b - a, 0)
            value |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return value


class Runs(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def runs(words: np.ndarray, owner: np.ndarray) -> Runs:
    """All runs of the sequences, by start, then period; each with its smallest period."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return Runs(none, none, none)
    ranks = Ranks(words, owner)
    tree = None
    at, period = [none], [none]
    for k in range(1, len(ranks.levels)):
        size = 1 << k
        least = 1 if k == 1 else -(-2 * size // 3)
        past = -(-4 * size // 3)
        block = np.arange(0, len(words), size)
        low, high = ranks.range(k, block)
        again = high - low > 1
        if not again.any():
            continue
        block, low, high = block[again], low[again].astype(np.int64), high[again].astype(np.int64)
        tree = tree or Wavelet(ranks.order)
        top = (1 << tree.bits) - 1
        head = tree.below(low, high, np.minimum(block + least, top))
        tail = tree.below(low, high, np.minimum(block + past, top))
        some = tail > head
        block, low, high, head, tail = (x[some] for x in (block, low, high, head, tail))
        if not len(block):
            continue
        one = tree.smallest(low, high, head)
        two = np.where(tail - head > 1, tree.smallest(low, high, np.minimum(head + 1, tail - 1)), one)
        few = tail - head <= 2
        at += [block[few], block[few & (two > one)]]
        period += [(one - block)[few], (two - block)[few & (two > one)]]
        if not few.all():
            block, one, two = block[~few], one[~few], two[~few]
            inner = two - one
            end = block + inner + ranks.ahead(block, block + inner)
            end_again = one + inner + ranks.ahead(one, one + inner)
            moved = end_again - end
            keep = (moved >= least) & (moved < past)
            at.append(block[keep])
            period.append(moved[keep])
    at, period = np.concatenate(at), np.concatenate(period)
    end = at + period + ranks.ahead(at, at + period)
    start = at - ranks.behind(at, at + period)
    whole = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, end, period = start[whole], end[whole], period[whole]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    # A stretch found with multiples of its period has its smallest first.
    new = np.ones(len(by), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return Runs(start[by], end[by], period[by])


def periodic_runs(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(row, found)``: the runs of each whole text and the text with their repeats dropped.

    Words are runs of characters other than ASCII white space. A run is a longest
    stretch of words with smallest period q, of at least ``LEAST_WORDS`` words and
    ``LEAST_PERIODS`` periods; ``starts``, ``lengths`` and ``periods`` list them by
    start, then period. ``collapsed`` is what is left, joined by one space, when every
    run loses all behind its first q words. NULL and empty texts have no words and no
    runs. Repeated rows get the same answer each; an empty table gives an empty table.
    """

    def work(texts: pa.Array) -> pa.Array:
        out: dict[str, list] = {f.name: [] for f in FOUND}
        for chunk in chunks(texts):
            data, bounds = chunk.data.tobytes(), chunk.bounds.tolist()
            split = [data[a:b].split() for a, b in zip(bounds, bounds[1:])]
            ids: dict[bytes, int] = {}
            sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), dtype=np.int64, count=int(sizes.sum()))
            first = np.concatenate([[0], np.cumsum(sizes)])
            found = runs(flat, np.repeat(np.arange(len(split)), sizes))
            part = np.searchsorted(found.start, first)
            for i, ws in enumerate(split):
                mine = slice(part[i], part[i + 1])
                start, end, period = found.start[mine] - first[i], found.end[mine] - first[i], found.period[mine]
                if len(start):
                    change = np.zeros(len(ws) + 1, dtype=np.int64)
                    np.add.at(change, start + period, 1)
                    np.add.at(change, end, -1)
                    ws = [w for w, covered in zip(ws, np.cumsum(change)[:-1].tolist()) if not covered]
                for name, value in zip(out, (int(sizes[i]), start, end - start, period, b" ".join(ws))):
                    out[name].append(value)
        return structs(FOUND, out)

    return annotate(docs, text, FOUND, work, keep=keep)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where every tenth document, by checksum of its id, repeats its own words.

    With h the checksum and g = h // 10, words from a = g % n on become those of a
    period of 1 + (n - a) // (3 + g % 8). A row without an id stays as it is.
    """

    def changed(doc_id: int, text: bytes) -> bytes:
        h = zlib.crc32(str(doc_id).encode())
        words = text.split() if h % 10 == 0 else []
        if not words:
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or i is None else changed(i, t)
                     for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


DIGEST = fields(n_runs="long", start="long", length="long", period="long", exponent_milli="long", runs_sha256="string",
                collapsed_sha256="string")


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(repeated_tails(docs), keep=["doc_id"]).select("row.doc_id", "found.*")
    longest = F.array_max(F.transform(F.sequence(F.lit(0), F.size("starts") - 1), lambda i: F.struct(
        F.get("lengths", i).alias("length"), (-F.get("starts", i)).alias("start"), (-F.get("periods", i)).alias("period"))))
    lines = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat_ws(
        ",", r["starts"], r["lengths"], r["periods"]))
    best = F.when(F.size("starts") > 0, longest).alias("best")
    return found.select("doc_id", F.size("starts").cast("long").alias("n_runs"), best,
                        F.sha2(F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""), 256)
                        .alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
