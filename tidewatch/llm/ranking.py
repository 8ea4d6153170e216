"""Ranked lexical search by MaxScore with bounds on pairs of terms.

The index is built in blocks of documents: postings of the queries' terms with the
impact of each, and for chosen pairs of terms the list of documents that hold both,
with their joint impacts and the largest of them. No document gets more from a pair
than the larger of that joint maximum and the two single ones, which is less than
the sum of the single maxima wherever the pair is rare together. A query matches its
terms into pairs by what each saves in the block at hand, and adds up bounds of pairs
and single terms. Terms whose bounds together stay below the query's threshold open
no document; a block whose whole bound does is skipped.

Thresholds start from the pair lists: the k-th best joint impact of one pair (or of
one term) in any part of the index is reached by k documents. They rise with
every block a task has searched. All sums are whole numbers, so results are exact.

Queries come in groups of a bounded vocabulary, one pass over the documents each.
Only a task's best k documents for each query leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col, materialize
from tidewatch.llm.text import IS_WORD, LOWER, annotate, chunks, fields, structs

TOP = 50
PAIR_TERMS = 8         # the weightiest terms of a query are paired each with each, the others in order
BLOCK_DOCS = 4096
GROUP_BYTES = 4 << 20  # text of queries searched at once: bounds what is broadcast
EMPTY = np.zeros(0, dtype=np.int64)

# Words as bytes: letters lowered (A-Z alone), all that is no word turned into a space.
AS_WORDS = bytes(np.where(IS_WORD, LOWER, 32).astype(np.uint8).tolist())
HITS = fields(n="long", terms="integer[]", tf="long[]")
INDEX = fields(ids="long[]", ends="long[]", docs="integer[]", impacts="long[]", pair_ends="long[]", pair_docs="integer[]",
               pair_impacts="long[]", pair_max="long[]", floors="long[]")


def word_list(text: bytes) -> list[bytes]:
    return text.translate(AS_WORDS).split()


class Group(NamedTuple):
    """Some queries: their ids, vocabulary, and each one's term numbers."""
    ids: list
    vocabulary: list[bytes]
    terms: list[np.ndarray]


class Plan(NamedTuple):
    """A group with what the corpus says of its terms."""
    group: Group
    weight: np.ndarray
    pairs: np.ndarray            # (pairs, 2) of term numbers, distinct over all queries
    of_query: list[np.ndarray]   # pair numbers of each query
    rows: int                    # N
    words: int                   # L


def groups_of(items: DataFrame, item_id: str, text: str, limit: int = GROUP_BYTES) -> Iterator[Group]:
    """Queries dealt by hash into groups of about ``limit`` bytes, one at a time through the driver."""
    slim = items.select(col(item_id).alias("item"), col(text).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // limit) + 1
    for g in range(n):
        got = slim.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == g).toArrow()
        number: dict[bytes, int] = {}
        terms = [np.unique(np.array([number.setdefault(w, len(number)) for w in word_list((t or "").encode())], dtype=np.int64))
                 for t in got.column("text").to_pylist()]
        yield Group(got.column("item").to_pylist(), list(number), terms)


def occurrences(docs: DataFrame, group: Group, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, n, terms, tf)`` of each document with a term; ``terms`` has those of the group only."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(group.vocabulary)})

    def work(texts: pa.Array) -> pa.Array:
        number, n, terms, tf = shared.value, [], [], []
        for chunk in chunks(texts):
            data, bounds = chunk.data.tobytes(), chunk.bounds.tolist()
            for a, b in zip(bounds, bounds[1:]):
                words = word_list(data[a:b])
                held = [(number[w], c) for w, c in Counter(words).items() if w in number]
                n.append(len(words))
                terms.append([t for t, _ in held])
                tf.append([c for _, c in held])
        return structs(HITS, {"n": n, "terms": terms, "tf": tf})

    slim = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    return annotate(slim, "text", HITS, work, keep=["doc_id"]).select("row.doc_id", "found.*").filter("n > 0")


def planned(hits: DataFrame, group: Group) -> Plan:
    """Weights from counts over all documents, and the pairs worth a list."""
    size = len(group.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, words = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy()
            df += np.bincount(flat, minlength=size)
            rows, words = rows + batch.num_rows, words + int(batch.column(1).to_numpy().sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(np.append(df, [rows, words]))], names=["term", "n"])

    got = hits.select("terms", "n").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(size + 2, dtype=np.int64)
    sums[got.column("term").to_numpy()] = got.column("n").to_numpy()
    rows, words = int(sums[size]), int(sums[size + 1])
    weight = np.array([math.floor(1000 * math.log((2 * rows + 2) / (2 * int(d) + 1))) for d in sums[:size]], dtype=np.int64)
    number: dict[tuple[int, int], int] = {}
    of_query = []
    for terms in group.terms:
        ranked = terms[np.lexsort((terms, -weight[terms]))].tolist()
        rest = ranked[PAIR_TERMS:]
        pairs = [*combinations(ranked[:PAIR_TERMS], 2), *zip(rest[::2], rest[1::2])]
        of_query.append(np.array([number.setdefault((min(p), max(p)), len(number)) for p in pairs], dtype=np.int64))
    return Plan(group, weight, np.array(list(number), dtype=np.int64).reshape(-1, 2), of_query, rows, words)


class Block:
    """Postings and pair lists of some documents, as slices of flat arrays."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.ids = columns["ids"]
        self.ends, self.docs, self.impacts = columns["ends"], columns["docs"], columns["impacts"]
        self.pair_max = columns["pair_max"]
        self.most = _maxima(self.impacts, self.ends)

    def of(self, term: int) -> slice:
        return slice(self.ends[term - 1] if term else 0, self.ends[term])


def _maxima(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Largest value of each slice; 0 for an empty one."""
    sizes = np.diff(ends, prepend=0)
    out, some = np.zeros(len(ends), dtype=np.int64), sizes > 0
    if some.any():
        out[some] = np.maximum.reduceat(values, (ends - sizes)[some])
    return out


def _kth(values: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each slice; 0 where there are fewer."""
    sizes = np.diff(ends, prepend=0)
    out, some = np.zeros(len(ends), dtype=np.int64), np.flatnonzero(sizes >= k)
    for i in some.tolist():
        part = values[ends[i] - sizes[i]:ends[i]]
        out[i] = np.partition(part, len(part) - k)[len(part) - k]
    return out


def indexed(ids: list, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tf: np.ndarray, plan: Plan, k: int) -> dict:
    """A block of the index: columns of ``INDEX`` for documents with the given occurrences."""
    m = 50 + (50 * n * plan.rows) // plan.words
    impact = plan.weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
    by = np.lexsort((owner, terms))
    docs, impact, terms = owner[by], impact[by], terms[by]
    size = len(plan.group.vocabulary)
    ends = np.searchsorted(terms, np.arange(size), side="right")
    length = np.diff(ends, prepend=0)
    # A pair's list: postings of its rarer term that the other one has as well.
    a, b = plan.pairs[:, 0], plan.pairs[:, 1]
    few, other = np.where(length[a] <= length[b], a, b), np.where(length[a] <= length[b], b, a)
    count = length[few]
    pair = np.repeat(np.arange(len(few)), count)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[few] - count, count)
    place = terms * len(ids) + docs  # ascending
    wanted = other[pair] * len(ids) + docs[at]
    where = np.searchsorted(place, wanted)
    both = np.zeros(len(pair), dtype=bool)
    inside = where < len(place)
    both[inside] = place[where[inside]] == wanted[inside]
    pair, at, where = pair[both], at[both], where[both]
    joint = impact[at] + impact[where]
    pair_ends = np.searchsorted(pair, np.arange(len(few)), side="right")
    reached, reached_pairs = _kth(impact, ends, k), _kth(joint, pair_ends, k)
    floors = [max(reached[t].max(initial=0), reached_pairs[p].max(initial=0)) for t, p in zip(plan.group.terms, plan.of_query)]
    return {"ids": ids, "ends": ends, "docs": docs.astype(np.int32), "impacts": impact, "pair_ends": pair_ends,
            "pair_docs": docs[at].astype(np.int32), "pair_impacts": joint, "pair_max": _maxima(joint, pair_ends), "floors": floors}


def index(hits: DataFrame, plan: Plan, k: int) -> DataFrame:
    """One row per block of documents, in the columns of ``INDEX``."""
    shared = hits.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                terms, tf = part.column(2), part.column(3)
                owner = np.repeat(np.arange(part.num_rows), terms.value_lengths().to_numpy())
                made = indexed(part.column(0).to_pylist(), part.column(1).to_numpy(), owner, terms.flatten().to_numpy().astype(np.int64),
                               tf.flatten().to_numpy(), shared.value, k)
                yield pa.RecordBatch.from_struct_array(structs(INDEX, {f: [v] for f, v in made.items()}))

    return hits.select("doc_id", "n", "terms", "tf").mapInArrow(run, INDEX)


def matched(terms: np.ndarray, pairs: np.ndarray, ends: np.ndarray, most: np.ndarray, joint: np.ndarray) -> list[tuple[int, list[int]]]:
    """``(bound, terms)`` of units that cover a query: pairs by what they save, then single terms."""
    low, high = most[ends[pairs, 0]], most[ends[pairs, 1]]
    bound = np.maximum(np.maximum(low, high), joint[pairs])
    saved = low + high - bound
    used: set[int] = set()
    units = []
    for i in np.argsort(-saved, kind="stable").tolist():
        a, b = ends[pairs[i]].tolist()
        if saved[i] > 0 and a not in used and b not in used:
            used |= {a, b}
            units.append((int(bound[i]), [a, b]))
    units += [(int(most[t]), [t]) for t in terms.tolist() if t not in used and most[t]]
    return sorted(units)


def best_of(block: Block, plan: Plan, q: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block that score at least ``floor`` (and above 0) for query ``q``, with their scores.

    Units are taken from the smallest bound on: as long as they add up to less than
    the floor, none of them alone lets a document in.
    """
    units = matched(plan.group.terms[q], plan.of_query[q], plan.pairs, block.most, block.pair_max)
    total = np.cumsum([bound for bound, _ in units])
    if not len(units) or total[-1] < floor:
        return EMPTY, EMPTY
    split = int(np.searchsorted(total, floor))  # units before it stay below the floor
    score = np.zeros(len(block.ids), dtype=np.int64)
    for _, terms in units[split:]:
        for t in terms:
            at = block.of(t)
            score[block.docs[at]] += block.impacts[at]
    for i in range(split, -1, -1):
        left = int(total[i - 1]) if i else 0
        found = np.flatnonzero(score >= max(floor - left, 1)) if i == split else found[score[found] >= max(floor - left, 1)]
        if not i or not len(found):
            return found, score[found]
        for t in units[i - 1][1]:
            at = block.of(t)
            docs, impacts = block.docs[at], block.impacts[at]
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1) if len(docs) else EMPTY
            hit = docs[place] == found if len(docs) else EMPTY.astype(bool)
            score[found[hit]] += impacts[place[hit]]
    return found, score[found]


def search(blocks: DataFrame, plan: Plan, k: int) -> DataFrame:
    """``(q, doc_id, score)``: the best ``k`` documents of each query, of every task."""
    spark = blocks.sparkSession
    start = blocks.select(F.posexplode("floors").alias("q", "floor")).groupBy("q").agg(F.max("floor").alias("floor")).toArrow()
    floors = np.zeros(len(plan.group.ids), dtype=np.int64)
    floors[start.column("q").to_numpy()] = start.column("floor").to_numpy()
    shared = spark.sparkContext.broadcast((plan, floors))
    used = ["ids", "ends", "docs", "impacts", "pair_max"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, floors = shared.value[0], shared.value[1].copy()
        best = [(EMPTY, EMPTY, EMPTY) for _ in floors]  # score, whether the id is missing, id
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(f)[i].values for f in used}
                gone = row["ids"].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                row["ids"] = row["ids"].fill_null(0)
                block = Block({f: v.to_numpy() for f, v in row.items()})
                for q in range(len(floors)):
                    found, score = best_of(block, plan, q, int(floors[q]))
                    if not len(found):
                        continue
                    merged = [np.concatenate(x) for x in zip(best[q], (score, gone[found], block.ids[found]))]
                    by = np.lexsort((merged[2], merged[1], -merged[0]))[:k]
                    best[q] = tuple(x[by] for x in merged)
                    if len(by) == k:
                        floors[q] = max(floors[q], int(best[q][0][-1]))
        n = [len(x[0]) for x in best]
        score, gone, ids = (np.concatenate(x) if x else EMPTY for x in zip(*best)) if best else (EMPTY,) * 3
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n), pa.int64()),
                                          pa.array(ids, pa.int64(), mask=gone.astype(bool)), pa.array(score, pa.int64())],
                                         names=["q", "doc_id", "score"])

    return blocks.select(*used).mapInArrow(run, "q long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id",
           text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score above 0 for each item.

    Scores are sums over an item's distinct terms of ``weight * saturation``, in whole
    numbers. Equal scores go by ascending ``doc_id``, a NULL one last; repeated rows
    are documents each. NULL and empty texts have no terms: they are no document and
    find none. An item row given twice with the same id and text ranks once. Empty
    tables give an empty table. ``item_id`` keeps its type.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id", "q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    distinct = items.select(col(item_id).alias(item_id), col(text).alias(text)).distinct()
    for group in groups_of(distinct, item_id, text, group_bytes):
        if not group.vocabulary:
            continue
        hits = materialize(occurrences(docs, group, doc_id, text), "ranking-hits")
        plan = planned(hits, group)
        if not plan.words:
            continue
        found = search(materialize(index(hits, plan, k), "ranking-index"), plan, k)
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(group.ids)), pa.int64()), "item_id": pa.array(group.ids)}))
        found = found.join(F.broadcast(names), "q").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = out.union(found.select(F.col("item_id").cast(kind), "rank", "doc_id", "score"))
    return out


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"


@query("op11_ranked_search", f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words FROM documents),
         dw AS (SELECT r, doc_id, unnest(words) AS word FROM d),
         tf AS (SELECT r, doc_id, word, count(*) AS tf FROM dw GROUP BY ALL),
         size AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
         total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM size),
         weight AS (SELECT word, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY word, nd),
         q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS word FROM benchmark),
         s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
               FROM q JOIN tf USING (word) JOIN weight USING (word) JOIN size USING (r), total GROUP BY item_id, r, doc_id),
         o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
               FROM s WHERE score > 0)
    SELECT * FROM o WHERE rank <= {TOP}""")
def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
