"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A text is the multiset of its five-word shingles. Each shingle is a Poisson process
whose rate is its weight; every arrival hits a random register, and a register keeps
the shingle that came first. Registers of two texts agree with the probability
Jaccard similarity of their multisets. A process stops once its arrivals are later
than the text's slowest register, so long texts cost little more than one arrival
per shingle. Runs of registers make band keys; texts that share a band are verified
with the exact similarity.

Texts with the same words are one node from the start. In every shared band each
node is compared with the band's lead, the node that shares most bands with others;
only where that leaves a band in more than one component are its members of different
components compared as well. A thousand near copies thus cost about a thousand
comparisons, and still no link that would join two classes is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col, materialize, packed
from tidewatch.llm.text import SQUEEZED, U, Words, annotate, chunks, expand, fields, grams, mix, prefix_hashes, span_hash, squeeze, structs, words

SHINGLE, THRESHOLD = 5, 0.8
TILE_ROWS, TERMS = 2048, 4096  # members of a band compared in one task; shingles per matrix
# A pair at exactly 0.8 shares no band with a chance of (1 - 0.8**6)**32 = 6e-5.
BANDS, ROWS = 32, 6
STEP, OTHER = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts."""
    apart = mix(hashes ^ mix(owner.astype(U) + U(1)))
    _, index, counts = np.unique(apart, return_index=True, return_counts=True)
    return hashes[index], owner[index], counts.astype(np.float64)


def registers(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """The shingle that reaches each register first, for ``k`` registers per text."""
    best, who = np.full(texts * k, np.inf), np.zeros(texts * k, dtype=U)
    per = np.bincount(owner, minlength=texts)
    single = per[owner] == 1  # it comes first everywhere
    who.reshape(texts, k)[owner[single]] = hashes[single][:, None]
    limit = np.full(texts, np.inf)
    at = np.flatnonzero(~single)
    h, o, w, time = hashes[at], owner[at], weight[at], np.zeros(len(at))
    arrival = 0
    while len(h):
        arrival += 1
        draw = mix(h + U(arrival * int(STEP) % (1 << 64)))
        time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / w
        slot = o * k + ((mix(draw ^ OTHER) >> U(32)) * U(k) >> U(32)).astype(np.int64)
        sooner = np.flatnonzero(time < best[slot])
        np.minimum.at(best, slot[sooner], time[sooner])
        first = sooner[time[sooner] == best[slot[sooner]]]
        who[slot[first]] = h[first]
        live = np.unique(o)
        limit[live] = best.reshape(texts, k)[live].max(axis=1)
        still = time < limit[o]
        h, o, w, time = h[still], o[still], w[still], time[still]
    return who.reshape(texts, k)


def band_keys(who: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (len(who), bands))
    parts = who.reshape(len(who), bands, rows)
    for i in range(rows):
        key = mix(key * STEP + parts[:, :, i])
    return key.view(np.int64)


def _sequence_hash(found: Words, salt: int = 0) -> np.ndarray:
    """One number per text for its whole sequence of words; another one with another salt."""
    word = mix(found.hashes ^ U(salt))
    start, end = found.bounds[:-1], found.bounds[1:]
    return mix(span_hash(prefix_hashes(word >> U(33), word & U((1 << 31) - 1)), start, end) + mix((end - start).astype(U)))


SIGNED = fields(node="long", node2="long", bands="long[]")


def signed(texts: pa.Array, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> pa.Array:
    """Node and band keys of each text; both NULL for a text without words."""
    parts = []
    for chunk in chunks(texts):
        found = words(chunk)
        at, h = grams(found, shingle)
        h, o, w = weighted(h, found.owner()[at])
        keys = band_keys(registers(h, o, w, len(chunk), bands * rows), bands, rows)
        empty = np.diff(found.bounds) == 0
        node, node2 = (pa.array(_sequence_hash(found, salt).view(np.int64), mask=empty) for salt in (0, int(OTHER)))
        offsets = pa.array(np.arange(len(chunk) + 1, dtype=np.int32) * bands, mask=np.append(empty, False))
        parts.append(structs(SIGNED, {
            "node": node, "node2": node2, "bands": pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))}))
    return pa.concat_arrays(parts) if parts else structs(SIGNED, {"node": [], "node2": [], "bands": []})


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact, from the sorted distinct elements ``a``, ``b`` and their weights ``x``, ``y``.

    Sum over shared i of 1 / sum over all j of max(x_j/x_i, y_j/y_i).
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    xs, ys = x[i], y[j]
    ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    xs, ys, ratio = xs[order], ys[order], ratio[order]
    cx, cy = np.concatenate([[0.0], np.cumsum(xs)]), np.concatenate([[0.0], np.cumsum(ys)])
    only_a, only_b = x.sum() - cx[-1], y.sum() - cy[-1]
    below = np.searchsorted(ratio, ratio, side="left")
    total = (cx[-1] - cx[below] + only_a) / xs + (cy[below] + only_b) / ys
    return float((1.0 / total).sum())


def similarities(left: pa.Array, right: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    out = []
    for chunk in chunks(left):
        sides = [_shingled(side.slice(chunk.first, len(chunk)), shingle) for side in (left, right)]
        for mine, theirs in zip(*sides):
            a, x = np.unique(mine, return_counts=True)
            b, y = np.unique(theirs, return_counts=True)
            out.append(probability_jaccard(a, x.astype(float), b, y.astype(float)))
    return np.array(out)


def _shingled(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The shingles of each text, with repeats; about one chunk is in memory at a time."""
    for part in chunks(texts):
        found = words(part)
        at, h = grams(found, shingle)
        bounds = np.searchsorted(at, found.bounds)
        for i in range(len(part)):
            yield h[bounds[i]:bounds[i + 1]]


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of ``(a, b)`` those at least ``threshold`` similar, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = similarities(expand(batch.column(2)), expand(batch.column(3))) >= threshold - 1e-12
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(close))

    left, right = (texts.select(F.col("node").alias(n), F.col("z").alias(f"z_{n}")) for n in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "z_a", "z_b")
    return materialize(both.mapInArrow(run, "a long, b long"), "neardup-links")


def links(base: DataFrame, sig: DataFrame, threshold: float) -> DataFrame:
    """Verified links ``(a, b)`` between nodes: enough to tell every class."""
    bucket = sig.filter("node IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    several = bucket.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = bucket.join(several.filter("low < high").select("bucket"), "bucket").distinct()
    shared = materialize(shared, "neardup-shared")
    # The member that shares most bands with others leads: of the copies of one text,
    # that is the text itself, which is closer to each than they are to each other.
    size = shared.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = shared.join(size, "bucket").groupBy("node").agg(F.sum("n").alias("weight"))
    leads = shared.join(weight, "node").groupBy("bucket").agg(F.max_by("node", "weight").alias("lead"))

    # One row of each node that shares a band supplies its text.
    some = sig.join(shared.select("node").distinct(), "node", "left_semi")
    some = some.groupBy("node").agg(F.min("id").alias("id"), F.min_by("tk", "id").alias("tk"))
    small = annotate(base, "text", SQUEEZED, squeeze, keep=["tk", "id"]).select("row.*", "found.z")
    texts = small.join(some.hint("shuffle_hash"), ["tk", "id"]).select("node", "z").dropDuplicates(["node"])
    texts = materialize(texts, "neardup-texts")

    tried = materialize(shared.join(leads, "bucket").filter("node <> lead").select(
        F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct(), "neardup-tried")
    found = _verified(tried, texts, threshold)

    # Bands whose members are not all in one component yet.
    comp = F.coalesce("comp", "node").alias("comp")
    placed = shared.join(components(found), "node", "left").select("bucket", "node", comp)
    placed = materialize(placed, "neardup-placed")
    split = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    open_ = placed.join(split.filter("low < high").select("bucket", "n"), "bucket")
    return found.union(materialize(_across(open_, texts, threshold), "neardup-across"))


def _across(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` between different components of a band, from ``(bucket, node, comp, n)``.

    A band is compared inside a task; one of more than ``TILE_ROWS`` members is cut
    into blocks, and each two blocks make a task's work of their own.
    """
    blocks = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiled = members.withColumn("blocks", blocks).withColumn("own", own)
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp")
    whole = tiled.join(texts, "node").select("bucket", "i", "j", "node", "comp", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                part = batch.slice(start, end - start)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in range(3)):
                    yield _linked(held, threshold)
                    held = []
                held.append(part)
        if held:
            yield _linked(held, threshold)

    keys = ["bucket", "i", "j"]
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _linked(parts: list[pa.RecordBatch], threshold: float) -> pa.RecordBatch:
    """Links between components among some texts, by products of their weight matrices."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    node, comp = rows.column("node").to_numpy(), rows.column("comp").to_numpy()
    names, place, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    left = np.flatnonzero(place != sizes.argmax())  # a largest component needs no look inside
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(names) > 1:
        column = rows.column("z").combine_chunks() if isinstance(rows.column("z"), pa.ChunkedArray) else rows.column("z")
        hashes, owner = [], []
        for chunk in chunks(expand(column)):
            found = words(chunk)
            at, h = grams(found, SHINGLE)
            hashes.append(h)
            owner.append(found.owner()[at] + chunk.first)
        h, o, w = weighted(np.concatenate(hashes), np.concatenate(owner))
        total = np.bincount(o, w, len(node))
        _, term, held_by = np.unique(h, return_inverse=True, return_counts=True)
        several = held_by[term] > 1  # others are in no intersection
        o, w, term = o[several], w[several], np.unique(term[several], return_inverse=True)[1]
        order = np.argsort(term, kind="stable")
        o, w, term = o[order], w[order], term[order]
        # Sums over shared shingles of x, y, x*x, y*y and x*y for each pair (left, any).
        sx, sy, xx, yy, xy = (np.zeros((len(left), len(node)), dtype=np.float32) for _ in range(5))
        for start in range(0, int(term[-1]) + 1 if len(term) else 0, TERMS):
            at = slice(np.searchsorted(term, start), np.searchsorted(term, start + TERMS))
            m = np.zeros((len(node), TERMS), dtype=np.float32)
            m[o[at], term[at] - start] = w[at]
            ones, mine = (m > 0).astype(np.float32), m[left]
            sx += mine @ ones.T
            sy += ones[left] @ m.T
            if (w[at] != 1).any():
                xx += (mine * mine) @ ones.T
                yy += ones[left] @ (m * m).T
                xy += mine @ m.T
            else:
                same = mine @ ones.T
                xx, yy, xy = xx + same, yy + same, xy + same
        # Where weights agree on what is shared, the similarity is shared weight over united weight.
        alike = xx + yy - 2 * xy == 0
        near = np.where(alike, sx / (total[left][:, None] + total[None, :] - sx),
                        np.minimum(sx / total[left][:, None], sy / total[None, :]))
        i, j = np.nonzero((near >= threshold - 1e-6) & (place[left][:, None] != place[None, :]))
        if len(i):
            # A bound only, or rounded: decided one by one.
            close = similarities(expand(column.take(pa.array(left[i]))), expand(column.take(pa.array(j)))) >= threshold - 1e-12
            a, b = node[left[i[close]]], node[j[close]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def told_apart(sig: DataFrame) -> DataFrame:
    """``sig`` with a node of its own for each ``(node, node2)`` where several share a node.

    Two hashes of 62 bits say whether the words of two texts are the same. Nodes that
    hold different texts are next to none, so the side joined is next to empty.
    """
    mixed = sig.filter("node IS NOT NULL").groupBy("node").agg(F.min("node2").alias("low"), F.max("node2").alias("high"))
    mixed = materialize(mixed.filter("low < high").select("node", F.lit(True).alias("mixed")), "neardup-mixed")
    node = F.when(F.col("mixed"), F.xxhash64("node", "node2")).otherwise(F.col("node"))
    return sig.join(mixed, "node", "left").withColumn("node", node).drop("mixed", "node2")


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
            threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, tk, class_id, class_size, first)`` per row: its class, named by the least id in it.

    Texts with the same words are copies; classes are the connected components of
    the links of ``threshold`` or more. A text of one to four words is one shingle.
    A text without words (NULL, empty) is alone in its class. Rows without an id
    share in classes but name one only if no member has an id; repeated rows are
    members like others. ``tk`` is the text's hash.
    """
    base = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    base = base.withColumns({"tk": F.xxhash64("text"), "id": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    sig = annotate(base, "text", SIGNED, signed, keep=["doc_id", "tk", "id"])
    sig = told_apart(materialize(sig.select("row.*", "found.*"), "neardup-signed"))
    whole = components(links(base, sig, threshold))
    member = sig.select("doc_id", "tk", "node").join(whole, "node", "left")
    member = materialize(member.select("doc_id", "tk", F.coalesce("comp", "node").alias("comp")), "neardup-members")
    named = member.filter("comp IS NOT NULL").groupBy("comp").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min_by("tk", "doc_id").alias("tk0"),
        F.min("tk").alias("tk1"))
    named = named.select("comp", "class_id", "class_size", F.coalesce("tk0", "tk1").alias("first_tk"))
    out = member.join(named, "comp", "left")
    first = F.col("comp").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tk") == F.col("first_tk")))
    return out.select("doc_id", "tk", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), first.alias("first"))


def deduplicated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each class, with all its columns: the one that names the class.

    Documents without words stay, repeated rows once.
    """
    keepers = classes(docs, text=text, doc_id=doc_id, **options).filter("first")
    keepers = keepers.select(F.col("doc_id").alias("k_id"), "tk").distinct()
    whole = packed(docs, id=col(doc_id), tk=F.xxhash64(col(text)))
    kept = whole.join(keepers.hint("shuffle_hash"), (whole["tk"] == keepers["tk"]) & whole["id"].eqNullSafe(keepers["k_id"]))
    return kept.select("row", whole["tk"], "k_id").dropDuplicates(["tk", "k_id"]).select("row.*")


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", F.col("first").alias("kept"))
