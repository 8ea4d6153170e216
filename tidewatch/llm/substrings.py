"""Byte strings of 400 or more that repeat anywhere, found bucket by bucket of suffixes.

A repeat is a pair of equal 400-byte windows. Sorting every suffix of the corpus
would shuffle many times its size, so suffixes enter by a cover sample: the
100-byte gram of least hash in each window. The sample depends on content
alone, so equal windows sample the same gram at the same place, every window has
one, and about one position in 150 is sampled. Grams that occur once are out at
this point, and with them nearly all text.

What is left is sorted one bucket of suffixes at a time, a bucket being the suffixes
around one sampled gram: windows are ranked by fingerprints that are computed once
per stretch of text, so ties of hundreds of bytes cost no comparison. A bucket too
large for a task is dealt out by window. Texts travel once per distinct text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col, materialize
from tidewatch.llm.text import BASE, CHUNK_BYTES, SQUEEZED, U, annotate, chunks, expand, fields, mix, prefix_hashes, span_hash, squeeze, structs

LENGTH, GRAM = 400, 100
HOT_BUCKET = 50_000     # distinct places of one gram from which it is dealt out by window
TOP_GRAMS = 100_000     # the most frequent hot grams, which are broadcast
BUFFER_WINDOWS = (1 << 20) - 2
LOW32 = U((1 << 32) - 1)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, dtype=U), np.full(size, pow(BASE, -1, 1 << 64), dtype=U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def _rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at each place, modulo 2**64: it only says where to look, so it may collide."""
    up, down = _powers(max(CHUNK_BYTES + 2, 1 << len(data).bit_length()))
    prefix = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[:len(data)], out=prefix[1:])
    return mix((prefix[gram:] - prefix[:-gram]) * down[:len(data) - gram + 1])


def cover_sample(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Sampled grams with the windows each is sampled for: hash, place, first and last window start.

    A window's gram is that of least hash inside it, the last of equal ones.
    """
    none = np.zeros(0, dtype=np.int64)
    n, width = len(data) - gram + 1, length - gram + 1
    if len(data) < length:
        return none.view(U), none, none, none
    hashes = _rolling(data, gram)
    key = (hashes & ~LOW32) | (LOW32 - np.arange(n, dtype=U))
    rows = -(-n // width)
    grid = np.full(rows * width, ~U(0), dtype=U)
    grid[:n] = key
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    place = (LOW32 - (least & LOW32)).astype(np.int64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:len(place)]
    start = np.flatnonzero(np.arange(len(place)) + length <= bounds[1:][owner])
    if not len(start):
        return none.view(U), none, none, none
    place = place[start]
    head = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1)])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1
    return hashes[place[first]], place[first], start[first], start[last]


def _sampled(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(gram, tk, tk2, low, high)`` of every text: windows ``low`` to ``high`` sample that gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (1, 2)]
            for chunk in chunks(batch.column(0)):
                h, _, low, high = cover_sample(chunk.data, chunk.bounds, length, gram)
                owner = np.searchsorted(chunk.bounds, low, side="right") - 1
                base = chunk.bounds[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), *[pa.array(k[chunk.first + owner]) for k in keys],
                     pa.array((low - base).astype(np.int32)), pa.array((high - base).astype(np.int32))],
                    names=["gram", "tk", "tk2", "low", "high"])

    return texts.select("text", "tk", "tk2").mapInArrow(run, "gram long, tk long, tk2 long, low int, high int")


def _stretches(texts: DataFrame, length: int) -> DataFrame:
    """Bytes of each candidate's windows; equal stretches of a batch are sent once.

    Rows with ``body`` go to the bucket of their gram; rows without say that these
    windows repeat (seen twice here). Hot grams give one row per distinct window of
    a batch, with its fingerprint in ``rank`` and ``seen`` below 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tk, tk2 = (batch.column(i).to_numpy() for i in (1, 2))
            spans = batch.column(3)
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(spans).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = spans.flatten()
            gram, low, high, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for chunk in chunks(expand(batch.column(0))):
                i, j = at[chunk.first], at[chunk.first + len(chunk)]
                owner = np.repeat(np.arange(len(chunk)), np.diff(at[chunk.first:chunk.first + len(chunk) + 1]))
                start, end = chunk.bounds[owner] + low[i:j], chunk.bounds[owner] + high[i:j] + length
                prefix = prefix_hashes(chunk.data)
                row = chunk.first + owner
                cold = np.flatnonzero(~hot[i:j])
                _, index, which, counts = np.unique(
                    mix(span_hash(prefix, start[cold], end[cold]) ^ gram[i:j][cold].view(U)),
                    return_index=True, return_inverse=True, return_counts=True)
                bodies = [chunk.data[start[c]:end[c]].tobytes() for c in cold[index].tolist()]
                again = cold[counts[which] > 1]
                parts = [(gram[i:j][cold[index]], 0, row[cold[index]], low[i:j][cold[index]], high[i:j][cold[index]],
                          np.minimum(counts, 2), bodies)]
                over = [(row[again], low[i:j][again], high[i:j][again])]
                warm = np.flatnonzero(hot[i:j])
                if len(warm):
                    n = high[i:j][warm] - low[i:j][warm] + 1
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    s, r, at_ = np.repeat(start[warm], n) + step, np.repeat(row[warm], n), np.repeat(low[i:j][warm], n) + step
                    rank, of = span_hash(prefix, s, s + length), np.repeat(gram[i:j][warm], n)
                    _, index, which, counts = np.unique(
                        mix(rank ^ of.view(U)), return_index=True, return_inverse=True, return_counts=True)
                    parts.append((of[index], rank[index].view(np.int64), r[index], at_[index], at_[index],
                                  -np.minimum(counts, 2), [None] * len(index)))
                    twice = counts[which] > 1
                    over.append((r[twice], at_[twice], at_[twice]))
                r, a, b = _merged(*(np.concatenate(x) for x in zip(*over)))
                parts.append((np.zeros(len(r), dtype=np.int64), 0, r, a, b, np.full(len(r), 2), [None] * len(r)))
                for g, rank, r, a, b, seen, body in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g), pa.array(np.broadcast_to(rank, len(r)).astype(np.int64)), pa.array(tk[r]), pa.array(tk2[r]), pa.array(a.astype(np.int32)),
                         pa.array(b.astype(np.int32)), pa.array(seen.astype(np.int32)), pa.array(body, pa.binary())],
                        names=["gram", "rank", "tk", "tk2", "low", "high", "seen", "body"])

    return texts.select("z", "tk", "tk2", "spans").mapInArrow(
        run, "gram long, rank long, tk long, tk2 long, low int, high int, seen int, body binary")


def _merged(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows, with those that overlap or touch in one row put together."""
    order = np.lexsort((low, row))
    row, low, high = row[order].astype(np.int64), low[order].astype(np.int64), high[order].astype(np.int64)
    if not len(row):
        return row, low, high
    reach = np.maximum.accumulate(high + (row << 32)) - (row << 32)  # rows are in order, so earlier ones end lower
    head = np.concatenate([[True], (np.diff(row) != 0) | (low[1:] > reach[:-1] + 1)])
    at = np.flatnonzero(head)
    return row[at], low[at], reach[np.append(at[1:], len(row)) - 1]


def _runs(first: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge window starts (ascending within ``first``) into byte stretches."""
    head = np.concatenate([[True], (np.diff(first) != 0) | (np.diff(starts) != 1)])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(starts)) - 1
    return first[at], starts[at], starts[last] + length


def _sorted_buckets(stretches: DataFrame, length: int) -> DataFrame:
    """``(tk, tk2, start, end)`` of bytes in repeating windows, bucket by bucket."""
    def repeats(rows: pa.Table) -> pa.RecordBatch:
        body = rows.column("body").combine_chunks().cast(pa.large_binary())
        seen, low = rows.column("seen").to_numpy(), rows.column("low").to_numpy().astype(np.int64)
        found = []
        for part in chunks(body, BUFFER_WINDOWS):
            n = np.diff(part.bounds) - length + 1
            row = np.repeat(np.arange(len(part)), n)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = part.bounds[row] + step
            found.append((span_hash(prefix_hashes(part.data), start, start + length), row + part.first, step))
        rank, row, step = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(head) - 1
        times = np.bincount(group, weights=seen[row[order]])
        keep = np.sort(order[times[group] >= 2])
        names = ["tk", "tk2", "start", "end"]
        if not len(keep):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2 + [pa.array([], pa.int32())] * 2, names=names)
        owner, start, end = _runs(row[keep], step[keep], length)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows.column("tk").to_numpy()[owner]), pa.array(rows.column("tk2").to_numpy()[owner]),
             pa.array((start + low[owner]).astype(np.int32)), pa.array((end + low[owner]).astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            windows += pc.sum(pc.binary_length(batch.column(7))).as_py() or 0
            if windows >= BUFFER_WINDOWS:
                whole = pa.Table.from_batches(held).combine_chunks()
                gram = whole.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))  # the last bucket may go on
                if cut:
                    yield repeats(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                windows = sum(pc.sum(pc.binary_length(b.column(7))).as_py() or 0 for b in held)
        if held:
            yield repeats(pa.Table.from_batches(held))

    buckets = stretches.filter("body IS NOT NULL").repartition("gram").sortWithinPartitions("gram")
    return buckets.mapInArrow(run, "tk long, tk2 long, start int, end int")


def repeated_spans(base: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """``(tk, tk2, spans)``: byte stretches of each distinct text that repeat anywhere."""
    texts = base.filter(F.octet_length("text") >= length)
    sample = materialize(_sampled(texts, length, gram), "substr-sample")
    # More than one place; copies of a text are one place.
    place = F.xxhash64("tk", "tk2", "low")
    often = sample.groupBy("gram").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count("*").alias("n"))
    often = materialize(often.filter("p < q").select("gram", "n", (F.col("n") > hot).alias("hot")), "substr-often")
    # Places of the most frequent grams stay where they are; each other gram is a small share of a task.
    top = materialize(often.filter("hot").orderBy(F.desc("n"), "gram").limit(TOP_GRAMS).select("gram", "hot"), "substr-top")
    rest = often.join(F.broadcast(top), "gram", "left_anti").select("gram", "hot")
    placed = sample.join(F.broadcast(top), "gram").union(
        sample.join(F.broadcast(top), "gram", "left_anti").join(rest, "gram").select("gram", "tk", "tk2", "low", "high", "hot"))
    chosen = placed.distinct().groupBy("tk", "tk2").agg(
        F.sort_array(F.collect_list(F.struct("gram", "low", "high", "hot"))).alias("spans"))  # of one text
    one = texts.groupBy("tk", "tk2").agg(F.min("id").alias("id"), F.count("*").alias("copies"),
                                         F.min(F.octet_length("text")).alias("size"))
    one = materialize(one, "substr-texts")
    chosen = materialize(chosen.join(one.select("tk", "tk2", "id"), ["tk", "tk2"]), "substr-chosen")
    small = annotate(texts, "text", SQUEEZED, squeeze, keep=["tk", "tk2", "id"]).select("row.*", "found.z")
    some = small.join(chosen.hint("shuffle_hash"), ["tk", "tk2", "id"]).select("z", "tk", "tk2", "spans")
    # Rows repeated in every column would bring a text twice.
    some = some.dropDuplicates(["tk", "tk2"])
    stretch = materialize(_stretches(some, length), "substr-stretches")
    local = stretch.filter("body IS NULL AND seen > 1").select(
        "tk", "tk2", F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    # Equal windows agree in two hashes of unlike kinds, as those of a bucket do.
    windows = stretch.filter("seen < 0").select("gram", "rank", "tk", "tk2", "low", "seen")
    twice = windows.groupBy("gram", "rank").agg(F.sum("seen").alias("n")).filter("n < -1").select("gram", "rank")
    dealt = windows.join(twice, ["gram", "rank"]).select("tk", "tk2", F.col("low").alias("start"), (F.col("low") + length).alias("end"))
    copies = one.filter("copies > 1").select("tk", "tk2", F.lit(0).alias("start"), F.col("size").alias("end"))
    spans = _sorted_buckets(stretch, length).union(local).union(dealt).union(copies)
    return spans.groupBy("tk", "tk2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


KEPT = fields(n_bytes="long", n_removed="long", n_spans="long", kept="binary", kept_sha256="string")


def _cut(data: bytes, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    merged: list[list[int]] = []
    for s in spans or ():
        if merged and s["start"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"]])
    parts, at = [], 0
    for a, b in merged:
        parts.append(data[at:a])
        at = b
    kept = b"".join([*parts, data[at:]])
    return len(data), len(data) - len(kept), len(merged), kept


def without_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
                    gram: int = GRAM, hot: int = HOT_BUCKET, keep: list[str] | None = None,
                    bytes_too: bool = True) -> DataFrame:
    """``(row, found)``: what is left of each text once repeating bytes are gone.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in the same text or another; copies of a text go wholly, if long enough.
    NULL counts as empty; shorter texts stay as they are; repeated rows are copies.
    An empty table gives an empty table.
    """
    body = F.coalesce(col(text), F.lit(""))
    keys = {"tk": F.xxhash64("text"), "tk2": F.xxhash64(F.lit(7), "text")}
    base = docs.select(F.coalesce(col(doc_id), F.lit(-(1 << 63))).alias("id"), body.alias("text")).withColumns(keys)
    spans = materialize(repeated_spans(base, length, gram, hot), "substr-spans")
    kept = [col(c) for c in (docs.columns if keep is None else keep)]
    whole = docs.select(F.struct(*kept).alias("row"), body.alias("text")).withColumns(keys)
    whole = annotate(whole, "text", SQUEEZED, squeeze, keep=["row", "tk", "tk2"]).select("row.*", "found.z")
    joined = whole.join(spans.hint("shuffle_hash"), ["tk", "tk2"], "left").select("row", "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = expand(batch.column(1)).to_pylist()
            done = [_cut(t, s) for t, s in zip(texts, batch.column(2).to_pylist())]
            sizes, gone, runs, left = zip(*done) if done else ((), (), (), ())
            sha = [hashlib.sha256(k).hexdigest() for k in left]
            yield pa.RecordBatch.from_arrays([batch.column(0), structs(KEPT, {
                "n_bytes": sizes, "n_removed": gone, "n_spans": runs,
                "kept": left if bytes_too else [None] * len(left), "kept_sha256": sha})], names=["row", "found"])

    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("found", KEPT)])
    return joined.mapInArrow(run, schema)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = without_repeats(docs, keep=["doc_id"], bytes_too=False)
    return found.select("row.doc_id", "found.n_bytes", "found.n_removed", "found.n_spans", "found.kept_sha256")
