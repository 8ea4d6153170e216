"""Quality of a text, voted by its nearest labelled neighbours in a latent semantic space.

Terms are hashed four-byte grams of a text's shape (letters, digits and white space
each as one sign, marks as they are) and one term for words that repeat the word
before them. Weights are tf-idf, with document counts over all rows. A truncated
singular value decomposition of a bounded sample of labelled rows gives the latent
space; the sample's vectors and labels are broadcast (``SAMPLE_ROWS`` times
``DIMENSIONS`` floats at most) and every document is compared with all of them, as
blocked matrix products. Its neighbours vote with weights by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col
from tidewatch.llm.text import U, Texts, annotate, chunks, fields, mix, structs

SAMPLE_ROWS = 6000     # labelled rows that are fitted on and vote
DIMENSIONS = 32
NEIGHBOURS = 9
SHARPNESS = 20.0       # a vote's weight falls by e with each 1/20 of cosine
GRAM = 4
BUCKET_BITS = 11
TERMS = (1 << BUCKET_BITS) + 1
REPEAT_WEIGHT = 3.0    # of the last term, which one text in many has
SEED = 17
BLOCK_ROWS = 512
PIECE_BYTES = 1 << 20
TIE = 1e-5             # cosines closer than rounding count as equal
FOUND = fields(score="double", nearest="double", voters="long")

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
SHAPE[9:14] = ord(" ")


def term_counts(texts: Texts) -> np.ndarray:
    """Counts of each term in each text, as (texts, TERMS)."""
    n, size = len(texts), TERMS - 1
    counts = np.zeros(n * size, dtype=np.float32)
    shift = U(64 - BUCKET_BITS)
    for start in range(0, max(len(texts.data) - GRAM + 1, 0), PIECE_BYTES):
        shape = SHAPE[texts.data[start:start + PIECE_BYTES + GRAM - 1]]
        m = len(shape) - GRAM + 1
        packed = np.zeros(m, dtype=U)
        for i in range(GRAM):
            packed = (packed << U(8)) | shape[i:m + i]
        owner = np.searchsorted(texts.bounds, np.arange(start, start + m), side="right") - 1
        inside = np.arange(start, start + m) + GRAM <= texts.bounds[owner + 1]
        cells, times = np.unique(owner[inside] * size + (mix(packed[inside]) >> shift).astype(np.int64), return_counts=True)
        counts[cells] += times
    out = np.zeros((n, TERMS), dtype=np.float32)
    out[:, :size] = counts.reshape(n, size)
    data, bounds = texts.data.tobytes(), texts.bounds.tolist()
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        words = data[a:b].split()
        out[i, size] = sum(map(eq, words, words[1:]))
    return out


def blocks(texts: pa.Array) -> Iterator[Texts]:
    """Chunks of bytes, none of more texts than a block has rows."""
    for chunk in chunks(texts):
        for a in range(0, len(chunk), BLOCK_ROWS):
            bounds = chunk.bounds[a:a + BLOCK_ROWS + 1]
            yield Texts(chunk.first + a, chunk.data[bounds[0]:bounds[-1]], bounds - bounds[0])


class Model(NamedTuple):
    idf: np.ndarray        # (TERMS,)
    axes: np.ndarray       # (TERMS, dimensions)
    vectors: np.ndarray    # (sample, dimensions), of length 1
    labels: np.ndarray     # (sample,), 0 to 1
    prior: float           # score of a text without terms

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def embedded(self, counts: np.ndarray) -> np.ndarray:
        return _unit(self.weighted(counts) @ self.axes)

    def vote(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, best cosine and number of voters: the ``k`` nearest and all that tie with the last."""
        score, nearest, voters = (np.full(len(vectors), x) for x in (self.prior, 0.0, 0))
        some = np.flatnonzero(np.abs(vectors).sum(axis=1) > 0)
        if not len(self.labels) or not len(some):
            return score, nearest, voters
        cosine = vectors[some] @ self.vectors.T
        k = min(k, cosine.shape[1])
        last = np.partition(cosine, -k, axis=1)[:, -k]
        row, at = np.nonzero(cosine >= last[:, None] - TIE)
        best = cosine.max(axis=1)
        weight = np.exp(SHARPNESS * (cosine[row, at] - best[row]).astype(np.float64))
        score[some] = np.bincount(row, weight * self.labels[at]) / np.bincount(row, weight)
        nearest[some], voters[some] = best, np.bincount(row)
        return np.clip(score, 0.0, 1.0), nearest, voters


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-6)


def document_counts(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Rows, and in how many of them each term occurs, over the whole table.

    Each task adds up its own; what reaches the driver is one number per term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                total[:TERMS] += (term_counts(block) > 0).sum(axis=0)
                total[TERMS] += len(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], names=["term", "n"])

    sums = docs.select(col(text).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got, out = sums.toArrow(), np.zeros(TERMS + 1, dtype=np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return int(out[TERMS]), out[:TERMS]


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS) -> Model:
    """A model from ``labels`` (one label of 0 to 1 per ``doc_id``, several are averaged).

    Document counts cover all of ``docs``. At most ``sample_rows`` labelled documents,
    the first by hash of their id, are fitted on. Rows without id or label are left out.
    """
    rows, df = document_counts(docs, text)
    known = labels.select(col(doc_id).alias("id"), col(label).cast("double").alias("y")).dropna()
    present = docs.select(col(doc_id).alias("id")).filter("id IS NOT NULL")
    chosen = (known.join(present, "id", "left_semi").groupBy("id").agg(F.avg("y").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    texts = docs.select(col(doc_id).alias("id"), col(text).alias("text")).join(F.broadcast(chosen), "id")
    schema = fields(terms="integer[]", n="float[]")

    def sparse(texts: pa.Array) -> pa.Array:
        terms, n = [], []
        for block in blocks(texts):
            for counts in term_counts(block):
                terms.append(at := np.flatnonzero(counts))
                n.append(counts[at])
        return structs(schema, {"terms": terms, "n": n})

    got = annotate(texts, "text", schema, sparse, keep=["id", "y"]).groupBy("row.id").agg(
        F.min("row.y").alias("y"), F.min(F.struct("found.terms", "found.n")).alias("found")).orderBy("id").toArrow()
    counts = np.zeros((got.num_rows, TERMS), dtype=np.float32)
    for i, found in enumerate(got.column("found").to_pylist()):
        counts[i, found["terms"]] = found["n"]
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)
    idf[-1] *= REPEAT_WEIGHT
    y = got.column("y").to_numpy()
    plain = Model(idf, np.eye(TERMS, 1, dtype=np.float32), counts[:0, :1], y[:0], float(y.mean()) if len(y) else 0.5)
    if not len(y):
        return plain
    axes = _right_axes(plain.weighted(counts), dimensions)
    model = plain._replace(axes=axes)
    vectors = model.embedded(counts)
    some = np.abs(vectors).sum(axis=1) > 0
    return model._replace(vectors=vectors[some], labels=y[some])


def _right_axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors, by a seeded randomised range finder with power steps."""
    width = min(dimensions + 10, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(SEED).standard_normal((x.shape[1], width)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:dimensions].T.copy()


def scored(docs: DataFrame, model: Model, *, text: str = "text", k: int = NEIGHBOURS, keep: list[str] | None = None) -> DataFrame:
    """``(row, found)``: score (0 to 1, high is good), best cosine and number of voters of each text.

    The ``k`` labelled neighbours of largest cosine vote, and all that tie with the
    last of them. NULL and empty texts, and any shorter than a gram without a repeated
    word, get the mean label of the sample; without any label all score 0.5. Repeated
    rows score alike; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> pa.Array:
        model = shared.value
        got = [model.vote(model.embedded(term_counts(block)), k) for block in blocks(texts)]
        columns = [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0)] * 3
        return structs(FOUND, dict(zip((f.name for f in FOUND), (columns[0], columns[1].astype(float), columns[2].astype(int)))))

    return annotate(docs, text, FOUND, work, keep=keep)


def held_out(doc_id: Column) -> Column:
    """A third of the ids, by checksum; a row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op13_quality_vote")
def op13_quality_vote(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    found = scored(docs, fit(docs, labels), keep=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "found.score",
                        (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.nearest", "found.voters")
