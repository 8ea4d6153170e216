"""Language of a text, as a mixture of languages fitted by expectation-maximisation.

Each language is a multinomial over hashed four-byte grams of letters, counted over
all labelled rows. A text is taken as grams drawn from an unknown mixture; EM finds
its proportions. Which languages are in it is a choice between nested sets (the most
probable language, the two most probable, ...) by likelihood less a penalty for each
language more. All texts of a chunk are fitted together, as one set of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col
from tidewatch.llm.text import CHUNK_BYTES, U, Texts, annotate, chunks, fields, mix, structs

UNDETERMINED = "und"
BUCKET_BITS = 16
GRAM = 4
MAX_LANGUAGES = 500   # bounds the model: so many times 2**16 floats
SMOOTHING = 0.5
STEPS = 12
# Neighbouring grams share letters, so likelihoods count each letter about GRAM times.
PENALTY = 4.0
FOUND = fields(lang_pred="string", score="double", languages="string[]", shares="double[]")

# Letters as bytes: a-z lowered, all of a character beyond ASCII; all else is a space.
LETTER = np.full(256, 32, dtype=np.uint8)
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every gram; none spans texts or starts with two spaces.

    A text has a space before it and two behind, so any letter is in a gram.
    """
    sizes = np.diff(texts.bounds) + 3
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    inner = np.ones(bounds[-1], dtype=bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = inner[bounds[1:] - 2] = False
    data = np.full(bounds[-1], 32, dtype=np.uint8)
    data[inner] = LETTER[texts.data]
    n = max(len(data) - GRAM + 1, 0)
    packed = np.zeros(n, dtype=U)
    for i in range(GRAM):
        packed = (packed << U(8)) | data[i:n + i]
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    fits = np.arange(n) + GRAM <= bounds[1:][owner]
    fits &= (data[:n] != 32) | (data[1:n + 1] != 32)
    return (mix(packed[fits]) >> U(64 - BUCKET_BITS)).astype(np.int64), owner[fits]


class Model(NamedTuple):
    languages: list[str]
    logp: np.ndarray  # (buckets, languages)


def fit(docs: DataFrame, text: str, label: str) -> Model:
    """Gram counts per language over all rows of ``docs`` with a label.

    Each task adds up its own counts; the sums that reach the driver are bounded by
    buckets times languages.
    """
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).dictionary_encode()
            names, codes = labels.dictionary.to_pylist(), labels.indices.to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(0)):
                bucket, owner = buckets(chunk)
                code = codes[chunk.first:chunk.first + len(chunk)][owner]
                sums = np.bincount(code * size + bucket, minlength=len(names) * size)
                for i, name in enumerate(names):
                    totals[name] = totals.get(name, 0) + sums[i * size:(i + 1) * size]
        for name, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])],
                names=["lang", "bucket", "n"])

    rows = docs.filter(col(label).isNotNull()).select(col(text).alias("text"), col(label).cast("string").alias("lang"))
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow().combine_chunks()
    names = sorted(set(got.column("lang").unique().to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} labels; the model is bounded to {MAX_LANGUAGES} languages")
    counts = np.full((size, len(names)), SMOOTHING)
    if names:
        where = {n: i for i, n in enumerate(names)}
        codes = np.array([where[n] for n in got.column("lang").to_pylist()])
        counts[got.column("bucket").to_numpy(), codes] += got.column("n").to_numpy()
    return Model(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


class Grams(NamedTuple):
    """Grams of some texts, text by text: likelihoods by language, counts, text, first of each text."""
    p: np.ndarray
    n: np.ndarray
    owner: np.ndarray
    heads: np.ndarray

    def step(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One EM step: by what each share is multiplied, and the log likelihood before it."""
        seen = np.maximum(np.einsum("ij,ij->i", self.p, share.astype(np.float32)[self.owner]), 1e-30)
        total = np.add.reduceat(self.n, self.heads)[:, None]
        gain = np.add.reduceat(self.p * (self.n / seen)[:, None], self.heads, axis=0) / total
        return gain, np.add.reduceat(self.n * np.log(seen), self.heads).astype(np.float64)

    def only(self, texts: np.ndarray) -> Grams:
        """The grams of some of the texts, given in order."""
        place = np.full(len(self.heads), -1)
        place[texts] = np.arange(len(texts))
        owner = place[self.owner]
        at = np.flatnonzero(owner >= 0)
        owner = owner[at]
        return Grams(self.p[at], self.n[at], owner, np.searchsorted(owner, np.arange(len(texts))))


def mixtures(chunk: Texts, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares per text and language (0 if not selected), their certainty, and which texts have grams."""
    bucket, owner = buckets(chunk)
    pairs, n = np.unique((owner << BUCKET_BITS) | bucket, return_counts=True)
    owner, bucket = pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)
    kinds = len(model.languages)
    shares, sure = np.zeros((len(chunk), kinds)), np.zeros(len(chunk))
    some, heads, dense = np.unique(owner, return_index=True, return_inverse=True)
    if not len(some):
        return shares, sure, some
    logp, n = model.logp[bucket], n.astype(np.float32)
    high = logp.max(axis=1)
    grams = Grams(np.exp(logp - high[:, None]), n, dense, heads)
    base = np.add.reduceat((n * high).astype(np.float64), heads)
    single = np.add.reduceat((n[:, None] * logp).astype(np.float64), heads, axis=0)
    total = np.add.reduceat(n.astype(np.float64), heads)
    cost = PENALTY * np.log1p(total)
    top = single.argmax(axis=1)
    value = single.max(axis=1)
    chosen = np.zeros_like(single)
    chosen[np.arange(len(some)), top] = 1.0

    # By concavity no mixture is likelier than this one by more than total * log(largest gain).
    # Where that cannot pay for a second language, the text is settled and leaves.
    open_ = np.arange(len(some))
    share = np.full_like(single, 0.1 / max(kinds - 1, 1))
    share[open_, top] = 0.9 if kinds > 1 else 1.0
    reached = value.copy()
    for _ in range(STEPS):
        gain, likelihood = grams.step(share)
        reached[open_] = base[open_] + likelihood
        bound = reached[open_] + total[open_] * np.log(np.maximum(gain.max(axis=1), 1.0))
        left = np.flatnonzero(bound - value[open_] > cost[open_])
        share = share * gain
        if len(left) < len(open_):
            if not len(left):
                open_ = left
                break
            grams, open_, share = grams.only(left), open_[left], share[left]
    if len(open_):
        order = np.argsort(-share, axis=1, kind="stable")
        for k in range(2, kinds + 1):
            part = np.zeros_like(share)
            np.put_along_axis(part, order[:, :k], 1.0 / k, axis=1)
            for _ in range(STEPS):
                gain, _ = grams.step(part)
                part = part * gain
            likelihood = base[open_] + grams.step(part)[1] - cost[open_] * (k - 1)
            better = likelihood > value[open_]
            chosen[open_[better]], value[open_[better]] = part[better], likelihood[better]
            if not (reached[open_] - cost[open_] * k > value[open_]).any():
                break
    shares[some] = chosen
    odds = np.exp((single - single.max(axis=1, keepdims=True)) / GRAM)
    sure[some] = 1.0 / odds.sum(axis=1)
    return shares, sure, some


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(row, found)``: predicted language, score, and the selected languages with their shares.

    The language is the one with the largest share, ties to the first by name; the
    score is that share times how clearly it beats other languages. NULL, empty and
    letterless texts, and all texts if nothing was learned, are ``und`` with score 0.
    Repeated rows get the same answer each; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = max(1 << 16, CHUNK_BYTES * 8 // max(8, len(model.languages)))

    def work(texts: pa.Array) -> pa.Array:
        model = shared.value
        out: dict[str, list] = {f.name: [] for f in FOUND}
        for chunk in chunks(texts, limit):
            shares, sure, some = mixtures(chunk, model) if model.languages else (None, None, ())
            answers = [(UNDETERMINED, 0.0, [], [])] * len(chunk)
            for i in np.asarray(some, dtype=np.int64).tolist():
                data = chunk.data[chunk.bounds[i]:chunk.bounds[i + 1]]
                if not ((LETTER[data] != 32) & (data < 128)).any() and not any(map(str.isalpha, data.tobytes().decode("utf-8", "replace"))):
                    continue
                order = np.argsort(-shares[i], kind="stable")
                held = [j for j in order.tolist() if shares[i, j] > 0]
                answers[i] = (model.languages[held[0]], float(shares[i, held[0]] * (sure[i] if len(held) == 1 else 1.0)),
                              [model.languages[j] for j in held], [float(shares[i, j]) for j in held])
            for name, values in zip(out, zip(*answers)):
                out[name] += values
        return structs(FOUND, out)

    return annotate(docs, text, FOUND, work, keep=keep)


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, by checksum; a row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame) -> Model:
    return fit(docs.filter(~held_out(col("doc_id"))), "text", "lang")


@query("op5_language_mixture")
def op5_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), trained(docs), keep=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "found.lang_pred", "found.score",
                        "found.languages", "found.shares")
