"""Words and byte strings of many texts at once, as numpy arrays, inside tasks.

Everything works on the UTF-8 bytes that Arrow hands over, so no Python string is
made per word. Hashes are pairs of polynomials modulo the prime 2**31 - 1, each with a
base of its own, mixed into 64 bits; equal bytes give equal hashes on every executor.
A prime modulus has no texts that collide for every base, as powers of two have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

U = np.uint64
BASE = 0x9E3779B97F4A7C15
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_812_433_253 % PRIME)
CHUNK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words: digits, ASCII letters and every byte of a character beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def modulo(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**63 modulo ``PRIME``."""
    x = (x & U(PRIME)) + (x >> U(31))
    x = (x & U(PRIME)) + (x >> U(31))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def _series(base: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype=U)
    done = 1
    while done < size:
        more = out[:min(done, size - done)]
        out[done:done + len(more)] = modulo(more * U(pow(base, done, PRIME)))
        done += len(more)
    return out


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    return tuple((_series(b, size), _series(pow(b, -1, PRIME), size)) for b in BASES)


def powers(size: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For each base its powers and their inverses, for exponents below at least ``size``."""
    usual = CHUNK_BYTES + 2
    return _powers(usual if size <= usual else 1 << (size - 1).bit_length())


class Texts(NamedTuple):
    """Some consecutive texts of a batch: ``data[bounds[i]:bounds[i+1]]`` is text i."""
    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Whole texts in chunks of about ``limit`` bytes; NULL counts as empty.

    A text longer than that makes a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), start + 4096, len(column))
        yield Texts(start, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start])
        start = stop


def prefix_hashes(data: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Cumulative hashes, a row per base; with ``span_hash`` they give that of any span.

    ``data`` holds numbers below 2**31, as ``other``, which the second base takes if given.
    """
    out = np.zeros((len(BASES), len(data) + 1), dtype=U)
    for row, values, (up, _) in zip(out, (data, data if other is None else other), powers(len(data) + 1)):
        terms = (values.astype(U) + U(1)) * up[:len(data)]
        np.cumsum((terms & U(PRIME)) + (terms >> U(31)), out=row[1:])  # below 2**33 each
        row[:] = modulo(row)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    first, second = (modulo((row[end] + U(PRIME) - row[start]) * down[start])
                     for row, (_, down) in zip(prefix, powers(prefix.shape[1])))
    return mix(first << U(32) | second)


class Words(NamedTuple):
    """Lower-cased words of a chunk; ``bounds`` delimits the words of each text."""
    hashes: np.ndarray
    bounds: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(texts: Texts) -> Words:
    inside = IS_WORD[texts.data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = texts.bounds[:-1][np.diff(texts.bounds) > 0]
    before[edges] = False
    after[edges[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = span_hash(prefix_hashes(LOWER[texts.data]), starts, ends)
    return Words(hashes, np.searchsorted(starts, texts.bounds))


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of ``n`` words; a shorter text, unless empty, is one run.

    Both are ordered by start, so texts stay together.
    """
    owner, count = found.owner(), len(found.hashes)
    lengths = np.diff(found.bounds)[owner]
    left = found.bounds[owner + 1] - np.arange(count) if count else np.zeros(0, dtype=np.int64)
    total, at = np.zeros(count, dtype=U), np.arange(count)
    for i in range(n):
        part = found.hashes[np.minimum(at + i, count - 1)] if count else total
        total = np.where(i < left, mix(total * U(BASE) + part), total)
    keep = (left >= n) | ((lengths < n) & (left == lengths))
    return at[keep], total[keep]


def annotate(docs: DataFrame, text: str, found: T.StructType, work: Callable[[pa.Array], pa.Array], *,
             keep: Sequence[str] | None = None) -> DataFrame:
    """``(row, found)``: each row's columns (or ``keep``) in a struct and what ``work`` makes of its text.

    ``work`` gets the texts of one Arrow batch and returns as many structs. Columns
    may have any names: they travel inside ``row``. A narrow map, without a shuffle.
    """
    names = list(docs.columns)
    kept = list(names if keep is None else keep)
    sent = list(dict.fromkeys([*kept, text]))
    fields = [docs.schema[c] for c in kept]
    at, where = [sent.index(c) for c in kept], sent.index(text)
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in sent]).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = pc.struct_field(row, [where])
            if at != list(range(len(sent))):
                parts = [pc.struct_field(row, [i]) for i in at]
                row = pa.StructArray.from_arrays(parts, fields=[
                    pa.field(f.name, p.type, True) for f, p in zip(fields, parts)])
            yield pa.RecordBatch.from_arrays([row, work(texts)], names=["row", "found"])

    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    schema = T.StructType([T.StructField("row", nullable), T.StructField("found", found)])
    return docs.select(whole).mapInArrow(run, schema)


def fields(**kinds: str) -> T.StructType:
    """A schema from type names; ``long[]`` is an array of long."""
    out = T.StructType()
    for name, kind in kinds.items():
        plain = T.StructType().add("x", kind.removesuffix("[]"))["x"].dataType
        out.add(name, T.ArrayType(plain) if kind.endswith("[]") else plain)
    return out


def structs(schema: T.StructType, columns: dict[str, object]) -> pa.Array:
    """A struct array in the order of ``schema`` from columns of equal length."""
    arrow = to_arrow_schema(schema)
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(f.name).type)
              for f in schema for c in [columns[f.name]]]
    return pa.StructArray.from_arrays(arrays, fields=list(arrow))


SQUEEZED = fields(z="binary")


def squeeze(texts: pa.Array) -> pa.Array:
    """Each text by itself as a zstd frame: what shuffles of whole texts carry."""
    press = zstandard.ZstdCompressor(level=1)
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    return structs(SQUEEZED, {"z": [press.compress(t.as_buffer()) for t in column]})


def expand(frames: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(z.as_buffer()) for z in frames], pa.large_binary())
