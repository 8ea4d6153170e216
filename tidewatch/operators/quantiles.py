"""Exact interpolated quantiles of many columns, per class or overall.

A mergeable quantile summary of every column, all in one scan, brackets each wanted
rank between two values that lie some thousandths of the rows apart. A second scan
counts, batch by batch, what is below each bracket, which proves that it holds the
rank, and the values inside. No scan multiplies rows by columns, no task ever holds a
whole group, and a value shared by a third of all rows is just one large count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialize, spread, takes_a_shuffle

ACCURACY = 10_000   # the summary's ranks are off by 1/ACCURACY of the rows at most
MARGIN = 2.0        # brackets reach so many times as far


def exact_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float], *,
                    by: str | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Rows ``([by,] feature, n, values)``, values in the order of ``probs``.

    NULLs are not counted. ``groups`` lists the classes of ``by``; it is a small
    fixed domain, which is what bounds the brackets: two values per class, feature and rank.
    """
    if by is not None and not groups:
        raise ValueError("quantiles by class need the list of classes")
    keep = [F.col(by).alias("g")] if by else [F.lit("").alias("g")]
    base = df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    if by:
        base = base.filter(F.col("g").isin(*groups))
    base = base if takes_a_shuffle(base) else spread(base)
    if takes_a_shuffle(base):
        base = materialize(base, "quantile-base")
    found = _values(base, len(features), probs)
    kind = df.schema[by].dataType.simpleString() if by else "string"
    rows = [(g, features[i], n, values) for (g, i), (n, values) in sorted(found.items())]
    out = df.sparkSession.createDataFrame(rows, f"g {kind}, feature string, n long, values array<double>")
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def _values(base: DataFrame, width: int, probs: Sequence[float]) -> dict:
    """``(class, column) -> (count, values)``: a few numbers per class and column."""
    near = sorted({min(max(p + side * MARGIN / ACCURACY, 0.0), 1.0) for p in probs for side in (-1, 1)})
    sketches = base.groupBy("g").agg(*[part for i in range(width) for part in (
        F.percentile_approx(f"x{i}", F.array(*[F.lit(p) for p in near]), F.lit(ACCURACY)).alias(f"s{i}"),
        F.count(f"x{i}").alias(f"n{i}"), F.min(f"x{i}").alias(f"l{i}"), F.max(f"x{i}").alias(f"h{i}"))]).collect()
    brackets, sizes = {}, {}
    for r in sketches:
        for i in range(width):
            n = sizes[r["g"], i] = r[f"n{i}"]
            at = dict(zip(near, r[f"s{i}"] or []))
            for p in probs if n else ():
                low, high = (min(max(p + side * MARGIN / ACCURACY, 0.0), 1.0) for side in (-1, 1))
                low, high = (r[f"l{i}"] if low == 0 else at[low]), (r[f"h{i}"] if high == 1 else at[high])
                # A rank between two rows needs both, and few rows leave no room between ranks.
                wide = n <= MARGIN * ACCURACY
                brackets[r["g"], i, p] = (r[f"l{i}"], r[f"h{i}"]) if wide else (low, high)
    found = _in_brackets(base, brackets, sizes)
    missed = {k: (None, None) for k in brackets if k not in found}
    if missed:  # beyond the summary's promise: search all of the column
        ends = {(r["g"], i): (r[f"l{i}"], r[f"h{i}"]) for r in sketches for i in range(width)}
        found |= _in_brackets(base, {k: ends[k[:2]] for k in missed}, sizes)
    out = {}
    for (g, i), n in sizes.items():
        if n:
            values = []
            for p in probs:
                x, (low, high) = (n - 1) * p, found[g, i, p]
                share = x - math.floor(x)
                values.append(low if low == high else (math.ceil(x) - x) * low + share * high)
            out[g, i] = (n, values)
    return out


def _in_brackets(base: DataFrame, brackets: dict, sizes: dict) -> dict:
    """``(class, column, prob) -> (value at the rank below, at the rank above)`` where the bracket holds both."""
    if not brackets:
        return {}
    spark = base.sparkSession
    slots = sorted({(i, p) for _, i, p in brackets})
    counted = materialize(_counted(base, brackets, slots), "quantile-counts")
    before = {}
    for r in counted.filter("side < 2").collect():  # two rows per class and slot
        before.setdefault((r["g"], r["j"]), [0, 0])[r["side"]] = r["n"]
    out, ranks = {}, []
    for (g, i, p), (low, high) in brackets.items():
        j = slots.index((i, p))
        x = (sizes[g, i] - 1) * p
        first, last = math.floor(x), math.ceil(x)
        start, stop = before.get((g, j), (0, 0))
        if not start <= first <= last < stop:
            continue
        if low == high:
            out[g, i, p] = (low, high)
        else:
            ranks.append((g, j, start, first, last))
    if not ranks:
        return out
    counts = counted.filter("side = 2").select("g", "j", "v", "n")
    upto = F.sum("n").over(Window.partitionBy("g", "j").orderBy("v"))  # the values of one bracket
    need = spark.createDataFrame(ranks, f"g {base.schema['g'].dataType.simpleString()}, j int, start long, first long, last long")
    placed = counts.withColumn("upto", upto).join(F.broadcast(need), ["g", "j"]).withColumn("upto", F.col("start") + F.col("upto"))

    def at(rank: str):
        return F.min(F.when((F.col(rank) >= F.col("upto") - F.col("n")) & (F.col(rank) < F.col("upto")), F.col("v")))

    for r in placed.groupBy("g", "j").agg(at("first").alias("low"), at("last").alias("high")).collect():
        out[r["g"], slots[r["j"]][0], slots[r["j"]][1]] = (r["low"], r["high"])
    return out


def _counted(base: DataFrame, brackets: dict, slots: list[tuple[int, float]]) -> DataFrame:
    """``(g, j, side, v, n)`` of each class and slot: rows below its bracket (side 0), rows up to its end (1), and
    each value inside with its rows (2). A batch's column is sorted once for all of its brackets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gs, js, sides, vs, ns = [], [], [], [], []
            column = {}
            for g in batch.column(0).unique().to_pylist():
                mine = batch.filter(pc.equal(batch.column(0), pa.scalar(g, batch.column(0).type)))
                for j, (i, p) in enumerate(slots):
                    if (g, i, p) not in brackets:
                        continue
                    if (g, i) not in column:
                        column[g, i] = np.sort(mine.column(i + 1).drop_null().to_numpy())  # NaN last, as in Spark
                    x, (low, high) = column[g, i], brackets[g, i, p]
                    start, stop = np.searchsorted(x, low, "left"), np.searchsorted(x, high, "right")
                    v, n = np.unique(x[start:stop], return_counts=True) if low != high else (x[:0], x[:0].astype(int))
                    gs += [g] * (2 + len(v))
                    js += [j] * (2 + len(v))
                    sides += [0, 1, *[2] * len(v)]
                    vs += [None, None, *v.tolist()]
                    ns += [int(start), int(stop), *n.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(gs, batch.column(0).type), pa.array(js, pa.int32()), pa.array(sides, pa.int32()),
                                              pa.array(vs, pa.float64()), pa.array(ns, pa.int64())], names=["g", "j", "side", "v", "n"])

    kind = base.schema["g"].dataType.simpleString()
    rows = base.mapInArrow(run, f"g {kind}, j int, side int, v double, n long")
    return rows.groupBy("g", "j", "side", "v").agg(F.sum("n").alias("n"))
