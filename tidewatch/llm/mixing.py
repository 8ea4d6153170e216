"""Mixing sources to target weights by capped water-filling.

Weights share the wanted total among sources in proportion; a source whose share
is above ``max_epochs`` passes over its data is clamped there, and the excess is
shared by weight among the rest, again and again until none is above. Each round
is one aggregate of the table of sources; only its sums reach the driver.

A target of 2.4 times a source's size means: every document twice, and once more
the documents that come first in a seeded hash order, until 0.4 of the words is
reached. The end of that order is found by counting words per hash prefix
(combined before the shuffle) and ordering only the documents of the one prefix in
which the target falls, so a source with a third of all rows is never sorted whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import bounded, col, materialize, packed

WORD = r"[^\x20\x09-\x0D]+"
PREFIX_BITS = 16
CYCLE = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled(cycle: Sequence[int]) -> Callable[[DataFrame], DataFrame]:
    """Weights by code point order of the sources, NULL last, repeating ``cycle``.

    The table of sources is numbered without one task seeing it whole: sorted by
    ranges, numbered inside each range, shifted by the rows of the ranges before.
    """
    def weigh(sources: DataFrame) -> DataFrame:
        placed = materialize(sources.repartitionByRange(8, F.col("source").asc_nulls_last())
                             .withColumn("part", F.spark_partition_id()), "mix-ranges")
        inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
        before, offsets = 0, []
        for r in placed.groupBy("part").count().orderBy("part").collect():  # at most one row per range
            offsets.append((r["part"], before))
            before += r["count"]
        shift = placed.sparkSession.createDataFrame(offsets, "part int, before long")
        at = (F.col("before") + F.col("inside") - 1) % len(cycle)
        weight = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), (at + 1).cast("int"))
        return (placed.withColumn("inside", inside).join(F.broadcast(shift), "part")
                .select("source", "source_size", weight.cast("long").alias("weight")))

    return weigh


def targets(sources: DataFrame, max_epochs: int, share: float = 1.0) -> DataFrame:
    """Water-filling over ``(source, source_size, weight)``; adds ``target``."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    wanted = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    clamped = F.lit(False)
    while True:
        taken, weight = sources.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0))).first()
        level = max(wanted - max_epochs * float(taken), 0.0) / weight if weight else 0.0
        # A higher level only clamps more, so this test alone says who is clamped.
        above = F.col("weight") * F.lit(level) > cap
        if not weight or not sources.filter(above & ~clamped).limit(1).count():
            return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level)))
        clamped = clamped | above if level == 0 else above


def mix(docs: DataFrame, *, weigh: Callable[[DataFrame], DataFrame], max_epochs: int = 3, share: float = 1.0,
        seed: int = 17, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Every document with what the mix takes of it.

    Columns: ``row`` (the document, all its columns), ``size``, ``source_size``,
    ``target`` (of its source), ``copies`` (0 to ``max_epochs``) and ``taken``
    (words, copies counted). NULL and empty texts have size 0 and are never
    taken; NULL is a source like any other; rows equal in id, text and source
    share one draw. An empty table gives an empty table.
    """
    h = F.xxhash64(F.lit(seed), col(doc_id), col(source), F.xxhash64(col(text)))
    slim = materialize(docs.select(col(source).alias("source"), h.alias("h"), word_count(col(text)).alias("size")),
                       "mix-sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(targets(materialize(weigh(sources), "mix-weights"), max_epochs, share), "mix-targets")
    n = sources.count()

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio + 1e-12), F.lit(max_epochs)).cast("long")
    plan = sources.withColumn("epochs", whole).withColumn(
        "rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))

    # Words per hash prefix and source; the prefix in which the rest of the target ends.
    prefix = F.shiftrightunsigned("h", 64 - PREFIX_BITS)
    per = slim.filter("size > 0").groupBy("source", prefix.alias("p")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("p")
    per = per.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    s = [F.col(c).alias(f"s_{c}") for c in ("source", "rest", "epochs")]
    same = F.col("source").eqNullSafe(F.col("s_source"))
    ends = (per.join(bounded(plan.select(*s), n), same)
            .filter((F.col("before") < F.col("s_rest")) & (F.col("before") + F.col("n") >= F.col("s_rest")))
            .select("s_source", "p", "before", "s_rest"))
    ends = materialize(ends, "mix-ends")
    edge = (slim.filter("size > 0").withColumn("hp", prefix)
            .join(bounded(ends, n), same & (F.col("hp") == F.col("p")))
            .groupBy("s_source", "s_rest", "before", "h").agg(F.sum("size").alias("n")))
    run = F.sum("n").over(Window.partitionBy("s_source").orderBy("h"))
    edge = edge.withColumn("upto", F.col("before") + run)
    # Up to the document that ends nearest to the target.
    near = F.col("upto") - F.col("n") / 2 <= F.col("s_rest")
    cuts = edge.groupBy("s_source").agg(F.max(F.when(near, F.col("h"))).alias("cut"), F.min("h").alias("first"))
    # No document of that prefix: everything below the first is still in.
    cuts = cuts.select(F.col("s_source").alias("c_source"),
                       F.coalesce(F.col("cut"), F.col("first") - 1).alias("cut"))
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        *[F.col(c).alias(f"s_{c}") for c in ("source", "source_size", "target", "epochs", "rest", "cut")])

    # Signed order of h differs from the order of its prefix; compare both alike.
    out = packed(docs, source=col(source), h=h, size=word_count(col(text)))
    flip = F.lit(-(1 << 63))
    ranked = F.col("h").bitwiseXOR(flip) <= F.col("s_cut").bitwiseXOR(flip)
    extra = F.when((F.col("s_rest") > 0) & ranked, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("s_epochs") + extra).otherwise(F.lit(0)).cast("long")
    return (out.join(bounded(plan, n), F.col("source").eqNullSafe(F.col("s_source")))
            .select("row", "size", F.col("s_source_size").alias("source_size"),
                    F.col("s_target").alias("target"), copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each taken document once per copy, with what was decided."""
    at = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    kept = mixed.filter("copies > 0").withColumn("copy", at)
    names = mixed.schema["row"].dataType.names
    extra = [c for c in ("size", "source_size", "target", "copies", "copy") if c not in names]
    return kept.select("row.*", *extra)


@query("op1_mix_sources")
def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, weigh=cycled(CYCLE)).select("row.doc_id", "size", "source_size", "target", "taken", "copies")
