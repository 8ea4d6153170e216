"""Row-level table operators: de-duplication, sequence numbers, contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize
from tidewatch.spec import UNKNOWN_CLASS, ContractError, FlowSpec

LOCAL_BITS = 33  # of monotonically_increasing_id: the place in a partition


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def distinct_flows(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str] = ()) -> DataFrame:
    """One row per key, the first by ``order_cols``; NULLs are equal.

    An aggregate, not a ranking window: copies collapse before the shuffle, so a
    flow that makes up a third of the table reaches its task once per mapper.
    """
    rest = [c for c in df.columns if c not in set(key_cols)]
    if not rest:
        return df.dropDuplicates(list(key_cols))
    first = F.min(F.struct(*[q(c).alias(f"o{i}") for i, c in enumerate(order_cols)],
                           *[q(c).alias(f"r{i}") for i, c in enumerate(rest)]))
    keyed = df.groupBy(*[q(c) for c in key_cols]).agg(first.alias("_first"))
    picked = {c: F.col(f"_first.r{i}").alias(c) for i, c in enumerate(rest)}
    return keyed.select(*[picked.get(c, q(c)) for c in df.columns])


def numbered(df: DataFrame, order_cols: Sequence[str], name: str = "seq", start: int = 1) -> DataFrame:
    """Gapless row numbers in the order of ``order_cols``, ties in any order.

    Rows are sorted by ranges and stored, so a number never changes; a row's number is
    its place in its range plus the rows of the ranges before. Only one count per
    range passes through the driver, and no task sees more than its range.
    """
    order = [q(c).asc_nulls_first() for c in order_cols]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", LOCAL_BITS)
    counts = placed.groupBy(part.cast("int").alias("_p")).count().orderBy("_p").collect()
    before, offsets = start, []
    for r in counts:
        offsets.append((r["_p"], before))
        before += r["count"]
    lookup = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _before long"))
    local = F.col("_m").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return (placed.withColumn("_p", part.cast("int")).join(lookup, "_p")
            .withColumn(name, F.col("_before") + local).select(*[q(c) for c in df.columns], q(name)))


def with_sequence(df: DataFrame, key: str, name: str = "seq", start: int = 1) -> DataFrame:
    """Gapless row numbers in the order of one key; see :func:`numbered`."""
    return numbered(df, [key], name, start)


def settled(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are worked out once per row, whatever reads them.

    A filter on a plain column is pushed below the projections that make it, with a copy of
    all it rests on for each of its uses; it does not pass a generator. One row in, one out.
    """
    return df.select("*", F.stack(F.lit(1), *columns.values()).alias(*columns))


def flow_id(seq: Column, prefix: str) -> Column:
    """Prefix and at least six digits; longer numbers are kept whole."""
    return F.format_string(f"{prefix}%06d", seq)


# --- contracts -----------------------------------------------------------------

def contract(df: DataFrame, features: Sequence[str], *, allow_extra: bool = True) -> DataFrame:
    """The contract's columns, in its order; raises when any are absent."""
    have = set(df.columns)
    missing = [f for f in features if f not in have]
    extra = [c for c in df.columns if c not in set(features)]
    if missing or (extra and not allow_extra):
        raise ContractError(missing, extra)
    return df.select(*[q(f) for f in features])


def split_identity(df: DataFrame, spec: FlowSpec, profile: str | None = None) -> DataFrame:
    """Two structs: what the model may see, and what only names the flow."""
    features = [q(f).alias(f) for f in spec.features(profile)]
    identity = [q(c).alias(c) for c in (*spec.identity, "capture_timestamp") if c in df.columns]
    return df.select(F.struct(*features).alias("features"), F.struct(*identity).alias("identity"))


def missing_keys(record: Column, features: Sequence[str]) -> Column:
    """Contract features a ``map<string,...>`` record lacks, in contract order."""
    return F.filter(F.array(*[F.lit(f) for f in features]), lambda f: ~F.map_contains_key(record, f))


def profiles_satisfied(record: Column, profiles: Mapping[str, Sequence[str]]) -> Column:
    checks = [F.when(F.forall(F.array(*[F.lit(f) for f in feats]), lambda f: F.map_contains_key(record, f)),
                     F.lit(name)) for name, feats in profiles.items()]
    return F.array_compact(F.array(*checks))


def rowwise_contract(df: DataFrame, record: str, spec: FlowSpec, profile: str | None = None) -> DataFrame:
    """Per-record contract check for semi-structured input.

    Refused records keep flowing, marked: class UNKNOWN, confidence 0, up for
    review, with the missing features and the profiles they would satisfy.
    """
    absent = missing_keys(F.col(record), spec.features(profile))
    out = df.withColumn("missing_features", absent)
    refused = F.size("missing_features") > 0
    return out.withColumns({
        "contract_satisfied": ~refused,
        "satisfies": profiles_satisfied(F.col(record), spec.profiles),
        "threat_class": F.when(refused, F.lit(UNKNOWN_CLASS)),
        "confidence": F.when(refused, F.lit(0.0)),
        "needs_review": refused,
    })


def zero_fill(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Lenient scoring input: unusable features become 0 and are listed."""
    lacking = [f for f in features if f not in df.columns]
    base = df.withColumns({f: F.lit(None).cast("double") for f in lacking}) if lacking else df
    names = F.array_compact(F.array(*[F.when(q(f).isNull(), F.lit(f)) for f in features]))
    listed = base.withColumn("missing_features", names)
    unusable = F.size("missing_features") == len(features)
    return (listed.withColumn("model_ready_input", ~unusable)
            .withColumns({f: F.coalesce(q(f), F.lit(0.0)) for f in features}))
