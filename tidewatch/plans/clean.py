"""Cleaning: raw text rows to the processed flow table and its audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.operators import quality
from tidewatch.operators.rows import distinct_flows, q
from tidewatch.operators.sampling import class_cap
from tidewatch.session import materialize
from tidewatch.spec import CAPTURE_TS, TARGET, FlowSpec, TrainingPolicy


DROPPED = "_dropped_label"


def _texts(raw: DataFrame, spec: FlowSpec, carry: Sequence[str]) -> tuple[DataFrame, list[str]]:
    present = [c for c in spec.retained if c in raw.columns]
    return quality.nulls_for_na(raw.select(*[q(c) for c in (*present, *carry)]), present), present


def prepared(raw: DataFrame, spec: FlowSpec, carry: Sequence[str] = ()) -> DataFrame:
    """The narrow part: prune, drop empty and unlabelled rows, type, map labels.

    ``carry`` names columns that order rows but are no part of a flow.
    """
    texts, present = _texts(raw, spec, carry)
    return _kept(_marked(texts, present, spec), spec)


def _marked(texts: DataFrame, present: Sequence[str], spec: FlowSpec) -> DataFrame:
    """Typed rows; those whose label has no class are still there, under that label."""
    rows = quality.drop_empty(texts, present)
    if spec.label_column in present:
        rows = quality.marked_labels(quality.drop_unlabelled(rows, spec.label_column), spec, DROPPED)
    return quality.rename_capture(quality.typed(rows, spec.numeric_columns), spec)


def _kept(marked: DataFrame, spec: FlowSpec) -> DataFrame:
    return marked.filter(q(DROPPED).isNull()).drop(DROPPED) if DROPPED in marked.columns else marked


def dedup_key(df: DataFrame, spec: FlowSpec, carry: Sequence[str] = ()) -> list[str]:
    """All columns but identity, capture time and carried ones; the class is part."""
    return [c for c in df.columns if c not in {*spec.identity, CAPTURE_TS, *carry}]


def deduplicated(rows: DataFrame, spec: FlowSpec, carry: Sequence[str] = ()) -> DataFrame:
    return distinct_flows(rows, dedup_key(rows, spec, carry), carry)


def usable(rows: DataFrame, spec: FlowSpec) -> DataFrame:
    """Rows complete in every profile's features; evidence extras may be null."""
    return quality.drop_null_features(rows, spec.profile_features)


@dataclass(frozen=True)
class Cleaned:
    flows: DataFrame
    audit: DataFrame


def clean(raw: DataFrame, spec: FlowSpec, policy: TrainingPolicy = TrainingPolicy(),
          carry: Sequence[str] = ()) -> Cleaned:
    """Processed flows and audit; the raw rows are read once.

    Typed rows are written by a stage without a shuffle, whose tasks count once each
    however often executors are lost, so the counters of the audit are observed there.
    One shuffle for the duplicates, none for the cap beyond its prefix counts.
    """
    texts, present = _texts(raw, spec, carry)
    seen = Observation("cleaning")
    counters = quality.counter_columns(texts, spec)
    marked = materialize(_marked(texts.observe(seen, *counters), present, spec), "typed-flows")
    distinct = materialize(deduplicated(_kept(marked, spec), spec, carry), "distinct-flows")
    complete = usable(distinct, spec)
    capped = class_cap(complete, TARGET, dedup_key(complete, spec, carry), policy.class_cap, policy.seed, spec.classes)
    return Cleaned(quality.stable_order(capped.drop(*carry), spec), audit(seen.get, marked, distinct, spec, policy))


def audit(counters: Mapping[str, int], marked: DataFrame, distinct: DataFrame, spec: FlowSpec, policy: TrainingPolicy) -> DataFrame:
    """``step, detail, rows``: what each step removed, and what remains.

    Observed counters, and one pass each over the stored labels and the distinct rows.
    """
    spark = distinct.sparkSession
    broken = F.lit(False)
    for f in spec.profile_features:
        if f in distinct.columns:
            broken = broken | q(f).isNull()
    by = q(TARGET) if TARGET in distinct.columns else F.lit(None).cast("string")
    after = distinct.groupBy(by.alias("class")).agg(F.count("*").alias("n"), F.count_if(broken).alias("lost")).collect()  # one row per class
    steps = [(name, "", int(n or 0)) for name, n in counters.items()]
    steps += [("distinct_rows", "", sum(r["n"] for r in after)), ("unusable_rows", "", sum(r["lost"] for r in after))]
    if TARGET in distinct.columns:
        for r in after:
            left = r["n"] - r["lost"]
            capped = r["class"] in spec.classes and policy.class_cap is not None
            if left:
                steps.append(("written", r["class"], min(left, policy.class_cap) if capped else left))
    out = spark.createDataFrame(steps, "step string, detail string, rows long")
    if DROPPED in marked.columns:
        lost = marked.filter(q(DROPPED).isNotNull()).groupBy(q(DROPPED).alias("detail")).agg(F.count("*").alias("rows"))
        out = out.union(lost.select(F.lit("dropped_label"), "detail", "rows"))
    return out


def write_flows(flows: DataFrame, path: str) -> None:
    flows.write.mode("overwrite").parquet(path)
