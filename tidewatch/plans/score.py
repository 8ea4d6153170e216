"""Scoring: flows to predictions, verdicts, alerts and the report tables.

``assessed`` and ``alerts`` are narrow maps, shared by batch and streaming.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import evidence, forest, novelty, quality, verdict
from tidewatch.operators.rows import flow_id
from tidewatch.plans.train import TrainedProfile
from tidewatch.session import materialize
from tidewatch.spec import EvidencePolicy, FlowSpec, NoveltyPolicy, TARGET


def predictions(flows: DataFrame, trained: TrainedProfile, novelty_policy: NoveltyPolicy = NoveltyPolicy()) -> DataFrame:
    """Usable rows with the classifier's answer and, if fitted, a novelty score."""
    rows = quality.scoreable(flows, trained.features)
    scored = forest.score(rows, trained.model, trained.classes)
    if trained.novelty_nodes is None:
        return scored
    return novelty.with_novelty(scored, trained.novelty_nodes, trained.features, novelty_policy,
                                trained.reference.novelty.get("threshold"))


def assessed(scored: DataFrame, trained: TrainedProfile, *, detail: bool = False,
             novelty_policy: NoveltyPolicy = NoveltyPolicy()) -> DataFrame:
    drives = novelty_policy.drives_verdict and "novelty_flagged" in scored.columns
    return verdict.assess(scored, trained.reference, detail=detail,
                          novelty_flagged=F.col("novelty_flagged") if drives else None)


def alerts(assessed_rows: DataFrame, policy: EvidencePolicy, profile: str, mode: str, *, seq: str, prefix: str,
           truth: str | None = None, importances: Mapping[str, float] = {},
           identity: Mapping[str, str] = alert_ops.IDENTITY_FIELDS, observed: Column | None = None) -> DataFrame:
    """Alert rows; ``seq`` is the observation number of the flow."""
    rows = assessed_rows.withColumn("flow_id", flow_id(F.col(seq), prefix))
    rows = evidence.with_evidence(rows, policy, importances)
    return alert_ops.build_alerts(rows, profile=profile, mode=mode, truth=truth, identity=identity, observed=observed)


def every_alert(flows: DataFrame, features: Sequence[str], assess: Callable[[DataFrame], DataFrame], policy: EvidencePolicy,
                profile: str, mode: str, *, seq: str, prefix: str, truth: str | None = None,
                importances: Mapping[str, float] = {}, identity: Mapping[str, str] = alert_ops.IDENTITY_FIELDS,
                observed: Column | None = None) -> DataFrame:
    """One alert per flow, in batch and streaming alike: judged by ``assess`` where all
    features are usable, else UNKNOWN and up for review."""
    judged = alerts(assess(quality.scoreable(flows, features)), policy, profile, mode, seq=seq, prefix=prefix, truth=truth,
                    importances=importances, identity=identity, observed=observed)
    refused = quality.unscoreable(flows, features).withColumn("flow_id", flow_id(F.col(seq), prefix))
    return judged.unionByName(alert_ops.unknown_alerts(refused, features, profile=profile, mode=mode, truth=truth,
                                                       identity=identity, observed=observed))


PREDICTION_COLUMNS = ("reported_threat", "model_prediction", "confidence", "reliability", "ood_score",
                      "severity", "is_alertable", "needs_review")


def prediction_table(rows: DataFrame, spec: FlowSpec, truth: str | None = TARGET) -> DataFrame:
    """Per-flow verdict columns with identity and, where known, truth."""
    rounded = {"confidence": F.bround("confidence", 4), "ood_score": F.bround("ood_score", 4)}
    out = [rounded.get(c, F.col(c)).alias(c) for c in PREDICTION_COLUMNS]
    out += [F.col(f"`{c}`") for c in spec.identity if c in rows.columns]
    if truth and truth in rows.columns:
        out += [F.col(truth).alias("ground_truth"),
                verdict.correct(F.col(truth), F.col("model_prediction")).alias("correct")]
    return rows.select(*out)


def summary(rows: DataFrame, source: str, profile: str) -> DataFrame:
    """Scoring summary as rows ``input, profile, section, name, n``: one aggregate over
    one scan of the scored table, a few entries per row combined before the shuffle."""
    def entry(section: str, name: Column, n: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("long").alias("n"))

    one = F.lit(1)
    entries = F.array(
        entry("predicted", F.col("model_prediction"), one), entry("reported", F.col("reported_threat"), one),
        entry("severity", F.col("severity"), one), entry("reliability", F.col("reliability"), one),
        entry("total", F.lit("alertable"), F.col("is_alertable")),
        entry("total", F.lit("review_only"), F.col("needs_review") & ~F.col("is_alertable")),
        entry("total", F.lit("scored"), one))
    out = rows.select(F.explode(entries).alias("e")).groupBy("e.section", "e.name").agg(F.sum("e.n").alias("n"))
    return out.select(F.lit(source).alias("input"), F.lit(profile).alias("profile"), "section", "name", "n")


def write_summary(table: DataFrame, path: str) -> None:
    """Replaces only the (input, profile) folders the table holds."""
    (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("input", "profile").parquet(path))


def stored(assessed_rows: DataFrame) -> DataFrame:
    """The scored table, written once for all that follows.

    Some twenty reports and the alert queue read it. It also keeps the optimizer
    from pushing a report's filter, and with it a copy of every expression the
    filter rests on, down through the whole scoring chain.
    """
    return materialize(assessed_rows, "scored")


def write_alert_queue(alert_rows: DataFrame, path: str) -> None:
    """Alerts of both queues as compressed JSON lines; ``alert_rows`` holds queued rows only."""
    alert_ops.alert_json(alert_rows).write.mode("overwrite").text(path, compression=alert_ops.COMPRESSION)
