"""Severity as column expressions: bands, ladder, escalation and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.coerce import clamp_unit
from tidewatch.functions.text import percent
from tidewatch.spec import DEGRADED, UNKNOWN, UNRELIABLE, SeverityPolicy

POLICY = SeverityPolicy()


def band(confidence: Column, policy: SeverityPolicy = POLICY) -> Column:
    """Half-open confidence bands; unusable confidence counts as 0."""
    value = clamp_unit(confidence)
    out = F.lit(policy.bands[0][1])
    for lower, name in policy.bands[1:]:
        out = F.when(value >= lower, F.lit(name)).otherwise(out)
    return out


def ladder_rank(severity: Column, policy: SeverityPolicy = POLICY) -> Column:
    """Position on the ladder, -1 for anything else."""
    out = F.lit(-1)
    for i, name in enumerate(policy.ladder):
        out = F.when(severity == name, F.lit(i)).otherwise(out)
    return out


def escalate(severity: Column, policy: SeverityPolicy = POLICY) -> Column:
    """One rung up, stopping at the top; unknown names stay as they are."""
    out = severity
    for name, above in zip(policy.ladder, policy.ladder[1:]):
        out = F.when(severity == name, F.lit(above)).otherwise(out)
    return out


def assess(df: DataFrame, *, threat: str = "reported_threat", confidence: str = "confidence",
           prediction: str = "model_prediction", policy: SeverityPolicy = POLICY) -> DataFrame:
    """Add severity, its derivation and both queue flags.

    Unreliable input is triaged first, benign verdicts next, all else by band.
    Done in three projections, so each step is computed once per row.
    """
    verdict, tier = F.col(threat), F.col("reliability")
    unreliable, degraded = tier.eqNullSafe(UNRELIABLE), tier.eqNullSafe(DEGRADED)
    benign = F.coalesce(verdict == policy.benign, F.lit(False))
    escalates = F.coalesce(verdict.isin(*policy.escalate), F.lit(False))
    path = (F.when(unreliable, F.lit("ood")).when(benign, F.lit("benign")).otherwise(F.lit("band")))
    staged = df.withColumns({"_path": path, "_band": band(F.col(confidence), policy),
                             "_pct": percent(clamp_unit(F.col(confidence)))})
    on_ood, on_benign = F.col("_path") == "ood", F.col("_path") == "benign"
    staged = staged.withColumns({
        "base_severity": F.when(on_ood, F.lit(policy.ood_severity))
        .when(on_benign, F.lit(policy.benign_severity)).otherwise(F.col("_band")),
        "escalated": (F.col("_path") == "band") & escalates & (F.col("_band") != policy.ladder[-1])})
    staged = staged.withColumn("severity", F.when(
        F.col("escalated"), escalate(F.col("base_severity"), policy)).otherwise(F.col("base_severity")))
    pct, base = F.col("_pct"), F.col("base_severity")
    note = F.when(degraded, F.lit(" One feature is out of the training range: treat with caution.")).when(
        tier.eqNullSafe(UNKNOWN), F.lit(" No reference was available to check reliability.")).otherwise(F.lit(""))
    said = F.coalesce(F.col(prediction), verdict)

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    reason = (
        F.when(on_ood, text(
            "Input is out of the training distribution. The classifier said ", said, " at ", pct,
            ", which is its own certainty and no measure of correctness here. "
            f"Flagged {policy.ood_severity} for review."))
        .when(on_benign, text(
            "Classified ", verdict, " at ", pct, ". Benign flows are kept for context, not ranked.",
            F.when(degraded, F.lit(" One feature is out of the training range: sent to review.")).otherwise(F.lit(""))))
        .when(F.col("escalated"), text(
            "Confidence ", pct, " is ", base, "; raised to ", F.col("severity"), " because ", verdict,
            " acts directly on availability or hosts.", note))
        .when(escalates, text(
            "Confidence ", pct, " is ", base, ", the top band; ", verdict, " cannot be raised further.", note))
        .otherwise(text(
            "Confidence ", pct, " is ", base, ". ", verdict,
            " is not raised: it shows reconnaissance, no impact yet.", note)))
    return staged.withColumns({
        "severity_reason": reason,
        "is_alertable": ~on_benign & F.col("severity").isin(*policy.alertable),
        "needs_review": unreliable | degraded,
    }).drop("_path", "_band", "_pct")
