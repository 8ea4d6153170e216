"""Distribution check and verdict.

The bounds of a reference are one small entry per feature, so they are folded
into the projection as literals: scoring stays a narrow map over the rows. The
counting part is plain arithmetic that compiles; the nested detail is an
opt-in for the paths that emit alerts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import severity as sev
from tidewatch.functions.text import grouped, significant
from tidewatch.spec import (DEGRADED, OOD_CLASS, RELIABLE, UNKNOWN, UNRELIABLE, Bound,
                            DistributionReference, SeverityPolicy)

MIN_WIDTH = 1e-9


def _bounded(ref: DistributionReference) -> list[tuple[str, Bound]]:
    return [(f, ref.bounds[f]) for f in ref.features if f in ref.bounds]


def _above(feature: str, b: Bound) -> Column:
    return F.col(f"`{feature}`") > b.upper


def _below(feature: str, b: Bound) -> Column:
    return F.col(f"`{feature}`") < b.lower


def _outside(feature: str, b: Bound) -> Column:
    """True only for finite values beyond a bound (NULL and NaN never are)."""
    value = F.col(f"`{feature}`")
    usable = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.coalesce(usable & (_above(feature, b) | _below(feature, b)), F.lit(False))


def _excursion(feature: str, b: Bound) -> Column:
    """Range widths beyond the nearer bound; NULL in range."""
    value, width = F.col(f"`{feature}`"), F.lit(max(b.upper - b.lower, MIN_WIDTH))
    return F.when(_outside(feature, b), F.try_divide(F.greatest(value - b.upper, b.lower - value), width))


def with_excursions(df: DataFrame, ref: DistributionReference) -> DataFrame:
    """Add ``_x<i>`` per bounded feature: what all else is derived from."""
    return df.withColumns({f"_x{i}": _excursion(f, b) for i, (f, b) in enumerate(_bounded(ref))})


def _excursions(ref: DistributionReference) -> list[Column]:
    return [F.col(f"_x{i}") for i in range(len(_bounded(ref)))]


def violation_flags(ref: DistributionReference) -> dict[str, Column]:
    """Per feature: is the row's value out of range."""
    return {f: _outside(f, b) for f, b in _bounded(ref)}


def violation_count(ref: DistributionReference) -> Column:
    return reduce(lambda a, b: a + b, [_outside(f, b).cast("int") for f, b in _bounded(ref)], F.lit(0))


def violations(ref: DistributionReference) -> Column:
    """Violations as ``order_key, position, item``, worst first; ties keep the
    feature order. Needs ``n_violations`` and the columns of :func:`with_excursions`.

    Every feature has an entry and those in range sort last, so the result is a
    prefix and no lambda is needed; rows without a violation skip all of it.
    """
    entries = []
    for i, ((f, b), x) in enumerate(zip(_bounded(ref), _excursions(ref))):
        entries.append(F.struct(
            F.coalesce(-x, F.lit(float("inf"))).alias("order_key"), F.lit(i).alias("position"),
            F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("value"),
                     F.array(F.lit(b.lower), F.lit(b.upper)).alias("training_range"),
                     F.lit(b.median).alias("training_median"),
                     F.when(_above(f, b), F.lit("above")).otherwise(F.lit("below")).alias("direction"),
                     F.bround(x, 2).alias("excursion_range_widths")).alias("item")))
    n = F.col("n_violations")
    ordered = F.sort_array(F.array(*entries))
    return F.when(n > 0, F.slice(ordered, F.lit(1), n)).otherwise(F.slice(ordered, 1, 0))


def with_reason(df: DataFrame, ref: DistributionReference) -> DataFrame:
    """Add ``ood_reason``; the number texts are staged so each is built once."""
    total, tier, n = str(len(ref.features)), F.col("reliability"), F.col("n_violations")
    staged = df.withColumn("_w", F.get("violations", 0)).withColumns({
        "_worst": F.col("_w.item"), "_excursion": -F.col("_w.order_key")})
    some, worst = n > 0, F.col("_worst")
    staged = staged.withColumns({
        "_value": F.when(some, significant(worst["value"])),
        "_low": F.when(some, significant(F.get(worst["training_range"], 0))),
        "_high": F.when(some, significant(F.get(worst["training_range"], 1))),
        "_times": F.when(some, grouped(F.col("_excursion"), 1))})
    side = worst["direction"]
    described = F.concat(
        worst["feature"], F.lit(" = "), F.col("_value"), F.lit(" is "), side, F.lit(" the training bound of "),
        F.when(side == "above", F.col("_high")).otherwise(F.col("_low")), F.lit(" (range ["), F.col("_low"),
        F.lit(", "), F.col("_high"), F.lit("], "), F.col("_times"), F.lit("x the range width beyond it)"))
    opening = F.when(tier == UNRELIABLE, F.concat(n.cast("string"), F.lit(
        f" of {total} features are out of the range seen in training, so the model extrapolates and is not "
        "to be trusted. Worst: "))).otherwise(
        F.lit(f"1 of {total} features is out of the training range. Treat with caution. "))
    reason = (
        F.when(n > 0, F.concat(opening, described))
        .when(tier == DEGRADED, F.lit(
            "All features are in range, but the benign-traffic novelty detector flagged this flow."))
        .when(tier == RELIABLE, F.lit(f"All {total} features are in the range seen in training."))
        .otherwise(F.lit("No distribution reference was available.")))
    return staged.withColumn("ood_reason", reason).drop(
        "_w", "_worst", "_excursion", "_value", "_low", "_high", "_times")


def reliability(n: Column, ref: DistributionReference | None, novelty_flagged: Column | None = None) -> Column:
    if ref is None or not ref.features or not ref.bounds:
        return F.lit(UNKNOWN)
    calm = F.lit(RELIABLE)
    if novelty_flagged is not None:
        calm = F.when(F.coalesce(novelty_flagged, F.lit(False)), F.lit(DEGRADED)).otherwise(calm)
    return F.when(n >= ref.min_violations, F.lit(UNRELIABLE)).when(n >= 1, F.lit(DEGRADED)).otherwise(calm)


def ood_score(n: Column, worst: Column, features: int) -> Column:
    """0 when clean, else rising with the count and the worst excursion, at most 1."""
    count_term = F.least(n / F.lit(float(max(features, 1))), F.lit(1.0))
    excursion_term = F.least(worst / 10.0, F.lit(1.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.least(0.5 * count_term + 0.5 * excursion_term + 0.25, F.lit(1.0)))


def assess(df: DataFrame, ref: DistributionReference | None, *,
           prediction: str = "model_prediction", confidence: str = "confidence",
           policy: SeverityPolicy = sev.POLICY, novelty_flagged: Column | None = None,
           detail: bool = False) -> DataFrame:
    """Add reliability, verdict and severity to rows with a prediction.

    ``detail`` also adds the nested violations and the reason text; reports do
    not need them, alerts do.
    """
    if ref is None or not ref.features or not ref.bounds:
        out = df.withColumns({
            "n_violations": F.lit(0), "worst_excursion": F.lit(0.0),
            "reliability": F.lit(UNKNOWN), "in_distribution": F.lit(None).cast("boolean"),
            "ood_score": F.lit(0.0)})
    else:
        beyond = _excursions(ref)
        counted = with_excursions(df, ref).withColumns({
            "n_violations": reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in beyond], F.lit(0)),
            "worst_excursion": reduce(F.greatest, [F.coalesce(x, F.lit(0.0)) for x in beyond], F.lit(0.0))})
        tier = reliability(F.col("n_violations"), ref, novelty_flagged)
        out = counted.withColumns({
            "reliability": tier,
            "in_distribution": F.col("n_violations") < ref.min_violations,
            "ood_score": ood_score(F.col("n_violations"), F.col("worst_excursion"), len(ref.features))})
    out = out.withColumn("reported_threat", F.when(
        F.col("reliability") == UNRELIABLE, F.lit(OOD_CLASS)).otherwise(F.col(prediction)))
    out = sev.assess(out, confidence=confidence, prediction=prediction, policy=policy)
    scratch = [] if ref is None else [f"_x{i}" for i in range(len(_bounded(ref)))]
    if not detail:
        return out.drop(*scratch)
    if ref is None or not ref.bounds:
        none = F.array().cast(
            "array<struct<order_key:double,position:int,item:struct<feature:string,value:double,"
            "training_range:array<double>,training_median:double,direction:string,excursion_range_widths:double>>>")
        return out.withColumns({"violations": none,
                                "ood_reason": F.lit("No distribution reference was available.")})
    return with_reason(out.withColumn("violations", violations(ref)).drop(*scratch), ref)


def correct(truth: Column, prediction: Column) -> Column:
    """Judged against the classifier's answer, never the verdict; NULL without truth."""
    return F.when(truth.isNotNull(), F.coalesce(truth == prediction, F.lit(False)))


def known(truth: Column, classes: Sequence[str]) -> Column:
    return F.coalesce(truth.isin(*classes), F.lit(False))
