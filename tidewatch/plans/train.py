"""Training: split, forest, distribution reference, metrics, artefacts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import evaluation, forest, novelty, quality
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.sampling import class_cap, stratified_split
from tidewatch.session import materialize
from tidewatch.spec import (TARGET, Bound, ContractError, DistributionReference, FlowSpec, NoveltyPolicy,
                            TrainingPolicy)


@dataclass(frozen=True)
class TrainedProfile:
    profile: str
    features: tuple[str, ...]
    classes: tuple[str, ...]
    model: forest.Forest
    reference: DistributionReference
    novelty_nodes: DataFrame | None = None


def split(flows: DataFrame, spec: FlowSpec, policy: TrainingPolicy, key: Sequence[str],
          target: str = TARGET) -> DataFrame:
    """Flows with ``is_test``; the same rows whoever asks."""
    return stratified_split(flows, target, key, policy.test_share, policy.seed, spec.classes)


def quantile_bounds(train: DataFrame, features: Sequence[str], quantile: float) -> DataFrame:
    """``feature, lower, upper, median, n`` of the training split."""
    stats = exact_quantiles(train, features, [quantile, 1.0 - quantile, 0.5])
    return stats.select("feature", F.col("values")[0].alias("lower"), F.col("values")[1].alias("upper"),
                        F.col("values")[2].alias("median"), "n")


def reference_from(bounds: DataFrame, features: Sequence[str], quantile: float, min_violations: int = 2,
                   novelty_stats: Mapping[str, float] | None = None) -> DistributionReference:
    """The bounds table as a reference; it has one row per feature."""
    rows = {r["feature"]: r for r in bounds.collect()}
    return DistributionReference(
        features=tuple(features), quantile=quantile, min_violations=min_violations,
        bounds={f: Bound(rows[f]["lower"], rows[f]["upper"], rows[f]["median"]) for f in features if f in rows},
        n_training_rows=max((r["n"] for r in rows.values()), default=0), novelty=dict(novelty_stats or {}))


def train(flows: DataFrame, spec: FlowSpec, key: Sequence[str], profile: str | None = None,
          policy: TrainingPolicy = TrainingPolicy(), novelty_policy: NoveltyPolicy | None = NoveltyPolicy(),
          quantile: float = 0.001) -> TrainedProfile:
    """Fit one profile on the training part of ``flows``.

    ``policy.class_cap`` bounds what the classifier is fitted on; bounds, detector and
    threshold come from the whole training part.
    """
    features = spec.features(profile)
    _require(flows, features)
    rows = materialize(split(flows, spec, policy, key).filter(~F.col("is_test")), "training-part")
    return fit(rows, spec, key, profile, policy, novelty_policy, quantile)


def _require(flows: DataFrame, features: Sequence[str]) -> None:
    missing = [f for f in features if f not in flows.columns]
    if missing:
        raise ContractError(missing)


def fit(rows: DataFrame, spec: FlowSpec, key: Sequence[str], profile: str | None, policy: TrainingPolicy,
        novelty_policy: NoveltyPolicy | None, quantile: float = 0.001) -> TrainedProfile:
    """Fit one profile on a stored training part; it is read again by each step."""
    features = spec.features(profile)
    _require(rows, features)
    quality.require_finite(rows, features)
    model = forest.fit_forest(class_cap(rows, TARGET, key, policy.class_cap, policy.seed, spec.classes), features, policy, key)
    nodes, stats = None, None
    if novelty_policy is not None:
        benign = rows.filter(F.col(TARGET) == spec.benign)
        nodes = novelty.fit(benign, features, key, novelty_policy, policy.seed)
        if nodes is not None:
            nodes = materialize(nodes, "novelty-nodes")
            stats = novelty.reference(benign, nodes, features, novelty_policy).first().asDict()
    reference = reference_from(quantile_bounds(rows, features, quantile), features, quantile, novelty_stats=stats)
    return TrainedProfile((profile or spec.default_profile).upper(), tuple(features), model.classes, model, reference, nodes)


def metrics(scored: DataFrame, classes: Sequence[str], truth: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """Per-class and overall metrics of scored rows."""
    prf = evaluation.class_prf(evaluation.confusion(scored, classes, truth=truth))
    return prf, evaluation.overall_metrics(prf)


def compare_profiles(flows: DataFrame, spec: FlowSpec, key: Sequence[str], policy: TrainingPolicy) -> DataFrame:
    """Every profile trained and evaluated on the same split, side by side.

    One forest per profile: the loop is over the spec's profiles, not over data.
    """
    parts, rows = materialize(split(flows, spec, policy, key), "split"), None
    test = parts.filter("is_test")
    for profile in spec.profiles:
        fitted = fit(parts.filter("NOT is_test"), spec, key, profile, policy, None)
        prf, overall = metrics(forest.score(test, fitted.model, fitted.classes), fitted.classes)
        one = prf.select(F.lit(profile).alias("profile"), F.lit(len(fitted.features)).alias("n_features"),
                         "class", "f1", F.lit(1).alias("_k")).join(
            F.broadcast(overall.select("accuracy", "balanced_accuracy", "f1_macro", F.lit(1).alias("_k"))), "_k").drop("_k")
        rows = one if rows is None else rows.unionByName(one)
    return evaluation.profile_comparison(rows)


# --- artefacts -----------------------------------------------------------------

def _write_json(spark: SparkSession, path: str, payload: str) -> None:
    spark.createDataFrame([(payload,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save(trained: TrainedProfile, root: str, spark: SparkSession) -> str:
    """Model, contract and reference under ``<root>/<profile>/``."""
    base = f"{root}/{trained.profile.lower()}"
    forest.save(trained.model, f"{base}/model")
    _write_json(spark, f"{base}/contract", json.dumps({
        "profile": trained.profile, "features": list(trained.features), "classes": list(trained.classes),
        "trees": trained.model.trees, "max_depth": trained.model.max_depth, "rows": trained.model.rows}))
    _write_json(spark, f"{base}/reference", trained.reference.to_json())
    nodes = trained.novelty_nodes
    empty = spark.createDataFrame([], novelty.NODE_SCHEMA)  # no stale detector stays behind
    (nodes if nodes is not None else empty).write.mode("overwrite").parquet(f"{base}/novelty")
    return base


def load(spark: SparkSession, root: str, spec: FlowSpec, profile: str | None = None) -> TrainedProfile:
    """A saved profile, refused when it does not fit the spec."""
    name = (profile or spec.default_profile).upper()
    base = f"{root}/{name.lower()}"
    contract = _read_json(spark, f"{base}/contract")
    if contract["profile"] != name or contract["features"] != spec.features(name):
        raise ContractError([f for f in spec.features(name) if f not in contract["features"]])
    model = forest.load(spark, f"{base}/model", contract["features"], contract["classes"], contract["trees"],
                        contract["max_depth"], contract["rows"])
    reference = DistributionReference.from_json(json.dumps(_read_json(spark, f"{base}/reference")))
    nodes = spark.read.parquet(f"{base}/novelty")
    return TrainedProfile(name, tuple(contract["features"]), tuple(contract["classes"]), model, reference,
                          nodes if reference.novelty else None)
