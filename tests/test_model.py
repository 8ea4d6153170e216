"""The model path: fit, save, load, refusal, comparison, and the plans of its reports."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import ORACLES, learning
from tidewatch.catalog.standin import CARRY, LINE_SPEC, flows
from tidewatch.plans import score
from tidewatch.plans import train as training
from tidewatch.session import drop_scratch, materialize, scratch_mark
from tidewatch.spec import ContractError, NoveltyPolicy, TrainingPolicy


@pytest.fixture(scope="module")
def fitted(spark, small):
    return learning.trained(spark, small)


def test_saved_profile_scores_as_before(spark, small, tmp_path, fitted):
    training.save(fitted, str(tmp_path), spark)
    back = training.load(spark, str(tmp_path), LINE_SPEC, "WIDE")
    assert (back.features, back.classes, back.reference.bounds) == (fitted.features, fitted.classes, fitted.reference.bounds)
    rows = learning._scored_flows(spark, small).filter("l_orderkey < 200")
    columns = [*CARRY, "model_prediction", "confidence", "novelty_score", "novelty_flagged"]
    one, two = (score.predictions(rows, m).select(*columns) for m in (fitted, back))
    assert one.count() == rows.count() and one.exceptAll(two).isEmpty()


def test_forest_has_the_default_size(fitted):
    assert (fitted.model.trees, fitted.model.max_depth) == (TrainingPolicy.trees, TrainingPolicy.max_depth) == (60, 20)
    assert fitted.model.nodes.select("tree").distinct().count() == 60


def test_cap_bounds_the_fit_alone(spark, small, monkeypatch):
    policy = TrainingPolicy(trees=2, max_depth=2, class_cap=50, seed=42)
    monkeypatch.setattr(learning, "POLICY", policy)
    learning.training_table.cache_clear()
    table = learning.training_table(spark, small)
    assert table.count() == learning._labelled(spark, small).count()
    train = training.split(table, LINE_SPEC, policy, CARRY).filter("NOT is_test")
    got = training.train(table, LINE_SPEC, CARRY, "WIDE", policy, learning.NOVELTY)
    assert got.model.rows == 50 * len(got.classes)
    assert got.reference.n_training_rows == train.count()
    assert got.reference.novelty["n_rows"] == train.filter("threat_class = 'BENIGN'").count() > 50


def test_the_queries_fit_all_training_rows(spark, small, fitted):
    """Before, at most 50,000 rows of a class were taken, in the SQL as well."""
    assert learning.POLICY.class_cap is None
    train = training.split(learning.training_table(spark, small), LINE_SPEC, learning.POLICY, CARRY).filter("NOT is_test")
    assert fitted.model.rows == train.count()
    assert "QUALIFY row_number" not in ORACLES["ml_train_forest"]


def test_contract_is_refused(spark, small, tmp_path, fitted):
    training.save(fitted, str(tmp_path), spark)
    other = dataclasses.replace(LINE_SPEC, profiles={"WIDE": ("quantity", "price", "discount", "weight"), "NARROW": ("quantity",)})
    with pytest.raises(ContractError):
        training.load(spark, str(tmp_path), other, "WIDE")
    with pytest.raises(ContractError):
        training.train(learning.training_table(spark, small).drop("tax"), LINE_SPEC, CARRY, "WIDE")


def test_profiles_are_compared_on_one_split(spark, small):
    policy = TrainingPolicy(trees=4, max_depth=3, seed=42)
    got = training.compare_profiles(learning.training_table(spark, small), LINE_SPEC, CARRY, policy)
    assert got.count() > 0 and any("WIDE" in str(r) for r in got.collect())


def test_novelty_can_drive_the_verdict(spark, small, fitted):
    policy = NoveltyPolicy(drives_verdict=True)
    scored = score.predictions(learning._scored_flows(spark, small), fitted)
    rows = materialize(score.assessed(scored, fitted, novelty_policy=policy), "test")
    flagged = rows.filter("novelty_flagged AND n_violations = 0")
    assert flagged.filter("reliability <> 'DEGRADED'").isEmpty() and flagged.filter("NOT needs_review").isEmpty()
    assert rows.filter("NOT novelty_flagged AND n_violations = 0 AND reliability <> 'RELIABLE'").isEmpty()


def test_summary_is_one_scan_and_one_exchange(spark, small, fitted):
    rows = materialize(score.assessed(score.predictions(learning._scored_flows(spark, small), fitted), fitted), "test")
    plan = score.summary(rows, "in", "wide")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_scratch_tables_can_be_dropped(spark):
    mark = scratch_mark()
    gone, kept = materialize(spark.range(5), "test"), materialize(spark.range(3), "test")
    drop_scratch(spark, mark, keep=kept)
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()


def test_numeric_features_take_no_way_through_text(spark, small):
    from tidewatch.operators import quality

    plan = quality.typed(flows(spark, small), ["quantity", "price"]).select(F.sum("quantity"), F.sum("price"))
    assert "regexp" not in plan._jdf.queryExecution().optimizedPlan().toString()
