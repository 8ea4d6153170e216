import numpy as np

from tidewatch.llm import boosting


def test_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert (((model.margin(x[2000:]) > 0) == y[2000:]).mean()) > 0.95


def test_threshold_keeps_ties_together():
    score, truth = np.array([3.0, 2, 2, 2, 1]), np.array([1, 1, 1, 0, 0])
    assert boosting.threshold(score, truth, 0.75, 1) == 2 and boosting.threshold(score, truth, 0.8, 1) == 3
    assert boosting.threshold(score, truth, 0.9, 3) == np.inf and boosting.threshold(score[:0], truth[:0], 0.9, 1) == np.inf


def test_one_class_and_constant_features():
    model = boosting.fit(np.zeros((10, 3)), np.ones(10))
    assert (model.margin(np.zeros((2, 3))) > 0).all()


def test_blocks_of_an_rdd_give_the_same_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (600, 4)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 3)).astype(float)
    whole = boosting.fit(x, y, trees=5)
    edges = [np.unique(np.quantile(x[:, f], boosting.PROBS)) for f in range(4)]
    cases = [(boosting.binned(x[i:i + 70], edges), y[i:i + 70], np.ones(len(y[i:i + 70]))) for i in range(0, 600, 70)]
    for parts in (1, 4):
        got = boosting.fit_blocks(spark.sparkContext.parallelize(cases, parts), edges, boosting.log_odds(y.mean()), trees=5)
        assert all(np.array_equal(a, b) for a, b in zip(got, whole))


def test_a_threshold_counts_cases_by_number():
    score, true, n = np.array([2.0, 1.0]), np.array([9, 0]), np.array([10, 10])
    assert boosting.threshold(score, true, 0.9, 10, n) == 2 and boosting.threshold(score, true, 0.9, 11, n) == np.inf


def test_a_level_is_one_stage(spark):
    """Sums of a level go straight to the driver; rounds of shuffles would cost more than the sums."""
    context = spark.sparkContext
    cases = [(np.full((3, 2), i % 3, np.uint8), np.array([i % 2.0, 1, 0]), np.ones(3)) for i in range(40)]
    edges = [np.array([0.5, 1.5])] * 2
    context.setJobGroup("one-stage", "")
    try:
        boosting.fit_blocks(context.parallelize(cases, 20), edges, 0.0, trees=2, depth=2)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup("one-stage")]
    assert len(jobs) == 4 and all(len(j.stageIds) == 1 for j in jobs)
