"""Sampling, quantiles and numbering are exact under skew and ties."""

import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions.text import format_value, significant
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import rows, sampling, verdict
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.spec import Bound, DistributionReference


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; tails are heavy; some cells are null."""
    return spark.range(0, 9000, 1, 8).select(
        "id", F.when(F.col("id") < 8000, F.lit("big")).otherwise(F.lit("rare")).alias("cls"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).when(F.col("id") % 100 == 1, F.lit(None))
        .otherwise(F.exp(F.pmod(F.hash("id"), F.lit(1000)) / 50) - 5).alias("x"),
        F.when(F.col("id") % 2 == 0, F.col("id") / 7).otherwise(-F.col("id") * 1e9).alias("y")).persist()


PROBS = [0.0, 0.001, 0.25, 0.5, 0.95, 0.999, 1.0]


@pytest.mark.parametrize("by", [None, "cls"])
def test_counting_quantiles_are_exact(skewed, by):
    groups = ["big", "rare"] if by else ()
    out = exact_quantiles(skewed, ["x", "y"], PROBS, by=by, groups=groups).collect()
    table = skewed.toPandas()
    assert len(out) == (4 if by else 2)
    for r in out:
        part = table if by is None else table[table["cls"] == r["cls"]]
        column = part[r["feature"]].dropna()
        assert r["n"] == len(column)
        np.testing.assert_allclose(r["values"], np.quantile(column, PROBS), rtol=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_counting_quantiles_of_any_values(spark, values, prob):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    r = exact_quantiles(df, ["x"], [prob]).first()
    np.testing.assert_allclose(r["values"][0], np.quantile(values, prob), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("kwargs", [{"cap": 500}, {"cap": 10**6}, {"cap": 0}, {"share": 0.25}, {"share": 1.0}])
def test_sample_takes_the_first_by_hash(skewed, kwargs):
    got = sampling.mark_lowest(skewed, "cls", ["id"], 42, groups=["big", "rare", "absent"], **kwargs).select("id", "cls", "taken")
    table = got.toPandas()
    table["h"] = [hashlib.md5(f"42|{i}".encode()).hexdigest() for i in table["id"]]
    assert len(table) == 9000
    for _, part in table.groupby("cls"):
        quota = kwargs.get("cap", round(kwargs.get("share", 0) * len(part)))
        assert set(part[part["taken"]]["id"]) == set(part.sort_values("h")["id"][:quota])


@pytest.mark.parametrize("cap", [1, 5, 10, 13, 19, 20])
def test_cap_is_exact_for_tied_keys_and_copies(spark, cap):
    """Two keys of ten rows each, some of them equal in every column."""
    df = spark.createDataFrame([(k, "a", "same" if i < 7 else str(i)) for k in (1, 2) for i in range(10)],
                               "k long, cls string, rest string").repartition(3)
    out = sampling.class_cap(df, "cls", ["k"], cap, 1, ["a"])
    assert out.count() == cap and out.columns == df.columns
    assert out.exceptAll(df).isEmpty()


def test_cap_keeps_unlabelled_rows(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else None) for i in range(10)], "id long, cls string")
    out = sampling.class_cap(df, "cls", ["id"], 2, 1, ["a"])
    assert out.filter("cls IS NULL").count() == 4 and out.filter("cls = 'a'").count() == 2


def test_split_repeats_whatever_the_partitioning(skewed):
    one = sampling.stratified_split(skewed, "cls", ["id"], 0.25, 42, ["big", "rare"])
    two = sampling.stratified_split(skewed.repartition(3), "cls", ["id"], 0.25, 42, ["big", "rare"])
    assert one.select("id", "is_test").exceptAll(two.select("id", "is_test")).isEmpty()


def test_distinct_keeps_first_and_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(3, "x", None, "c"), (1, "x", None, "a"), (2, "y", 1.0, "b"), (4, "x", 2.0, "d")],
                               "o int, k string, v double, who string")
    out = {(r.k, r.v): r.who for r in rows.distinct_flows(df, ["k", "v"], ["o"]).collect()}
    assert out == {("x", None): "a", ("y", 1.0): "b", ("x", 2.0): "d"}


def test_sequence_is_gapless_across_blocks(spark):
    df = spark.range(0, 50).select((F.col("id") * 900_000 + F.col("id") % 7).alias("k"))
    out = rows.with_sequence(df, "k").orderBy("k").collect()
    assert [r["seq"] for r in out] == list(range(1, 51))


def test_hot_copies_collapse_before_the_shuffle(spark, skewed):
    plan = rows.distinct_flows(skewed.select("x", "cls", "id"), ["x", "cls"], ["id"])._jdf.queryExecution().toString()
    assert "partial_min" in plan


def test_lookup_tables_of_unknown_size_are_broadcast(spark):
    """A join by feature name has as many keys as features; unbroadcast, each key is one task."""
    from tidewatch.operators.evidence import lookup
    big = spark.range(1000).selectExpr("id", "concat('f', id % 4) AS feature")
    table = spark.createDataFrame([(f"f{i}", float(i)) for i in range(3)], "feature string, importance double")
    joined = lookup(big, table, ["feature"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert joined.count() == 1000 and joined.filter("importance IS NULL").count() == 250


def test_brackets_are_counted_in_one_pass(spark):
    """What is below each bracket, up to its end and inside it, NaN being above all numbers and NULL nowhere."""
    from tidewatch.operators.quantiles import _counted

    values = [3.0, 1.0, 2.0, 2.0, None, float("nan"), 9.0, float("nan"), -1.0]
    base = spark.createDataFrame([(g, v) for g in "ab" for v in values + [5.0] * (g == "b")], "g string, x0 double").repartition(3)
    brackets = {("a", 0, 0.5): (2.0, 3.0), ("b", 0, 0.5): (2.0, 5.0), ("a", 0, 1.0): (9.0, float("nan")), ("b", 0, 1.0): (9.0, 9.0)}
    got = {(r.g, r.j, r.side, str(r.v)): r.n for r in _counted(base, brackets, [(0, 0.5), (0, 1.0)]).collect()}
    assert got == {("a", 0, 0, "None"): 2, ("a", 0, 1, "None"): 5, ("a", 0, 2, "2.0"): 2, ("a", 0, 2, "3.0"): 1,
                   ("b", 0, 0, "None"): 2, ("b", 0, 1, "None"): 6, ("b", 0, 2, "2.0"): 2, ("b", 0, 2, "3.0"): 1, ("b", 0, 2, "5.0"): 1,
                   ("a", 1, 0, "None"): 5, ("a", 1, 1, "None"): 8, ("a", 1, 2, "9.0"): 1, ("a", 1, 2, "nan"): 2,
                   ("b", 1, 0, "None"): 6, ("b", 1, 1, "None"): 7}


def test_queue_is_decided_on_finished_columns(spark):
    """Before, the filter went below the scoring chain with copies of all it rests on."""
    bounds = {f: Bound(0.0, 5.0, 2.0) for f in "abc"}
    rows = spark.range(40).selectExpr("id", "id % 7 * 1.0 AS a", "id % 9 * 1.0 AS b", "id % 11 * 1.0 AS c",
                                      "'DDoS' AS model_prediction", "id % 10 / 10.0D AS confidence")
    marked = verdict.assess(rows, DistributionReference(features=tuple("abc"), quantile=0.1, min_violations=2, bounds=bounds, n_training_rows=9))
    plan = alert_ops.queued(marked)._jdf.queryExecution().optimizedPlan().toString()
    assert all("CASE" not in line for line in plan.split("\n") if "Filter" in line)
    expected = [r["id"] for r in marked.collect() if r["is_alertable"] or r["needs_review"]]
    assert [r["id"] for r in alert_ops.queued(marked).orderBy("id").collect()] == expected and expected


def test_alert_text_is_parsed_once(spark):
    """Before, each line was parsed for the filter and again for the fields."""
    lines = spark.createDataFrame([('{"flow_id": "a"}',), (' \t{"flow_id": "b"} ',), ('{"flow_id": 3}',), ("[1]",), ('"x"',), ("",),
                                   ('{"flow_id":',), ("null",), (None,), ("{}",)], "value string")
    out = alert_ops.parse_alerts(lines).select("flow_id", "severity")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert sorted(str(r["flow_id"]) for r in out.collect()) == ["None", "None", "a", "b"]


@pytest.mark.parametrize("value,text", [(0.0, "0"), (9.9985, "9.998"), (9.9996, "10"), (9999.4, "9,999"), (9999.6, "1e+04"),
                                        (0.00012345, "0.0001234"), (0.000012345, "1.234e-05"), (-12.5, "-12.5"), (123456.0, "1.235e+05")])
def test_significant_digits(spark, value, text):
    one = spark.createDataFrame([(value,)], "v double").select(significant(F.col("v")).alias("t"))
    assert one.first()["t"] == text


def test_display_numbers_use_fixed_patterns(spark):
    """Before, a format that changed from row to row was read anew, then trimmed by a regex."""
    shown = spark.createDataFrame([(1234.5,), (12.5,), (0.125,), (-0.0001,), (7.0,)], "v double").select(format_value(F.col("v")).alias("t"))
    assert [r["t"] for r in shown.collect()] == ["1,234", "12.5", "0.125", "-0", "7"]
    assert "regexp" not in shown._jdf.queryExecution().analyzed().toString()
