"""Cleaning reads raw rows once and still accounts for each of them."""

from tidewatch.catalog.standin import CARRY, LINE_SPEC, raw
from tidewatch.operators import quality
from tidewatch.plans import clean as cleaning
from tidewatch.spec import TrainingPolicy


def test_raw_rows_are_read_once(spark, small):
    read = spark.sparkContext.accumulator(0)
    rows = raw(spark, small)
    n = rows.count()

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = cleaning.clean(rows.mapInArrow(counted, rows.schema), LINE_SPEC, TrainingPolicy(class_cap=100), CARRY)
    steps = {(r.step, r.detail): r.rows for r in got.audit.collect()}
    flows = {r["threat_class"]: r["count"] for r in got.flows.groupBy("threat_class").count().collect()}
    assert read.value == n == steps["rows_in", ""]
    assert {d: v for (s, d), v in steps.items() if s == "written"} == flows
    assert steps["distinct_rows", ""] >= sum(flows.values()) + steps["unusable_rows", ""]
    assert sum(v for (s, _), v in steps.items() if s == "dropped_label") == steps["unmapped_labels", ""] > 0
    texts = quality.nulls_for_na(rows, [c for c in LINE_SPEC.retained if c in rows.columns])
    assert quality.quality_counters(texts, LINE_SPEC).first().asDict() == {s: v for (s, d), v in steps.items() if s in (
        "rows_in", "empty_rows", "missing_label", "non_numeric_cells", "infinite_cells", "unmapped_labels", "rows_kept")}


def test_empty_and_unlabelled_tables(spark, small):
    rows = raw(spark, small)
    empty = cleaning.clean(rows.limit(0), LINE_SPEC, carry=CARRY)
    assert empty.flows.count() == 0 and {r.rows for r in empty.audit.collect()} == {0}
    bare = cleaning.clean(rows.drop("label"), LINE_SPEC, carry=CARRY)
    assert "threat_class" not in bare.flows.columns and bare.flows.count() > 0
    assert not any(r.step in ("written", "dropped_label") for r in bare.audit.collect())
