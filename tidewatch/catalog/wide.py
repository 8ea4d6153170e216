"""A scoring run at the width of the published contract.

The given tables hold no packets, so ``lineitem`` columns play the eighteen features
under their published names. Everything after that is the run a user makes: the
profile is chosen from the columns, the distribution reference fitted, every flow
judged, explained and queued.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.standin import CARRY, FLOW_COLUMNS, QUANTILE, assessed_sql, bounds_sql, fitted, lineitem, split_sql
from tidewatch.cic import CIC_EVIDENCE, CIC_SPEC
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import inspect, verdict
from tidewatch.operators.rows import numbered
from tidewatch.plans import score
from tidewatch.session import drop_scratch, materialize, per_table, scratch_mark, scratch_path, spread

# What plays each feature; both engines read these.
PLAYED = {
    "Flow Duration": "CAST(l_extendedprice * 10 AS DOUBLE)",
    "Total Fwd Packets": "CAST(l_quantity AS DOUBLE)",
    "Total Length of Fwd Packets": "CAST(l_quantity * l_linenumber AS DOUBLE)",
    "Fwd Packet Length Max": "CAST(l_partkey % 1500 AS DOUBLE)",
    "Fwd Packet Length Min": "CAST(l_partkey % 40 AS DOUBLE)",
    "Fwd Packet Length Mean": "CAST(l_partkey % 700 AS DOUBLE)",
    "Fwd Packet Length Std": "CAST(l_partkey % 90 AS DOUBLE)",
    "Fwd Packets/s": "CAST(l_extendedprice AS DOUBLE) / (l_linenumber + 1)",
    "Fwd IAT Mean": "CAST(l_suppkey * 7 AS DOUBLE)",
    "Fwd IAT Std": "CAST(l_suppkey % 50 AS DOUBLE)",
    "Fwd IAT Max": "CAST(l_suppkey * 11 AS DOUBLE)",
    "Fwd IAT Min": "CAST(l_suppkey % 7 AS DOUBLE)",
    "Fwd Header Length": "CAST(20 * l_linenumber AS DOUBLE)",
    "Fwd PSH Flags": "CAST(l_orderkey % 2 AS DOUBLE)",
    "act_data_pkt_fwd": "CAST(l_discount * 100 AS DOUBLE)",
    "min_seg_size_forward": "CAST(20 + l_tax * 100 AS DOUBLE)",
    "Init_Win_bytes_forward": "CAST(l_orderkey % 65536 AS DOUBLE)",
    "Destination Port": "CAST(l_partkey % 1024 AS DOUBLE)",
}
REST = FLOW_COLUMNS[4:]  # truth, prediction and confidence of the stand-in
SHORT = tuple(f"f{i}" for i in range(len(PLAYED)))
_SQL = f"""WITH flows AS (SELECT {', '.join(CARRY)}, {', '.join(f'{x} AS {s}' for s, x in zip(SHORT, PLAYED.values()))},
    {', '.join(REST)} FROM lineitem), {split_sql(CARRY)}, {bounds_sql(SHORT)}, {assessed_sql(SHORT)},
  s AS (SELECT *, row_number() OVER (ORDER BY {', '.join((*CARRY, *SHORT, 'truth'))}) AS seq FROM a)"""


def wide_flows(spark, sf_dir):
    features = [F.expr(x).alias(name) for name, x in PLAYED.items()]
    return spread(lineitem(spark, sf_dir)).select(*CARRY, *features, *[F.expr(x) for x in REST])


@per_table("lineitem")
def wide_reference(spark, sf_dir):
    flows = wide_flows(spark, sf_dir)
    profile = inspect.choose_profile(flows.columns, CIC_SPEC)
    return fitted(flows, CIC_SPEC, tuple(CIC_SPEC.features(profile)), CARRY, QUANTILE)


@query("score_wide", f"""{_SQL} SELECT {', '.join(CARRY)}, n_violations, reliability, reported_threat, severity, escalated,
    is_alertable, needs_review, round(ood_score, 6) AS ood_score FROM s""")
def _(spark, sf_dir):
    rows = verdict.assess(wide_flows(spark, sf_dir), wide_reference(spark, sf_dir))
    return rows.select(*CARRY, F.col("n_violations").cast("int").alias("n_violations"), "reliability", "reported_threat", "severity",
                       "escalated", "is_alertable", "needs_review", F.round("ood_score", 6).alias("ood_score"))


@query("sink_wide_queue", f"""{_SQL} SELECT printf('S%06d', seq) AS flow_id, reported_threat AS threat_class, severity,
    CAST(n_violations AS INTEGER) AS n_ood, TRUE AS explained, 'STRICT_UNIDIRECTIONAL' AS profile
  FROM s WHERE is_alertable OR needs_review""")
def _(spark, sf_dir):
    """Decided on counters first; violations, reasons and evidence are worded for queued rows only."""
    reference, path = wide_reference(spark, sf_dir), scratch_path(spark, "wide-queue")
    mark = scratch_mark()
    flows = numbered(wide_flows(spark, sf_dir), (*CARRY, *PLAYED, "truth"))
    profile = inspect.choose_profile(flows.columns, CIC_SPEC)
    decided = alert_ops.queued(verdict.assess(flows, reference)).select(*flows.columns)
    queued = materialize(decided, "wide-queued")
    drop_scratch(spark, mark, keep=queued)  # the numbered rows
    rows = verdict.assess(queued, reference, detail=True)
    alerts = score.alerts(rows, CIC_EVIDENCE, profile, "BATCH_SCORING", seq="seq", prefix="S", truth="truth")
    score.write_alert_queue(alerts, path)
    back = alert_ops.parse_alerts(spark.read.text(path))
    return back.select("flow_id", "threat_class", "severity", F.size("ood_features").alias("n_ood"),
                       (F.size("evidence_detail") > 0).alias("explained"), "profile")
