"""Monitoring queries over orders as an alert table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.standin import ORDER_SQL, order_alerts
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import monitor
from tidewatch.session import scratch_path, spread

COLUMNS = ("flow_id", "threat_class", "model_prediction", "confidence", "reliability", "severity", "is_alertable",
           "needs_review", "ground_truth", "correct")
LIST = ", ".join(COLUMNS)
ALL = f"{ORDER_SQL} SELECT {LIST} FROM alerts"


def _alerts(spark, sf_dir):
    return order_alerts(spark, sf_dir).select("seq", *COLUMNS)


@query("filter_queue", f"""{ALL} WHERE (is_alertable OR needs_review) AND confidence >= 0.25
  AND severity IN ('MEDIUM', 'HIGH', 'CRITICAL') AND reliability IN ('RELIABLE', 'UNRELIABLE')
  AND threat_class IN ('DDoS', 'Botnet', 'UNKNOWN_OOD')""")
def _(spark, sf_dir):
    return monitor.queue(_alerts(spark, sf_dir), "Both", classes=["DDoS", "Botnet", "UNKNOWN_OOD"],
                         severities=["MEDIUM", "HIGH", "CRITICAL"], tiers=["RELIABLE", "UNRELIABLE"],
                         min_confidence=0.25).select(*COLUMNS)


@query("filter_queue_alerts", f"{ALL} WHERE is_alertable")
def _(spark, sf_dir):
    return monitor.queue(_alerts(spark, sf_dir), "Alerts").select(*COLUMNS)


@query("filter_review_only", f"{ALL} WHERE needs_review AND NOT is_alertable")
def _(spark, sf_dir):
    return monitor.review_only(_alerts(spark, sf_dir)).select(*COLUMNS)


@query("agg_dashboard_tiles", f"""{ORDER_SQL} SELECT count(*) AS flows, count(*) FILTER (is_alertable) AS alerts,
    count(*) FILTER (needs_review AND NOT is_alertable) AS review,
    count(*) FILTER (reliability = 'UNRELIABLE') AS out_of_distribution,
    round(count(*) FILTER (reliability = 'UNRELIABLE') / count(*), 8) AS ood_share FROM alerts""")
def _(spark, sf_dir):
    return monitor.tiles(_alerts(spark, sf_dir)).withColumn("ood_share", F.round("ood_share", 8))


@query("agg_class_chart", f"""{ORDER_SQL}, c AS (SELECT threat_class, count(*) AS n FROM alerts GROUP BY 1)
  SELECT threat_class, n, CAST(row_number() OVER (ORDER BY CASE threat_class WHEN 'BENIGN' THEN 0 WHEN 'DDoS' THEN 1
    WHEN 'PortScan' THEN 2 WHEN 'Botnet' THEN 3 WHEN 'UNKNOWN' THEN 4 ELSE 5 END, n DESC, threat_class) AS INTEGER)
    AS position FROM c""")
def _(spark, sf_dir):
    return monitor.class_chart(_alerts(spark, sf_dir))


@query("agg_model_missing", f"{ORDER_SQL} SELECT count(*) FILTER (threat_class = 'UNKNOWN') AS unknown_rows FROM alerts")
def _(spark, sf_dir):
    return monitor.model_missing(_alerts(spark, sf_dir))


@query("agg_live_counters", f"""{ORDER_SQL} SELECT threat_class, severity, count(*) AS flows, count(correct) AS labelled,
    count(*) FILTER (correct) AS correct_flows, count(*) FILTER (is_alertable) AS alertable FROM alerts GROUP BY 1, 2""")
def _(spark, sf_dir):
    return monitor.live_counters(_alerts(spark, sf_dir))


@query("topk_alert_table", f"""{ORDER_SQL}, ranked AS (SELECT flow_id, severity, threat_class, confidence,
    CAST(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) - 1 AS INTEGER) AS rank,
    count(*) OVER () AS total FROM alerts WHERE is_alertable OR needs_review)
  SELECT * FROM ranked ORDER BY rank DESC, flow_id DESC LIMIT 300""")
def _(spark, sf_dir):
    top = monitor.alert_table(monitor.queue(_alerts(spark, sf_dir), "Both"), 300)
    return top.select("flow_id", "severity", "threat_class", "confidence", "rank", "total")


@query("topk_tail", f"{ORDER_SQL} SELECT seq, {LIST} FROM alerts ORDER BY seq DESC LIMIT 5000")
def _(spark, sf_dir):
    return monitor.tail(_alerts(spark, sf_dir), 5_000)


@query("latest_ood_event", f"""{ORDER_SQL} SELECT seq, {LIST}, CAST(n_violations AS INTEGER) AS n_violations,
    round(ood_score, 6) AS ood_score FROM alerts WHERE reliability = 'UNRELIABLE' ORDER BY seq DESC LIMIT 1""")
def _(spark, sf_dir):
    rows = order_alerts(spark, sf_dir).select("seq", *COLUMNS, "n_violations", "ood_score")
    return monitor.latest_ood(rows).withColumn("ood_score", F.round("ood_score", 6))


@query("sort_timeline", f"{ORDER_SQL} SELECT seq AS sequence, threat_class, confidence FROM alerts ORDER BY seq")
def _(spark, sf_dir):
    return monitor.timeline(_alerts(spark, sf_dir))


@query("proj_fill_alert_defaults", f"""{ORDER_SQL} SELECT flow_id, CASE WHEN confidence < 0.1 THEN 'UNKNOWN'
    ELSE threat_class END AS threat_class, severity, confidence, is_alertable, 'UNKNOWN' AS protocol, FALSE AS needs_review,
    'UNKNOWN' AS reliability, CAST(NULL AS BOOLEAN) AS in_distribution, CAST(0 AS DOUBLE) AS ood_score FROM alerts""")
def _(spark, sf_dir):
    old = order_alerts(spark, sf_dir).select(
        "flow_id", F.when(F.col("confidence") >= 0.1, F.col("threat_class")).alias("threat_class"), "severity",
        "confidence", "is_alertable")
    return monitor.fill_defaults(old).select(
        "flow_id", "threat_class", "severity", "confidence", "is_alertable", "protocol", "needs_review", "reliability",
        "in_distribution", "ood_score")


# --- alert records as JSON lines, sound and damaged --------------------------------------
_RECORD = """concat('{{"timestamp":"t","flow_id":"F', event_id, '","src_ip":"a","dst_ip":"b","src_port":1,"dst_port":2,',
  '"protocol":"TCP","severity":"HIGH","is_alertable":true,"model_ready":true,"model_prediction":"DDoS",',
  CASE WHEN event_type = 'purchase' THEN '' ELSE '"needs_review":false,' END,
  CASE WHEN event_type = 'signup' THEN '"schema_version":1,' ELSE '"schema_version":2,' END,
  CASE WHEN event_type = 'error' THEN '"threat_class":"UNKNOWN_OOD",' ELSE '"threat_class":"DDoS",' END,
  CASE WHEN event_type = 'error' AND user_id < 20 THEN '"reliability":"UNRELIABLE",'
    WHEN user_id < 3 THEN '"reliability":"UNRELIABLE",' WHEN user_id < 6 THEN '"reliability":"odd",'
    ELSE '"reliability":"RELIABLE",' END,
  CASE WHEN user_id < 30 THEN '"in_distribution":0,' WHEN user_id < 50 THEN '"in_distribution":null,'
    ELSE '"in_distribution":true,' END,
  CASE WHEN user_id < 40 AND user_id > 35 THEN '"evidence":[],"ood_features":{{}},'
    ELSE '"evidence":{{}},"ood_features":[],' END,
  '"confidence":', CAST(CASE WHEN value > 30 THEN 5.0 ELSE 0.5 END AS DOUBLE), ',"model_confidence":0.5,"ood_score":0.25}}')"""
_RECORD = _RECORD.replace("{{", "{").replace("}}", "}")
_CODES = """concat_ws(',', CASE WHEN event_type = 'purchase' THEN 'missing:needs_review' END,
  CASE WHEN value > 30 THEN 'range:confidence' END,
  CASE WHEN user_id < 40 AND user_id > 35 THEN 'type:evidence,type:ood_features' END,
  CASE WHEN user_id < 30 THEN 'type:in_distribution' END,
  CASE WHEN NOT (event_type = 'error' AND user_id < 20) AND user_id >= 3 AND user_id < 6 THEN 'domain:reliability' END,
  CASE WHEN event_type <> 'error' AND user_id < 3 THEN 'mismatch:threat_class' END,
  CASE WHEN event_type = 'error' AND user_id >= 20 THEN 'mismatch:reliability' END,
  CASE WHEN event_type = 'signup' THEN 'version' END)"""


@query("op_validate_alert", f"SELECT event_id, {_CODES} AS problems FROM events")
def _(spark, sf_dir):
    lines = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", F.expr(_RECORD).alias("value"))
    return lines.select("event_id", F.concat_ws(",", alert_ops.alert_problems(F.col("value"))).alias("problems"))


_LINE = f"""CASE WHEN event_type = 'view' AND user_id < 30 THEN '   ' WHEN event_type = 'view' AND user_id < 60 THEN '[1]'
  WHEN event_type = 'click' AND user_id < 30 THEN '{{not json}}' WHEN event_type = 'click' AND user_id < 60
  THEN substring({_RECORD}, 1, 120) ELSE {_RECORD} END"""


@query("scan_alert_jsonl", """SELECT 'F' || event_id AS flow_id,
    CASE WHEN event_type = 'error' THEN 'UNKNOWN_OOD' ELSE 'DDoS' END AS threat_class,
    CAST(CASE WHEN value > 30 THEN 5.0 ELSE 0.5 END AS DOUBLE) AS confidence, 1 AS src_port,
    CASE WHEN user_id >= 50 THEN TRUE END AS in_distribution,
    CASE WHEN user_id >= 40 OR user_id <= 35 THEN 0 END AS evidence_entries,
    CASE WHEN user_id >= 40 OR user_id <= 35 THEN 0 END AS ood_entries FROM events
  WHERE NOT (event_type IN ('view', 'click') AND user_id < 60)""")
def _(spark, sf_dir):
    path = scratch_path(spark, "alert-lines")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.select(F.expr(_LINE).alias("value")).write.text(path)
    return alert_ops.parse_alerts(spark.read.text(path)).select(
        "flow_id", "threat_class", "confidence", "src_port", "in_distribution",
        F.when(F.col("evidence").isNotNull(), F.size("evidence")).alias("evidence_entries"),
        F.when(F.col("ood_features").isNotNull(), F.size("ood_features")).alias("ood_entries"))
