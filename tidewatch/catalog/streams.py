"""Streaming queries: orders arriving as flows, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.learning import order_model
from tidewatch.catalog.standin import (ORDER_COLUMNS, ORDER_FEATURES, ORDER_IMPORTANCES, ORDER_SQL, ORDERS_SQL, order_evidence,
                                       order_reference)
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import verdict
from tidewatch.plans import score
from tidewatch.session import remove, scratch_path
from tidewatch.sources.streams import stream_parquet
from tidewatch.streaming import score as streaming

COUNTERS = ("threat_class", "severity", "flows", "labelled", "correct_flows", "alertable")
_COUNTS_SQL = f"""{ORDER_SQL} SELECT threat_class, severity, count(*) AS flows, count(correct) AS labelled,
  count(*) FILTER (correct) AS correct_flows, count(*) FILTER (is_alertable) AS alertable FROM alerts GROUP BY 1, 2"""


def _flow_stream(spark, sf_dir):
    return stream_parquet(spark, f"{sf_dir}/orders.parquet").selectExpr(*ORDER_COLUMNS)


def order_alert_rows(spark, sf_dir, flows, mode="STREAM", model=None):
    """Whole alert records of order flows, streaming or not: verdict, evidence, UNKNOWN rows.

    With a ``model`` its predictions and reference are used, else the stand-in's.
    """
    if model is None:
        def assess(rows):
            return verdict.assess(rows, order_reference(spark, sf_dir), detail=True)
    else:
        flows = flows.drop("model_prediction", "confidence")

        def assess(rows):
            return score.assessed(score.predictions(rows, model), model, detail=True)
    return score.every_alert(flows, ORDER_FEATURES, assess, order_evidence(spark, sf_dir), "ORDERS", mode, seq="seq",
                             prefix="F", truth="truth", importances=ORDER_IMPORTANCES)


def _alert_stream(spark, sf_dir):
    return order_alert_rows(spark, sf_dir, _flow_stream(spark, sf_dir))


@query("scan_flow_stream", "SELECT count(*) AS flows FROM orders")
def _(spark, sf_dir):
    out, state = scratch_path(spark, "stream-scan"), scratch_path(spark, "state")
    stream = _flow_stream(spark, sf_dir).select("seq", "total")
    streaming.drain(lambda: stream.writeStream.format("parquet").option("path", out)
                    .option("checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.parquet(out).agg(F.count_distinct("seq").alias("flows"))


def _scored(spark, sf_dir):
    out, state = scratch_path(spark, "stream-alerts"), scratch_path(spark, "state")
    streaming.drain(lambda: streaming.start_alert_stream(_alert_stream(spark, sf_dir), out, state))
    return alert_ops.parse_alerts(spark.read.text(out))


_FIELDS = ("flow_id", "threat_class", "model_prediction", "severity", "reliability", "is_alertable", "needs_review",
           "ground_truth", "correct")
_SCORED_SQL = f"{ORDER_SQL} SELECT {', '.join(_FIELDS)} FROM alerts"


@query("stream_score", _SCORED_SQL)
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select(*_FIELDS)


@query("stream_model_score", f"WITH {ORDERS_SQL} SELECT printf('F%06d', seq) AS flow_id, truth AS ground_truth, TRUE AS scored FROM flows")
def _(spark, sf_dir):
    """Orders scored by a fitted forest as they arrive."""
    out, state = scratch_path(spark, "stream-model"), scratch_path(spark, "state")
    rows = order_alert_rows(spark, sf_dir, _flow_stream(spark, sf_dir), model=order_model(spark, sf_dir))
    streaming.drain(lambda: streaming.start_alert_stream(rows, out, state))
    scored = F.col("model_prediction").isin("BENIGN", "DDoS", "PortScan", "Botnet") & F.col("confidence").between(0, 1)
    return alert_ops.parse_alerts(spark.read.text(out)).select("flow_id", "ground_truth", scored.alias("scored"))


@query("sink_alert_stream", f"{ORDER_SQL} SELECT severity, count(*) AS n FROM alerts GROUP BY 1")
def _(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query("stream_dedupe_guard", f"""{ORDER_SQL} SELECT threat_class, count(*) AS lines, count(DISTINCT flow_id) AS flows,
    count(*) FILTER (is_alertable) AS alertable FROM alerts GROUP BY 1""")
def _(spark, sf_dir):
    """A log in which every third line comes again and every fifth was first read half written."""
    whole, log = scratch_path(spark, "stream-alerts"), scratch_path(spark, "stream-log")
    out, state = scratch_path(spark, "stream-once"), (scratch_path(spark, "state"), scratch_path(spark, "state"))
    streaming.drain(lambda: streaming.start_alert_stream(_alert_stream(spark, sf_dir), whole, state[0]))
    lines = spark.read.text(whole)
    hashed = F.pmod(F.xxhash64("value"), F.lit(15))
    torn = lines.filter(hashed % 5 == 0).select(F.substring("value", 1, 80).alias("value"))
    torn.unionByName(lines).unionByName(lines.filter(hashed % 3 == 0)).write.text(log, compression=alert_ops.COMPRESSION)
    remove(spark, whole)  # all of it is in the log
    files = max(4, spark.sparkContext.defaultParallelism)  # a compressed file is one task: one for each core
    stream = streaming.each_alert_once(spark.readStream.option("maxFilesPerTrigger", files).text(log)).select("threat_class", "flow_id", "is_alertable")
    streaming.drain(lambda: stream.writeStream.format("parquet").option("path", out)
                    .option("checkpointLocation", state[1]).trigger(availableNow=True).start())
    return spark.read.parquet(out).groupBy("threat_class").agg(
        F.count("*").alias("lines"), F.count_distinct("flow_id").alias("flows"), F.count_if("is_alertable").alias("alertable"))


@query("stream_alert_queues", f"""{ORDER_SQL} SELECT flow_id, CASE WHEN is_alertable THEN 'alerts' ELSE 'review' END AS queue
  FROM alerts WHERE is_alertable OR needs_review""")
def _(spark, sf_dir):
    out, state = scratch_path(spark, "stream-queues"), scratch_path(spark, "state")
    streaming.drain(lambda: streaming.start_queue_stream(_alert_stream(spark, sf_dir), out, state))
    tables = [alert_ops.parse_alerts(spark.read.text(f"{out}/{name}").drop("batch")).select(
        "flow_id", F.lit(name).alias("queue")) for name in ("alerts", "review")]
    return tables[0].unionByName(tables[1])


def _status_folder(spark, sf_dir):
    out, state = scratch_path(spark, "stream-status"), scratch_path(spark, "state")
    streaming.drain(lambda: streaming.start_status_stream(_alert_stream(spark, sf_dir), out, state))
    return out


@query("stream_counters", _COUNTS_SQL)
def _(spark, sf_dir):
    return streaming.run_counters(spark, _status_folder(spark, sf_dir)).select(*COUNTERS)


@query("stream_counters_stateful", _COUNTS_SQL)
def _(spark, sf_dir):
    name = scratch_path(spark, "counters").rsplit("/", 1)[1].replace("-", "_")
    stream = _alert_stream(spark, sf_dir)
    streaming.drain(lambda: streaming.start_counter_stream(stream, name, scratch_path(spark, "state")))
    return spark.table(name).select(*COUNTERS)


@query("sink_stream_status", f"""{ORDER_SQL} SELECT count(*) AS flows, count(correct) AS labelled,
    count(*) FILTER (correct) AS correct_flows, count(*) FILTER (is_alertable) AS alertable,
    round_even(count(*) FILTER (correct) / count(correct), 4) AS live_accuracy FROM alerts""")
def _(spark, sf_dir):
    """The status after the last batch; how many batches there were depends on the files."""
    status = streaming.run_status(spark, _status_folder(spark, sf_dir))
    return status.orderBy(F.col("batch").desc()).limit(1).drop("batch")
