"""Streaming: arriving flows to alerts, queues and running counters.

The transforms are those of the batch plans; only source and sink differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import monitor
from tidewatch.session import remove

STATUS_BATCHES = 100


def start_alert_stream(alert_rows: DataFrame, output: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append alerts as compressed JSON lines. The file sink's log makes output exactly-once;
    starting over means a new output and checkpoint folder."""
    writer = (alert_ops.alert_json(alert_rows).writeStream.format("text").outputMode("append")
              .option("path", output).option("compression", alert_ops.COMPRESSION).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_queue_stream(alert_rows: DataFrame, output: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Route each batch to ``alerts`` and ``review`` folders.

    The batch id names the folder that is written, so a replayed batch replaces
    its own output and nothing doubles.
    """
    def route(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, rows in (("alerts", kept.filter("is_alertable")), ("review", monitor.review_only(kept))):
                alert_ops.alert_json(rows).write.mode("overwrite").text(
                    f"{output}/{name}/batch={batch_id}", compression=alert_ops.COMPRESSION)
        finally:
            kept.unpersist()

    writer = alert_rows.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_status_stream(alert_rows: DataFrame, output: str, checkpoint: str, *, once: bool = True,
                        keep: int = STATUS_BATCHES) -> StreamingQuery:
    """Running counters, held in the state store: each batch writes the totals so far.

    A batch costs its own rows and one small row per class and severity, however long
    the stream has run. A replayed batch starts from the state before it and writes the
    same totals to the same folder; a restart goes on from the checkpoint. Only the
    last ``keep`` batches' totals stay.
    """
    def write(totals: DataFrame, batch_id: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        remove(totals.sparkSession, f"{output}/batch={batch_id - keep}")

    writer = (monitor.live_counters(alert_rows).writeStream.outputMode("complete").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_counters(spark: SparkSession, output: str) -> DataFrame:
    """Totals per class and severity so far: what the newest batch wrote."""
    rows = spark.read.parquet(output)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == newest).drop("batch")


def run_status(spark: SparkSession, output: str) -> DataFrame:
    """Status as of each kept batch: the progress a monitor shows."""
    total = spark.read.parquet(output).groupBy("batch").agg(*[
        F.sum(c).alias(c) for c in ("flows", "labelled", "correct_flows", "alertable")])
    return total.withColumn("live_accuracy", F.bround(
        F.try_divide(F.col("correct_flows").cast("double"), F.col("labelled").cast("double")), 4))


def each_alert_once(lines: DataFrame, within: str | None = "1 day") -> DataFrame:
    """Alert rows of a stream of JSON lines, each flow once however often its line comes.

    Cut-off lines are skipped; the whole line counts when it comes. Flow ids seen are
    kept in the state store for as long as ``within`` behind the newest timestamp;
    lines older than that are dropped. None keeps every id for good and drops nothing.
    """
    rows = alert_ops.parse_alerts(lines).filter(F.col("flow_id").isNotNull())
    if within is None:
        return rows.dropDuplicates(["flow_id"])
    at = F.coalesce(F.try_to_timestamp("timestamp"), F.current_timestamp()).alias("_at")
    return rows.select("*", at).withWatermark("_at", within).dropDuplicatesWithinWatermark(["flow_id"]).drop("_at")


def start_counter_stream(alert_rows: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The counters as one stateful aggregate in complete mode, held in a table."""
    return (monitor.live_counters(alert_rows).writeStream.outputMode("complete").format("memory")
            .queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def drain(start: Callable[[], StreamingQuery]) -> None:
    """Run an available-now query to its end, raising what it raised."""
    start().awaitTermination()
