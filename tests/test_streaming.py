"""The stream gives what the batch gives, evidence, model and refused rows included."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog.learning import order_model
from tidewatch.catalog.standin import order_flows
from tidewatch.catalog.streams import order_alert_rows
from tidewatch.operators import alerts
from tidewatch.plans import score
from tidewatch.sources.streams import stream_parquet
from tidewatch.streaming import score as streaming


@pytest.mark.parametrize("fitted", [False, True])
def test_stream_equals_batch_over_all_fields(spark, small, tmp_path, fitted):
    model = order_model(spark, small) if fitted else None
    flows = order_flows(spark, small).withColumns({
        "total": F.when(F.col("seq") % 50 != 1, F.col("total")), "cust": F.when(F.col("seq") % 75 != 1, F.col("cust"))})
    flows.repartition(3).write.parquet(str(tmp_path / "flows"))
    stored = spark.read.parquet(str(tmp_path / "flows"))
    stream = order_alert_rows(spark, small, stream_parquet(spark, str(tmp_path / "flows"), 1), model=model)
    streaming.drain(lambda: streaming.start_alert_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    batch = alerts.alert_json(order_alert_rows(spark, small, stored, model=model))

    def rows(lines):
        return {r["flow_id"]: {k: v for k, v in r.items() if k != "timestamp"} for r in map(json.loads, lines)}

    got = rows(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    want = rows(r[0] for r in batch.collect())
    assert got == want and len(got) == stored.count()
    unknown = [r for r in got.values() if r["threat_class"] == "UNKNOWN"]
    lacking = stored.filter("total IS NULL OR cust IS NULL").count()
    assert len(unknown) == lacking > 0
    assert all(r["needs_review"] and r["severity"] == "INFO" and not r["is_alertable"] and not r["contract_satisfied"]
               and 1 <= len(r["evidence"]) <= 2 for r in unknown)
    assert all(r["evidence"] and r["evidence_method"] for r in got.values() if r["threat_class"] != "UNKNOWN")


def test_a_wrong_field_costs_no_record(spark):
    lines = ['{"flow_id":"a","in_distribution":0,"confidence":0.5}', '{"flow_id":"b","evidence":[]}', '{"flow_id":"c","src_port":80.0}',
             '{"flow_id":"d","evidence":{"x":"text","y":1}}', '{"flow_id":5}', '[1]', '{"cut', '  ', 'null', '{}']
    got = alerts.parse_alerts(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["flow_id"] for r in got] == ["a", "b", "c", "d", None, None]
    assert got[0]["in_distribution"] is None and got[0]["confidence"] == 0.5
    assert got[1]["evidence"] is None and got[2]["src_port"] == 80


ALERT = '{{"flow_id":"{0}","timestamp":"2024-05-0{1}T10:00:00Z","threat_class":"DDoS","severity":"HIGH","correct":true,"is_alertable":true}}'


@pytest.mark.parametrize("within", ["1 day", None])
def test_replayed_and_torn_lines_count_once(spark, tmp_path, within):
    first = [ALERT.format(i, 1) for i in range(20)]
    second = [ALERT.format(i, 1) for i in range(10, 30)] + [first[3][:50], "", first[3]]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("\n".join(first + [second[0][:40]]))

    def run():
        stream = streaming.each_alert_once(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "log")), within)
        streaming.drain(lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        return sorted(int(r["flow_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(20))
    (tmp_path / "log" / "b.txt").write_text("\n".join(second))
    assert run() == list(range(30))  # what was seen before the restart is remembered


def test_totals_survive_a_restart(spark, tmp_path):
    (tmp_path / "log").mkdir()

    def run():
        rows = alerts.parse_alerts(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "log")))
        streaming.drain(lambda: streaming.start_status_stream(rows, str(tmp_path / "out"), str(tmp_path / "state"), keep=2))
        return [tuple(r) for r in streaming.run_counters(spark, str(tmp_path / "out")).select("threat_class", "flows", "correct_flows").collect()]

    for n, name in enumerate("abcd", 1):
        (tmp_path / "log" / name).write_text("\n".join(ALERT.format(f"{name}{i}", 1) for i in range(5)))
        assert run() == [("DDoS", 5 * n, 5 * n)]
    status = streaming.run_status(spark, str(tmp_path / "out")).orderBy("batch").collect()
    assert [r["flows"] for r in status] == [15, 20] and status[-1]["live_accuracy"] == 1.0


def test_alert_files_are_compressed(spark, tmp_path):
    """Two kilobytes of mostly fixed texts a flow, in queues, streams and logs alike."""
    rows = spark.range(1000).select(F.concat(F.lit("F"), F.col("id")).alias("flow_id"), F.lit(alerts.CONFIDENCE_MEANS).alias("confidence_means"))
    score.write_alert_queue(rows, str(tmp_path / "queue"))
    rows.write.parquet(str(tmp_path / "rows"))
    streaming.drain(lambda: streaming.start_alert_stream(stream_parquet(spark, str(tmp_path / "rows")), str(tmp_path / "out"), str(tmp_path / "state")))
    for name in ("queue", "out"):
        files = [f for f in (tmp_path / name).rglob("part-*")]
        assert files and sum(f.stat().st_size for f in files) < 1000 * len(alerts.CONFIDENCE_MEANS) / 4
        assert alerts.parse_alerts(spark.read.text(str(tmp_path / name))).select("flow_id").distinct().count() == 1000
