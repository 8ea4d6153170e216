"""Published value tables, fixture goldens and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tidewatch import cic
from tidewatch.functions import coerce, naming, text
from tidewatch.functions import severity as sev
from tidewatch.operators import alerts, evaluation, evidence, monitor, novelty, rows, verdict
from tidewatch.session import scratch_path
from tidewatch.spec import Bound, ContractError, DistributionReference, FlowSpec, NoveltyPolicy


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("r")).collect()]


def test_numbers(spark):
    values = ["1.5", " 2 ", "Infinity", "-inf", "NaN", "", "x", "1d", "0x1p3", "1e39", None, "+.5", "1e400"]
    assert column(spark, values, coerce.to_numeric) == [1.5, 2.0, None, None, None, None, None, None, None, 1e39, None,
                                                       0.5, None]
    assert column(spark, ["1e39", "-3e38", "5"], coerce.coerce_feature) == [None, -3e38, 5.0]


def test_headers(spark):
    names = [" Flow Duration", "Total Length of Fwd Packets", "﻿ Destination Port ", "Fwd  Header Length.1"]
    want = ["Flow Duration", "Total Length of Fwd Packets", "Destination Port", "Fwd Header Length.1"]
    assert [naming.canonical_name(n) for n in names] == want
    assert column(spark, names, naming.canonical_header) == want
    assert [naming.canonical_name(n) for n in want] == want


def test_labels_and_protocols(spark):
    labels = ["BENIGN", " Bot ", "DoS Hulk", "Web Attack \x96 XSS", "new", None]
    assert column(spark, labels, lambda c: naming.map_label(c, cic.LABEL_MAP)) == ["BENIGN", "Botnet"] + [None] * 4
    assert len(cic.LABEL_MAP) == 21 and len(cic.CIC_SPEC.profile_features) == 27
    protocols = ["6", "17", "0", "1", "6.0", "58", "99", None, "junk", "NaN", "inf"]
    assert column(spark, protocols, naming.protocol_name) == [
        "TCP", "UDP", "OTHER", "ICMP", "TCP", "ICMPv6", "PROTO-99"] + ["UNKNOWN"] * 4


def test_identity_fields(spark):
    assert column(spark, [None, " ", "nan", "<NA>", " 10.0.0.1 "], coerce.clean_ip) == ["0.0.0.0"] * 4 + ["10.0.0.1"]
    assert column(spark, ["80.0", "70000", "bad", "-1", None, "inf", "443.9"], coerce.clean_port) == [80, 0, 0, 0, 0, 0, 443]
    assert column(spark, ["1.7", "-0.5", "junk", "NaN", "0.3"], coerce.clamp_confidence) == [1.0, 0.0, 0.0, 0.0, 0.3]


def test_bands_have_no_gaps(spark):
    values = [i / 1000 for i in range(1001)]
    want = ["LOW" if v < 0.5 else "MEDIUM" if v < 0.75 else "HIGH" if v < 0.9 else "CRITICAL" for v in values]
    assert column(spark, values, sev.band, "double") == want
    assert column(spark, [1.5, -0.2, math.nan, None], sev.band, "double") == ["CRITICAL", "LOW", "LOW", "LOW"]


def test_severity_rules(spark):
    data = [("DDoS", .80, "RELIABLE", "CRITICAL", True, True, False), ("Botnet", .55, "RELIABLE", "HIGH", True, True, False),
            ("PortScan", .80, "RELIABLE", "HIGH", False, True, False), ("DDoS", .99, "RELIABLE", "CRITICAL", False, True, False),
            ("BENIGN", .99, "RELIABLE", "INFO", False, False, False), ("BENIGN", .99, "DEGRADED", "INFO", False, False, True),
            ("UNKNOWN_OOD", .99, "UNRELIABLE", "HIGH", False, True, True), ("PortScan", .3, "DEGRADED", "LOW", False, False, True),
            ("PortScan", .6, "UNKNOWN", "MEDIUM", False, True, False)]
    df = spark.createDataFrame([(i, t, c, r) for i, (t, c, r, *_) in enumerate(data)],
                               "i int, reported_threat string, confidence double, reliability string")
    out = sev.assess(df.withColumn("model_prediction", F.lit("BENIGN"))).orderBy("i").collect()
    assert [(r.severity, r.escalated, r.is_alertable, r.needs_review) for r in out] == [tuple(d[3:]) for d in data]


def test_number_texts(spark):
    values = [119328515.472, 0.0392497, 2322.6, 70000000.0, 0.5, 155.04099, 0.0, 12345.0, 999.96]
    want = [f"{v:,.4g}" for v in values]
    assert column(spark, values, text.significant, "double") == want
    shown = [f"{v:,.0f}" if abs(v) >= 1000 else f"{v:,.2f}".rstrip("0").rstrip(".") if abs(v) >= 1
             else f"{v:.3f}".rstrip("0").rstrip(".") for v in values]
    assert column(spark, values, text.format_value, "double") == shown


# Published bounds of the bidirectional profile (lower, upper, median).
BOUNDS = {
    "Flow Duration": (1, 119328515.472, 35807), "Total Fwd Packets": (1, 155.041, 2), "Total Backward Packets": (0, 214, 1),
    "Total Length of Fwd Packets": (0, 19898.23, 26), "Total Length of Bwd Packets": (0, 320891.484, 6),
    "Flow Bytes/s": (0, 70000000, 22565.96097), "Flow Packets/s": (0.039249722557, 2000000, 127.6242741),
    "Fwd Packet Length Mean": (0, 2322.6, 6), "Bwd Packet Length Mean": (0, 2901.75, 6), "Flow IAT Mean": (1, 34212300, 10148),
    "Flow IAT Std": (0, 54300000, 6455.3256505), "SYN Flag Count": (0, 1, 0), "ACK Flag Count": (0, 1, 0),
    "Destination Port": (4, 65127.082, 80)}
REFERENCE = DistributionReference(tuple(BOUNDS), {f: Bound(*map(float, b)) for f, b in BOUNDS.items()})


# Published out-of-distribution flows, columns as in BOUNDS plus the label.
FLOWS = """
5000000,45,38,42000,35000,15400,16.6,933.3,921.1,60240,21000,1,3,443,BENIGN
8200000,72,65,68000,71000,16951,16.7,944.4,1092.3,59854,24000,1,4,80,BENIGN
12000000,110,95,105000,98000,16916,17.1,954.5,1031.6,58536,22000,0,3,443,BENIGN
3500000,31,28,28000,32000,17142,16.9,903.2,1142.8,59322,19000,1,2,53,BENIGN
15000000,130,118,125000,130000,17000,16.5,961.5,1101.7,60483,26000,1,4,443,BENIGN
20000,5000,5,350000,400,17537500,250250,70,80,8,5,4200,2,80,DDoS
30000,7000,3,490000,250,16341667,233433,70,83,9,6,6100,1,443,DDoS
15000,4000,2,280000,160,18677333,266800,70,80,7,4,3500,0,80,DDoS
50000,9000,8,630000,600,12612000,180160,70,75,6,4,8000,3,8080,DDoS
25000,6000,4,420000,300,16812000,240160,70,75,4,3,5500,1,443,DDoS
5000,3,0,180,0,36000,600,60,0,1666,500,3,0,21,PortScan
7000,2,0,120,0,17142,285.7,60,0,3500,900,2,0,22,PortScan
3000,3,1,180,40,73333,1333,60,40,750,300,3,0,23,PortScan
9000,2,0,120,0,13333,222.2,60,0,4500,1200,2,0,25,PortScan
4000,4,0,240,0,60000,1000,60,0,1000,350,4,0,445,PortScan
1000000,15,10,1200,900,2100,25,80,90,40000,5000,1,2,443,Botnet
1200000,18,12,1440,1100,2116.7,25,80,91.7,40000,5200,1,2,8443,Botnet
900000,12,9,960,810,1966.7,23.3,80,90,37500,4800,1,1,8080,Botnet
1500000,20,14,1600,1300,1933.3,22.7,80,92.9,44117,6000,1,3,443,Botnet
1100000,16,11,1280,1000,2072.7,24.5,80,90.9,40740,5100,1,2,443,Botnet
"""


@pytest.fixture(scope="module")
def synthetic(spark):
    cells = [tuple(line.split(",")) for line in FLOWS.split()]
    lines = spark.createDataFrame(cells, [*BOUNDS, "Label"])
    typed = lines.dropna(how="all").select(*[coerce.to_numeric(F.col(f"`{f}`")).alias(f) for f in BOUNDS], "Label")
    scored = typed.withColumns({"model_prediction": F.lit("BENIGN"), "confidence": F.lit(0.913)})
    return verdict.assess(scored, REFERENCE, detail=True).persist()


def test_fixture_goldens(synthetic):
    out = synthetic.groupBy("reliability").count().collect()
    assert {r[0]: r[1] for r in out} == {"UNRELIABLE": 10, "DEGRADED": 9, "RELIABLE": 1}
    tiles = monitor.tiles(synthetic).first()
    assert (tiles.flows, tiles.alerts, tiles.review, tiles.out_of_distribution) == (20, 10, 9, 10)
    counts = evaluation.feature_violations(synthetic, verdict.violation_flags(REFERENCE)).collect()
    assert {r.feature: r.rows for r in counts} == {
        "ACK Flag Count": 11, "Total Length of Fwd Packets": 10, "SYN Flag Count": 10, "Total Fwd Packets": 5}
    ddos = synthetic.filter("Label = 'DDoS'").select(F.round("ood_score", 4).alias("s"), "violations.item.feature").collect()
    assert sorted(r.s for r in ddos) == [0.8571, 0.8571, 0.8571, 0.8929, 0.8929]
    assert all(r.feature[:3] == ["SYN Flag Count", "Total Fwd Packets", "Total Length of Fwd Packets"] for r in ddos)


def test_verdict_invariants(synthetic):
    wrong = synthetic.filter((F.col("reliability") == "UNRELIABLE") != (F.col("reported_threat") == "UNKNOWN_OOD"))
    assert wrong.isEmpty()
    assert synthetic.filter(~F.col("ood_score").between(0, 1)).isEmpty()
    keys = [list(r.k) for r in synthetic.select(F.col("violations.order_key").alias("k")).collect()]
    assert all(k == sorted(k) for k in keys)
    reasons = [r.ood_reason for r in synthetic.filter("n_violations > 0").collect()]
    assert all("training bound of" in r and "null" not in r for r in reasons)


def test_unusable_values_are_no_violation(spark):
    df = spark.createDataFrame([(math.nan, 5.0), (math.inf, 5.0), (None, 99.0)], "a double, b double")
    ref = DistributionReference(("a", "b"), {"a": Bound(0, 1, 0), "b": Bound(0, 10, 5)})
    assert [r[0] for r in df.select(verdict.violation_count(ref)).collect()] == [0, 0, 1]


def test_no_reference_means_unknown(spark):
    df = spark.createDataFrame([("DDoS", 0.8)], "model_prediction string, confidence double")
    row = verdict.assess(df, None, detail=True).first()
    assert (row.reliability, row.in_distribution, row.needs_review, row.reported_threat) == ("UNKNOWN", None, False, "DDoS")


def test_published_matrix_gives_published_metrics(spark):
    names = ["BENIGN", "Botnet", "DDoS", "PortScan"]
    matrix = [[12470, 28, 1, 1], [14, 473, 0, 0], [5, 0, 12495, 0], [2, 0, 0, 12498]]
    rows_ = [(t, p, n) for t, line in zip(names, matrix) for p, n in zip(names, line)]
    prf = evaluation.class_prf(spark.createDataFrame(rows_, "truth string, predicted string, n long"))
    f1 = {r["class"]: r.f1 for r in prf.collect()}
    assert f1["Botnet"] == pytest.approx(0.9574898785425101) and f1["DDoS"] == pytest.approx(0.999759961593855)
    m = evaluation.overall_metrics(prf).first()
    assert m.accuracy == pytest.approx(0.9986574354384394)
    assert m.balanced_accuracy == pytest.approx(0.9920731416837782)
    assert m.f1_macro == pytest.approx(0.9887722751679235) and m.f1_weighted == pytest.approx(0.9986650129640403)


def test_evidence_of_typical_flows(spark):
    flow = {"Fwd Packet Length Mean": 0.0, "Flow Duration": 50.0, "Fwd Packets/s": 20000.0, "Total Fwd Packets": 1.0,
            "Init_Win_bytes_forward": 29200.0, "Destination Port": 3527.0}
    df = spark.createDataFrame([("PortScan", *flow.values()), ("BENIGN", 500.0, 9e7, 1.0, 9.0, 1.0, 80.0), ("none", *flow.values())],
                               "model_prediction string, " + ", ".join(f"`{f}` double" for f in flow))
    weights = {"Destination Port": 0.16, "Fwd Packet Length Mean": 0.11, "Init_Win_bytes_forward": 0.06, "Flow Duration": 0.05}
    out = evidence.with_evidence(df, cic.CIC_EVIDENCE, weights).collect()
    scan = out[0].evidence_detail
    assert [x.feature for x in scan] == list(weights)
    assert scan[0].comparison.startswith("port 3527, registered") and scan[0].display == "3527"
    assert scan[1].comparison == "nothing, where the middle of benign flows is 39 bytes"
    assert scan[3].comparison == "974.0 times less than the middle of benign flows: 48,699 us (0.049 s)"
    assert out[0].evidence["Flow Duration"] == 50.0
    assert [x.why[:16] for x in out[1].evidence_detail] == ["For context only"] * 2  # values contradict the class
    assert out[2].evidence_detail == [] and out[2].aggregate_context is None


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows.contract(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ContractError) as err:
        rows.contract(df, ["a", "c"])
    assert err.value.missing == ["c"] and err.value.extra == ["b"]
    with pytest.raises(ContractError):
        rows.contract(df, ["a"], allow_extra=False)
    bidirectional = set(cic.BIDIRECTIONAL)
    assert len([f for f in cic.STRICT if f not in bidirectional]) == 13


def test_alert_round_trip_and_damaged_lines(spark, synthetic):
    ready = evidence.with_evidence(synthetic.withColumn("flow_id", F.lit("F000001")), cic.CIC_EVIDENCE)
    built = alerts.build_alerts(ready, profile="BIDIRECTIONAL", mode="TEST", truth="Label")
    path = scratch_path(spark, "test-lines")
    alerts.alert_json(built).write.text(path)
    lines = spark.read.text(path)
    assert lines.select(F.size(alerts.alert_problems(F.col("value"))).alias("n")).filter("n > 0").isEmpty()
    broken = spark.createDataFrame([("",), ("{not json}",), ("[1]",), ("5",), ('{"flow_id":"F1","threat',)], "value string")
    back = alerts.parse_alerts(lines.union(broken))
    assert back.count() == 20 and len(back.columns) == 40


def test_novelty_separates_outliers(spark):
    policy = NoveltyPolicy(trees=50, sample_rows=128)
    benign = spark.range(4000).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"))
    nodes = novelty.fit(benign, ["a", "b"], ["id"], policy, 42).persist()
    assert nodes.select("tree").distinct().count() == 50
    assert nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 2 * policy.sample_rows
    probe = spark.createDataFrame([(0.0, 0.0), (9.0, -9.0)], "a double, b double")
    near, far = [r.novelty_score for r in novelty.with_novelty(probe, nodes, ["a", "b"], policy).collect()]
    assert -1 <= far < near <= 0
    stats = novelty.reference(benign, nodes, ["a", "b"], policy).first()
    assert stats.threshold == pytest.approx(stats.benign_score_p1) and stats.threshold < stats.benign_score_median
    assert novelty.fit(benign.limit(10), ["a", "b"], ["id"], policy, 42) is None


def test_unlabelled_table_keeps_its_rows(spark):
    from tidewatch.operators.quality import scoring_truth

    spec = FlowSpec("s", {"P": ("x",)}, "P", "label", {"Bot": "Botnet"}, ("Botnet",))
    some = spark.createDataFrame([(1, "Bot"), (2, " odd "), (3, None)], "x int, label string")
    assert sorted(r[0] for r in scoring_truth(some, spec).select("threat_class").collect()) == ["Botnet", "odd"]
    none = some.withColumn("label", F.lit(None).cast("string"))
    out = scoring_truth(none, spec)
    assert out.count() == 3 and "threat_class" not in out.columns


def test_alerts_are_parsed_once_when_validated(spark):
    rows = [(None,), ("[1]",), ("{}",), ('{"schema_version":2,"confidence":7,"evidence":[],"reliability":"odd"}',)]
    found = spark.createDataFrame(rows, "value string").select(alerts.alert_problems(F.col("value")).alias("p"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(value") == 1
    codes = [r["p"] for r in found.collect()]
    missing = [f"missing:{k}" for k in alerts.REQUIRED_KEYS]
    assert codes[:3] == [["version"], ["version"], [*missing, "version"]]
    held = {f"missing:{k}" for k in ("schema_version", "confidence", "evidence", "reliability")}
    assert codes[3] == [*[m for m in missing if m not in held], "range:confidence", "type:evidence", "domain:reliability"]
