"""Verdict, severity, evidence and report queries over predicted lineitem flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.standin import (CARRY, CLASSES, FLOWS_SQL, LINE_FEATURES, LINE_IMPORTANCES, LINE_RULES,
                                       LINE_SPEC, LINE_SQL, assessed, flows, line_evidence, line_reference)
from tidewatch.functions.text import format_value
from tidewatch.operators import evaluation, evidence, forest, verdict
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators.rows import flow_id, numbered
from tidewatch.plans import score
from tidewatch.session import drop_scratch, materialize, scratch_mark, scratch_path

CARRY_LIST = ", ".join(CARRY)
DOMAIN = "('BENIGN', 'DDoS', 'PortScan', 'Botnet')"
DOMAIN_ROWS = "(SELECT unnest(['BENIGN', 'DDoS', 'PortScan', 'Botnet']) AS class)"
BAND = """CASE WHEN confidence >= 0.9 THEN 'CRITICAL' WHEN confidence >= 0.75 THEN 'HIGH'
  WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"""


def _rounded(df, *names, places=8):
    return df.withColumns({n: F.round(n, places) for n in names})


# --- verdict -----------------------------------------------------------------------

_EXC = {f: f"CASE WHEN {f} > {f}_hi THEN ({f} - {f}_hi) / greatest({f}_hi - {f}_lo, 1e-9) "
           f"WHEN {f} < {f}_lo THEN ({f}_lo - {f}) / greatest({f}_hi - {f}_lo, 1e-9) END" for f in LINE_FEATURES}
_VIOLATIONS = " UNION ALL ".join(
    f"SELECT {CARRY_LIST}, '{f}' AS feature, {f} AS value, {f}_lo AS lower, {f}_hi AS upper, {f}_med AS median, "
    f"CASE WHEN {f} > {f}_hi THEN 'above' ELSE 'below' END AS direction, {e} AS excursion, {i} AS pos "
    f"FROM v WHERE {e} IS NOT NULL" for i, (f, e) in enumerate(_EXC.items()))
_ORDERED = f"""x AS ({_VIOLATIONS}), o AS (SELECT *, row_number() OVER (PARTITION BY {CARRY_LIST}
  ORDER BY excursion DESC, pos) AS place FROM x)"""


@query("op_range_violations", f"""{LINE_SQL}, {_ORDERED} SELECT {CARRY_LIST}, feature, value, round(lower, 6) AS lower,
    round(upper, 6) AS upper, round(median, 6) AS median, direction, round(excursion, 6) AS excursion FROM o""")
def _(spark, sf_dir):
    items = assessed(spark, sf_dir, detail=True).select(*CARRY, F.explode("violations").alias("x"))
    v = "x.item"
    return items.select(*CARRY, f"{v}.feature", f"{v}.value", F.round(F.col(f"{v}.training_range")[0], 6).alias("lower"),
                        F.round(F.col(f"{v}.training_range")[1], 6).alias("upper"),
                        F.round(f"{v}.training_median", 6).alias("median"), f"{v}.direction",
                        F.round(-F.col("x.order_key"), 6).alias("excursion"))


@query("sort_violations", f"""{LINE_SQL}, {_ORDERED} SELECT {CARRY_LIST},
    string_agg(feature, ',' ORDER BY place) AS ordered FROM o GROUP BY ALL""")
def _(spark, sf_dir):
    names = F.concat_ws(",", "violations.item.feature")
    return assessed(spark, sf_dir, detail=True).select(*CARRY, names.alias("ordered")).filter(F.col("ordered") != "")


@query("op_reliability", f"{LINE_SQL} SELECT {CARRY_LIST}, n_violations, reliability, in_distribution FROM a")
def _(spark, sf_dir):
    return assessed(spark, sf_dir).select(*CARRY, "n_violations", "reliability", "in_distribution")


@query("op_ood_score", f"{LINE_SQL} SELECT {CARRY_LIST}, round(ood_score, 6) AS ood_score FROM a")
def _(spark, sf_dir):
    return assessed(spark, sf_dir).select(*CARRY, F.round("ood_score", 6).alias("ood_score"))


def _reason_sql() -> str:
    """Text of the reason in table ``a``: the first feature of largest excursion is described."""
    n, gaps = len(LINE_FEATURES), {f: f"coalesce({e}, -1)" for f, e in _EXC.items()}
    worst = f"greatest({', '.join(gaps.values())})"

    def number(x: str) -> str:
        return f"format('{{:,.4g}}', {x})"

    described = " ".join(f"""WHEN {gap} = {worst} THEN '{f} = ' || {number(f)} || ' is ' || CASE WHEN {f} > {f}_hi THEN 'above' ELSE 'below' END
      || ' the training bound of ' || CASE WHEN {f} > {f}_hi THEN {number(f + '_hi')} ELSE {number(f + '_lo')} END || ' (range ['
      || {number(f + '_lo')} || ', ' || {number(f + '_hi')} || '], ' || format('{{:,.1f}}', {gap}) || 'x the range width beyond it)'"""
                         for f, gap in gaps.items())
    return f"""CASE WHEN n_violations = 0 THEN 'All {n} features are in the range seen in training.' ELSE CASE
      WHEN reliability = 'UNRELIABLE' THEN n_violations || ' of {n} features are out of the range seen in training, so the model '
        || 'extrapolates and is not to be trusted. Worst: '
      ELSE '1 of {n} features is out of the training range. Treat with caution. ' END || CASE {described} END END"""


@query("op_ood_reason", f"{LINE_SQL} SELECT {CARRY_LIST}, reliability, {_reason_sql()} AS ood_reason FROM a")
def _(spark, sf_dir):
    return assessed(spark, sf_dir, detail=True).select(*CARRY, "reliability", "ood_reason")


@query("op_verdict", f"{LINE_SQL} SELECT {CARRY_LIST}, model_prediction, reported_threat FROM a")
def _(spark, sf_dir):
    return assessed(spark, sf_dir).select(*CARRY, "model_prediction", "reported_threat")


@query("op_severity", f"""{LINE_SQL} SELECT {CARRY_LIST}, severity, base_severity, escalated, is_alertable, needs_review
  FROM a""")
def _(spark, sf_dir):
    return assessed(spark, sf_dir).select(*CARRY, "severity", "base_severity", "escalated", "is_alertable", "needs_review")


_PCT = "printf('%.0f%%', confidence * 100)"


@query("op_severity_reason", f"""{LINE_SQL} SELECT {CARRY_LIST}, CASE WHEN reliability = 'UNRELIABLE' THEN
      'Input is out of the training distribution. The classifier said ' || model_prediction || ' at ' || {_PCT}
      || ', which is its own certainty and no measure of correctness here. Flagged HIGH for review.'
    WHEN reported_threat = 'BENIGN' THEN 'Classified BENIGN at ' || {_PCT}
      || '. Benign flows are kept for context, not ranked.'
      || CASE WHEN reliability = 'DEGRADED' THEN ' One feature is out of the training range: sent to review.' ELSE '' END
    ELSE 'Confidence ' || {_PCT} || ' is ' || base_severity || CASE
      WHEN escalated THEN '; raised to ' || severity || ' because ' || reported_threat
        || ' acts directly on availability or hosts.'
      WHEN reported_threat IN ('DDoS', 'Botnet') THEN ', the top band; ' || reported_threat || ' cannot be raised further.'
      ELSE '. ' || reported_threat || ' is not raised: it shows reconnaissance, no impact yet.' END
      || CASE WHEN reliability = 'DEGRADED' THEN ' One feature is out of the training range: treat with caution.' ELSE '' END
    END AS reason FROM a""")
def _(spark, sf_dir):
    return assessed(spark, sf_dir).select(*CARRY, F.col("severity_reason").alias("reason"))


@query("op_correct", f"{LINE_SQL} SELECT {CARRY_LIST}, truth = model_prediction AS correct FROM a")
def _(spark, sf_dir):
    return assessed(spark, sf_dir).select(*CARRY, verdict.correct(F.col("truth"), F.col("model_prediction")).alias("correct"))


# --- class probabilities -------------------------------------------------------------
_P = {"BENIGN": "l_discount * 5", "Botnet": "l_tax * 5", "DDoS": "l_discount * 5", "PortScan": "l_quantity / 100.0"}
_P_ARRAY = "array(" + ", ".join(f"CAST({e} AS DOUBLE)" for e in _P.values()) + ")"
_P_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _P.items())
_NAMES = list(_P)


@query("op_argmax", f"""WITH p AS (SELECT {CARRY_LIST}, {_P_SQL} FROM lineitem), m AS (SELECT *,
    greatest(BENIGN, Botnet, DDoS, PortScan) AS top FROM p)
  SELECT {CARRY_LIST}, CASE top WHEN BENIGN THEN 'BENIGN' WHEN Botnet THEN 'Botnet' WHEN DDoS THEN 'DDoS'
    ELSE 'PortScan' END AS prediction, round(top, 4) AS confidence FROM m""")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*CARRY, F.expr(_P_ARRAY).alias("p"))
    return rows.select(*CARRY, forest.argmax_class(F.col("p"), _NAMES).alias("prediction"),
                       F.round(F.array_max("p"), 4).alias("confidence"))


@query("op_probability_map", f"""WITH p AS (SELECT {CARRY_LIST}, {_P_SQL} FROM lineitem)
  SELECT {CARRY_LIST}, round(BENIGN, 3) AS benign, round(Botnet, 3) AS botnet, round(DDoS, 3) AS ddos,
    round(PortScan, 3) AS portscan FROM p""")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*CARRY, F.expr(_P_ARRAY).alias("p"))
    mapped = rows.withColumn("m", forest.probability_map(F.col("p"), _NAMES))
    return mapped.select(*CARRY, *[F.round(F.col("m")[c], 3).alias(c.lower()) for c in _NAMES])


_P_UNION = " UNION ALL ".join(f"SELECT rid, {CARRY_LIST}, '{c}' AS class, {c} AS p FROM p" for c in _NAMES)


@query("rank_probabilities", f"""WITH p AS (SELECT row_number() OVER () AS rid, {CARRY_LIST}, {_P_SQL} FROM lineitem), u AS ({_P_UNION})
  SELECT {CARRY_LIST}, string_agg(class, ',' ORDER BY p DESC, class) AS ranked FROM u GROUP BY rid, {CARRY_LIST}""")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*CARRY, F.expr(_P_ARRAY).alias("p"))
    pairs = F.transform(F.arrays_zip(F.array(*[F.lit(c) for c in _NAMES]).alias("class"), F.col("p")),
                        lambda z: F.struct((-z["p"]).alias("k"), z["class"].alias("class")))
    return rows.select(*CARRY, F.concat_ws(",", F.transform(F.array_sort(pairs), lambda z: z["class"])).alias("ranked"))


# --- evidence -------------------------------------------------------------------------

def _notable_sql(alias_threat: str, feature: str, direction: str) -> str:
    own, benign = f"{feature}_{alias_threat}", f"{feature}_BENIGN"
    if direction == "near":
        return (f"CASE WHEN {own} = 0 THEN abs({feature}) <= 1.0 ELSE abs({feature} - {own}) / abs({own}) <= 0.35 END")
    if direction == "high":
        return f"CASE WHEN {benign} > 0 THEN {feature} >= {benign} * 3.0 ELSE {feature} > 0 END"
    return f"CASE WHEN {benign} > 0 THEN {feature} <= {benign} * 0.34 ELSE {feature} = 0 END"


_MED_SQL = "m AS (SELECT " + ", ".join(
    f"quantile_cont({f}, 0.5) FILTER (truth = '{c}') AS {f}_{c}" for f in LINE_FEATURES for c in CLASSES) + " FROM flows)"
_CANDIDATES = " UNION ALL ".join(
    f"SELECT rid, {CARRY_LIST}, model_prediction, '{r.feature}' AS feature, {r.feature} AS value, {i} AS pos, "
    f"{LINE_IMPORTANCES[r.feature]} AS importance, {_notable_sql(c, r.feature, r.direction)} AS notable "
    f"FROM numbered, m WHERE model_prediction = '{c}'" for c, rs in LINE_RULES.items() for i, r in enumerate(rs))
# Keys of two flows may be equal (they are once at sf0.001), so SQL numbers the rows.
_NUMBERED = "numbered AS (SELECT *, row_number() OVER () AS rid FROM flows)"
_EVIDENCE_SQL = f"""WITH {FLOWS_SQL}, {_NUMBERED}, {_MED_SQL}, c AS ({_CANDIDATES}),
  k AS (SELECT *, row_number() OVER (PARTITION BY rid, notable ORDER BY importance DESC, pos) AS place,
    count(*) FILTER (notable) OVER (PARTITION BY rid) AS n FROM c),
  e AS (SELECT * FROM k WHERE (notable AND place <= 4) OR (NOT notable AND place <= greatest(2 - least(n, 4), 0)))"""


def _evidence(spark, sf_dir):
    return evidence.with_evidence(flows(spark, sf_dir, heavy=True), line_evidence(spark, sf_dir), LINE_IMPORTANCES)


@query("op_evidence", f"""{_EVIDENCE_SQL} SELECT {CARRY_LIST}, model_prediction, count(*) AS items,
    string_agg(feature, ',' ORDER BY notable DESC, place) AS features, round(sum(value), 4) AS value_sum
  FROM e GROUP BY rid, {CARRY_LIST}, model_prediction""")
def _(spark, sf_dir):
    items = F.col("evidence_detail")
    return _evidence(spark, sf_dir).select(
        *CARRY, "model_prediction", F.size(items).cast("long").alias("items"),
        F.concat_ws(",", "evidence_detail.feature").alias("features"),
        F.round(F.aggregate(items, F.lit(0.0), lambda a, x: a + x["value"]), 4).alias("value_sum"))


@query("fn_is_notable", f"""WITH {FLOWS_SQL}, {_NUMBERED}, {_MED_SQL}, c AS ({_CANDIDATES})
  SELECT {CARRY_LIST}, feature, pos, notable FROM c""")
def _(spark, sf_dir):
    judged = evidence.with_judged_rules(flows(spark, sf_dir, heavy=True), line_evidence(spark, sf_dir), LINE_IMPORTANCES,
                                        "model_prediction")
    rows = judged.select(*CARRY, F.explode("_ranked").alias("r")).filter(F.col("r.tier") < 2)
    return rows.select(*CARRY, "r.rule.feature", F.col("r.rule.position").alias("pos"), (F.col("r.tier") == 0).alias("notable"))


def _shown_sql(value: str) -> str:
    return (f"CASE WHEN abs({value}) >= 1000 THEN format('{{:,.0f}}', {value}) WHEN abs({value}) >= 1 THEN "
            f"rtrim(rtrim(format('{{:,.2f}}', {value}), '0'), '.') ELSE rtrim(rtrim(format('{{:,.3f}}', {value}), '0'), '.') END")


_USUAL = "the middle of benign flows is "
_BENIGN = "CASE feature " + " ".join(f"WHEN '{f}' THEN {f}_BENIGN" for f in LINE_FEATURES) + " END"


@query("fn_comparison", f"""{_EVIDENCE_SQL}, w AS (SELECT e.*, {_BENIGN} AS benign FROM e, m), t AS (SELECT *, {_shown_sql('value')} AS display,
    CASE WHEN benign = 0 THEN CASE WHEN value > 0 THEN '{_USUAL}0' END
      WHEN value = 0 AND 0 <= benign * 0.34 THEN 'nothing, where {_USUAL}' || {_shown_sql('benign')}
      WHEN value / benign >= 3.0 THEN format('{{:,.1f}}', value / benign) || ' times what half of benign flows stay under: ' || {_shown_sql('benign')}
      WHEN value / benign <= 0.34 THEN format('{{:,.1f}}', 1 / greatest(value / benign, 1e-9))
        || ' times less than the middle of benign flows: ' || {_shown_sql('benign')}
      ELSE '{_USUAL}' || {_shown_sql('benign')} END AS comparison FROM w)
  SELECT {CARRY_LIST}, string_agg(display, ' | ' ORDER BY notable DESC, place) AS displays,
    coalesce(string_agg(comparison, ' | ' ORDER BY notable DESC, place), '') AS comparisons FROM t GROUP BY rid, {CARRY_LIST}""")
def _(spark, sf_dir):
    detail = _evidence(spark, sf_dir)
    return detail.select(*CARRY, F.concat_ws(" | ", "evidence_detail.display").alias("displays"),
                         F.concat_ws(" | ", "evidence_detail.comparison").alias("comparisons"))


@query("fn_format_value", f"""WITH {FLOWS_SQL} SELECT {CARRY_LIST},
    CASE WHEN price >= 1000 THEN format('{{:,.0f}}', price)
      ELSE rtrim(rtrim(format('{{:,.2f}}', price), '0'), '.') END AS price_text,
    CASE WHEN abs(discount) >= 1 THEN rtrim(rtrim(format('{{:,.2f}}', discount), '0'), '.')
      ELSE rtrim(rtrim(format('{{:.3f}}', discount), '0'), '.') END AS discount_text FROM flows""")
def _(spark, sf_dir):
    return flows(spark, sf_dir).select(*CARRY, format_value(F.col("price")).alias("price_text"),
                                       format_value(F.col("discount")).alias("discount_text"))


# --- alerts -----------------------------------------------------------------------------

# Observation numbers: places in the order of all of a flow's columns.
SEQUENCE = (*CARRY, *LINE_FEATURES, "truth")
_NUMBERED_ALERTS = f"{LINE_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY {', '.join(SEQUENCE)}) AS seq FROM a)"


def _alert_rows(spark, sf_dir, only_queued=False):
    reference = line_reference(spark, sf_dir)
    mark = scratch_mark()
    observed = numbered(flows(spark, sf_dir, heavy=True), SEQUENCE)
    if only_queued:  # decided on counters, so violations, texts and evidence are built for those rows only
        decided = alert_ops.queued(verdict.assess(observed, reference)).select(*observed.columns)
        observed = materialize(decided, "queued")
        drop_scratch(spark, mark, keep=observed)  # the numbered rows
    rows = verdict.assess(observed, reference, detail=True)
    rows = rows.withColumns({
        "flow_id": flow_id(F.col("seq"), "S"), "src": F.col("l_suppkey").cast("string"),
        "dst": F.lit(None).cast("string"), "sport": F.col("l_partkey").cast("string"),
        "proto": F.col("l_linenumber").cast("string"), "when_seen": F.lit("nan")})
    rows = evidence.with_evidence(rows, line_evidence(spark, sf_dir), LINE_IMPORTANCES)
    return alert_ops.build_alerts(
        rows, profile="WIDE", mode="BATCH_SCORING", truth="truth", observed=F.lit("2024-01-01 00:00:00").cast("timestamp"),
        identity={"src_ip": "src", "dst_ip": "dst", "src_port": "sport", "dst_port": "price", "protocol": "proto",
                  "source_flow_id": "src", "capture_timestamp": "when_seen"})


@query("op_build_alert", f"""{_NUMBERED_ALERTS} SELECT printf('S%06d', seq) AS flow_id,
    '2024-01-01T00:00:00+00:00' AS timestamp, CAST(l_suppkey AS VARCHAR) AS src_ip, '0.0.0.0' AS dst_ip,
    CAST(l_partkey AS INTEGER) AS src_port, CAST(CASE WHEN trunc(price) <= 65535 THEN trunc(price) ELSE 0 END AS INTEGER) AS dst_port,
    CASE l_linenumber WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' ELSE 'PROTO-' || l_linenumber END AS protocol,
    reported_threat AS threat_class, round(confidence, 4) AS confidence, severity, base_severity, escalated,
    is_alertable, needs_review, model_prediction, in_distribution, reliability, CAST(n_violations AS INTEGER) AS n_ood,
    truth AS ground_truth, truth = model_prediction AS correct, 2 AS schema_version,
    CAST(l_suppkey AS VARCHAR) AS source_flow_id, CAST(NULL AS VARCHAR) AS capture_timestamp, 'BATCH_SCORING' AS observation_mode
  FROM s""")
def _(spark, sf_dir):
    return _alert_rows(spark, sf_dir).select(
        "flow_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "threat_class",
        F.round("confidence", 4).alias("confidence"), "severity", "base_severity", "escalated", "is_alertable",
        "needs_review", "model_prediction", "in_distribution", "reliability", F.size("ood_features").alias("n_ood"),
        "ground_truth", "correct", "schema_version", "source_flow_id", "capture_timestamp", "observation_mode")


@query("fn_alert_json", f"""{_NUMBERED_ALERTS} SELECT printf('S%06d', seq) AS flow_id, 40 AS keys,
    severity, truth AS ground_truth, CAST(is_alertable AS VARCHAR) AS is_alertable, CAST(l_partkey AS VARCHAR) AS src_port FROM s""")
def _(spark, sf_dir):
    value = alert_ops.alert_json(_alert_rows(spark, sf_dir))
    return value.select(F.get_json_object("value", "$.flow_id").alias("flow_id"), F.size(F.json_object_keys("value")).alias("keys"),
                        *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("severity", "ground_truth", "is_alertable", "src_port")])


_QUEUE_SELECT = """SELECT printf('S%06d', seq) AS flow_id, reported_threat AS threat_class, severity,
  is_alertable, needs_review, round(confidence, 4) AS confidence FROM s WHERE is_alertable OR needs_review"""


@query("sink_alert_queue", f"{_NUMBERED_ALERTS} {_QUEUE_SELECT}")
def _(spark, sf_dir):
    path = scratch_path(spark, "alert-queue")
    score.write_alert_queue(_alert_rows(spark, sf_dir, only_queued=True), path)
    back = alert_ops.parse_alerts(spark.read.text(path))
    return back.select("flow_id", "threat_class", "severity", "is_alertable", "needs_review",
                       F.round("confidence", 4).alias("confidence"))


@query("sink_predictions", f"""{LINE_SQL} SELECT reported_threat, model_prediction, round_even(confidence, 4) AS confidence,
    reliability, round_even(ood_score, 4) AS ood_score, severity, is_alertable, needs_review, truth AS ground_truth,
    truth = model_prediction AS correct FROM a""")
def _(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    score.prediction_table(assessed(spark, sf_dir), LINE_SPEC, truth="truth").write.parquet(path)
    return spark.read.parquet(path)


_SECTIONS = " UNION ALL ".join(
    f"SELECT '{name}' AS section, {col} AS name, count(*) AS n FROM a GROUP BY 2" for name, col in (
        ("predicted", "model_prediction"), ("reported", "reported_threat"), ("severity", "severity"),
        ("reliability", "reliability")))


@query("sink_scoring_summary", f"""{LINE_SQL}, s AS ({_SECTIONS}
    UNION ALL SELECT 'total', 'alertable', count(*) FILTER (is_alertable) FROM a
    UNION ALL SELECT 'total', 'review_only', count(*) FILTER (needs_review AND NOT is_alertable) FROM a
    UNION ALL SELECT 'total', 'scored', count(*) FROM a)
  SELECT 'lineitem' AS input, 'wide' AS profile, section, name, n FROM s""")
def _(spark, sf_dir):
    path = scratch_path(spark, "summary")
    score.write_summary(score.summary(assessed(spark, sf_dir), "lineitem", "wide"), path)
    return spark.read.parquet(path)


# --- evaluation -----------------------------------------------------------------------------
_GRID = f"""g AS (SELECT t.class AS truth, p.class AS predicted FROM {DOMAIN_ROWS} t, {DOMAIN_ROWS} p),
  k AS (SELECT truth, model_prediction AS predicted, count(*) AS c FROM flows GROUP BY 1, 2),
  mx AS (SELECT truth, predicted, coalesce(c, 0) AS n FROM g LEFT JOIN k USING (truth, predicted))"""
_PRF = f"""WITH {FLOWS_SQL}, {_GRID},
  bt AS (SELECT truth AS class, CAST(sum(n) AS BIGINT) AS support,
    CAST(sum(n) FILTER (truth = predicted) AS BIGINT) AS tp FROM mx GROUP BY 1),
  bp AS (SELECT predicted AS class, CAST(sum(n) AS BIGINT) AS called FROM mx GROUP BY 1),
  pr AS (SELECT class, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support, tp, called FROM bt JOIN bp USING (class)),
  prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END
    AS f1 FROM pr)"""


def _matrix(spark, sf_dir):
    return evaluation.confusion(flows(spark, sf_dir), CLASSES)


@query("agg_confusion", f"WITH {FLOWS_SQL}, {_GRID} SELECT truth, predicted, n FROM mx")
def _(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("agg_confusion_normalised", f"""WITH {FLOWS_SQL}, {_GRID} SELECT truth, predicted, n,
    round(n / greatest(sum(n) OVER (PARTITION BY truth), 1), 8) AS share FROM mx""")
def _(spark, sf_dir):
    return _rounded(evaluation.confusion_normalised(_matrix(spark, sf_dir)), "share")


@query("agg_top_confusions", f"""WITH {FLOWS_SQL}, {_GRID}, s AS (SELECT truth, predicted, n,
    round(n / greatest(sum(n) OVER (PARTITION BY truth), 1), 8) AS share FROM mx)
  SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total_errors FROM s WHERE truth <> predicted
  ORDER BY n DESC, truth DESC, predicted DESC LIMIT 5""")
def _(spark, sf_dir):
    return _rounded(evaluation.top_confusions(_matrix(spark, sf_dir)), "share")


@query("agg_class_prf", f"""{_PRF} SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall,
    round(f1, 8) AS f1, support, tp, called FROM prf""")
def _(spark, sf_dir):
    return _rounded(evaluation.class_prf(_matrix(spark, sf_dir)), "precision", "recall", "f1")


_OVERALL = """SELECT CAST(sum(support) AS BIGINT) AS rows, round(sum(tp) / sum(support), 8) AS accuracy,
  round(avg(recall) FILTER (support > 0), 8) AS balanced_accuracy, round(avg(precision), 8) AS precision_macro,
  round(avg(recall), 8) AS recall_macro, round(avg(f1), 8) AS f1_macro,
  round(sum(precision * support) / sum(support), 8) AS precision_weighted,
  round(sum(recall * support) / sum(support), 8) AS recall_weighted,
  round(sum(f1 * support) / sum(support), 8) AS f1_weighted FROM prf WHERE support > 0 OR called > 0"""
METRICS = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted",
           "recall_weighted", "f1_weighted")


@query("agg_overall_metrics", f"{_PRF} {_OVERALL}")
def _(spark, sf_dir):
    return _rounded(evaluation.overall_metrics(evaluation.class_prf(_matrix(spark, sf_dir))), *METRICS)


@query("agg_known_accuracy", f"{_PRF.replace('FROM flows GROUP', f'FROM flows WHERE truth IN {DOMAIN} GROUP')} {_OVERALL}")
def _(spark, sf_dir):
    known = evaluation.known_only(flows(spark, sf_dir), CLASSES)
    return _rounded(evaluation.overall_metrics(evaluation.class_prf(evaluation.confusion(known, CLASSES))), *METRICS)


@query("agg_confidence_bands", f"""WITH {FLOWS_SQL}, c AS (SELECT {BAND} AS band, count(*) AS n,
    count(*) FILTER (truth IN {DOMAIN}) AS k, count(*) FILTER (truth IN {DOMAIN} AND truth = model_prediction) AS r
    FROM flows GROUP BY 1), d AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS band)
  SELECT band, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 8) AS share,
    coalesce(k, 0) AS n_known, CASE WHEN k > 0 THEN round(r / k, 8) END AS accuracy FROM d LEFT JOIN c USING (band)""")
def _(spark, sf_dir):
    return _rounded(evaluation.confidence_bands(flows(spark, sf_dir), CLASSES), "share", "accuracy")


@query("agg_predicted_distribution", f"""WITH {FLOWS_SQL}, c AS (SELECT model_prediction AS class, count(*) AS n,
    avg(confidence) AS mean_confidence FROM flows GROUP BY 1), d AS {DOMAIN_ROWS}
  SELECT class, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 8) AS share,
    round(mean_confidence, 6) AS mean_confidence FROM d FULL JOIN c USING (class)""")
def _(spark, sf_dir):
    out = evaluation.predicted_distribution(flows(spark, sf_dir), CLASSES)
    return _rounded(_rounded(out, "share"), "mean_confidence", places=6)


@query("agg_reported_distribution", f"""{LINE_SQL} SELECT reported_threat AS verdict, count(*) AS n,
    round(count(*) / sum(count(*)) OVER (), 8) AS share FROM a GROUP BY 1""")
def _(spark, sf_dir):
    return _rounded(evaluation.value_shares(assessed(spark, sf_dir), "reported_threat", "verdict"), "share")


@query("agg_reliability", f"""{LINE_SQL}, c AS (SELECT reliability, count(*) AS n, sum(ood_score) AS s FROM a GROUP BY 1)
  SELECT reliability, n, round(n / sum(n) OVER (), 8) AS share,
    round(sum(CASE WHEN reliability = 'UNRELIABLE' THEN n ELSE 0 END) OVER () / sum(n) OVER (), 8) AS ood_rate,
    round(sum(s) OVER () / sum(n) OVER (), 6) AS mean_ood_score FROM c""")
def _(spark, sf_dir):
    out = evaluation.reliability_report(assessed(spark, sf_dir))
    return _rounded(_rounded(out, "share", "ood_rate"), "mean_ood_score", places=6)


@query("agg_ood_features", f"""{LINE_SQL}, x AS ({_VIOLATIONS}) SELECT feature, count(*) AS rows,
    round(count(*) / (SELECT count(*) FROM flows), 8) AS share FROM x GROUP BY 1 ORDER BY rows DESC, feature LIMIT 6""")
def _(spark, sf_dir):
    flags = verdict.violation_flags(line_reference(spark, sf_dir))
    return _rounded(evaluation.feature_violations(flows(spark, sf_dir), flags, 6), "share")


@query("agg_ood_said", f"""{LINE_SQL} SELECT model_prediction AS class, count(*) AS n,
    round(avg(confidence), 6) AS mean_confidence FROM a WHERE reliability = 'UNRELIABLE' GROUP BY 1""")
def _(spark, sf_dir):
    return _rounded(evaluation.unreliable_predictions(assessed(spark, sf_dir)), "mean_confidence", places=6)


@query("agg_severity", f"""{LINE_SQL}, c AS (SELECT severity, count(*) AS n FROM a GROUP BY 1),
  d AS (SELECT unnest(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS severity, unnest([0, 1, 2, 3, 4]) AS rank)
  SELECT severity, rank, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 8) AS share,
    (SELECT count(*) FROM a WHERE is_alertable) AS alertable,
    (SELECT count(*) FROM a WHERE needs_review AND NOT is_alertable) AS review_only FROM d LEFT JOIN c USING (severity)""")
def _(spark, sf_dir):
    return _rounded(evaluation.severity_report(assessed(spark, sf_dir)), "share")


@query("agg_benign_purity", f"""WITH {FLOWS_SQL} SELECT count(*) FILTER (model_prediction = 'BENIGN') AS called_benign,
    count(*) FILTER (model_prediction = 'BENIGN' AND truth = 'BENIGN') AS truly_benign,
    count(*) FILTER (truth NOT IN {DOMAIN}) AS unseen,
    round(count(*) FILTER (model_prediction = 'BENIGN' AND truth = 'BENIGN')
      / count(*) FILTER (model_prediction = 'BENIGN'), 8) AS purity FROM flows""")
def _(spark, sf_dir):
    return _rounded(evaluation.benign_purity(flows(spark, sf_dir), CLASSES, "BENIGN"), "purity")


_FPR = f"""WITH {FLOWS_SQL}, f AS (SELECT *, model_prediction <> 'BENIGN' AS wrong FROM flows WHERE truth = 'BENIGN')
  SELECT count(*) AS benign_rows, count(*) FILTER (wrong) AS false_positives,
    round(avg(confidence) FILTER (wrong), 6) AS mean_confidence, count(*) FILTER (wrong AND confidence >= 0.9) AS critical,
    round(quantile_cont(confidence, 0.5) FILTER (wrong), 6) AS median_confidence,
    round(count(*) FILTER (wrong) / count(*), 8) AS rate FROM f"""


@query("agg_benign_fpr", _FPR)
def _(spark, sf_dir):
    out = evaluation.benign_false_positives(flows(spark, sf_dir), "BENIGN")
    return _rounded(_rounded(out, "rate"), "mean_confidence", "median_confidence", places=6)


@query("agg_unseen_classes", f"""{LINE_SQL} SELECT truth AS label, count(*) AS flows,
    count(*) FILTER (model_prediction = 'BENIGN') AS missed_as_benign,
    count(*) FILTER (reliability = 'UNRELIABLE') AS rescued, count(*) FILTER (model_prediction <> 'BENIGN') AS flagged,
    round(count(*) FILTER (model_prediction = 'BENIGN') / count(*), 8) AS miss_rate,
    round(count(*) FILTER (reliability = 'UNRELIABLE') / count(*), 8) AS rescue_rate
  FROM a WHERE truth NOT IN {DOMAIN} GROUP BY ROLLUP (truth)""")
def _(spark, sf_dir):
    out = evaluation.unseen_classes(assessed(spark, sf_dir), CLASSES, "BENIGN")
    return _rounded(out, "miss_rate", "rescue_rate")


@query("topk_detections", f"""{LINE_SQL} SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flow_id,
    reported_threat, model_prediction, confidence, severity FROM a WHERE reported_threat <> 'BENIGN'
  ORDER BY confidence DESC, flow_id LIMIT 50""")
def _(spark, sf_dir):
    rows = assessed(spark, sf_dir).withColumn(
        "flow_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    top = evaluation.top_detections(rows, 50, "BENIGN", "flow_id")
    return top.select("flow_id", "reported_threat", "model_prediction", "confidence", "severity")


@query("agg_profile_comparison", f"""WITH {FLOWS_SQL},
  alt AS (SELECT * REPLACE (CASE WHEN quantity > 25 THEN 'DDoS' ELSE 'BENIGN' END AS model_prediction) FROM flows),
  u AS (SELECT 'WIDE' AS profile, 4 AS n_features, truth, model_prediction FROM flows WHERE truth IN {DOMAIN}
    UNION ALL SELECT 'NARROW', 2, truth, model_prediction FROM alt WHERE truth IN {DOMAIN}),
  c AS (SELECT profile, n_features, d.class, count(*) FILTER (truth = d.class) AS support,
    count(*) FILTER (model_prediction = d.class) AS called,
    count(*) FILTER (truth = d.class AND model_prediction = d.class) AS tp FROM u, {DOMAIN_ROWS} d GROUP BY 1, 2, 3),
  f AS (SELECT *, CASE WHEN called + support > 0 THEN 2 * tp / (called + support) ELSE 0 END AS f1,
    tp / support AS recall FROM c),
  p AS (SELECT profile, n_features, round(sum(tp) / sum(support), 8) AS accuracy,
    round(avg(recall), 8) AS balanced_accuracy, round(avg(f1), 8) AS f1_macro,
    {', '.join(f"round(max(f1) FILTER (class = '{c}'), 8) AS f1_{c.lower()}" for c in CLASSES)} FROM f GROUP BY 1, 2)
  SELECT *, f1_macro = max(f1_macro) OVER () AS is_best FROM p""")
def _(spark, sf_dir):
    known = evaluation.known_only(flows(spark, sf_dir), CLASSES)
    simple = known.withColumn("model_prediction", F.when(F.col("quantity") > 25, F.lit("DDoS")).otherwise(F.lit("BENIGN")))
    tables = []
    for name, n, rows in (("WIDE", 4, known), ("NARROW", 2, simple)):
        prf = evaluation.class_prf(evaluation.confusion(rows, CLASSES)).withColumn("_k", F.lit(1))
        overall = evaluation.overall_metrics(prf).select("accuracy", "balanced_accuracy", "f1_macro", F.lit(1).alias("_k"))
        tables.append(prf.join(F.broadcast(overall), "_k").select(
            F.lit(name).alias("profile"), F.lit(n).alias("n_features"), "class", "f1", "accuracy", "balanced_accuracy",
            "f1_macro"))
    out = evaluation.profile_comparison(tables[0].unionByName(tables[1]))
    wide = out.select("profile", "n_features", "accuracy", "balanced_accuracy", "f1_macro", "is_best",
                      *[F.col("class_f1")[c].alias(f"f1_{c.lower()}") for c in CLASSES])
    return _rounded(wide, "accuracy", "balanced_accuracy", "f1_macro", *[f"f1_{c.lower()}" for c in CLASSES])
