"""Lookups and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import cic
from tidewatch.catalog.registry import query
from tidewatch.catalog.standin import (CARRY, CLASSES, FLOWS_SQL, LINE_FEATURES, LINE_IMPORTANCES, LINE_RULES,
                                       LINE_SPEC, LINE_SPLIT_SQL, MAPPED, RAW_SQL, flows, lineitem, raw,
                                       split_flows)
from tidewatch.functions import coerce, naming
from tidewatch.functions import severity as sev
from tidewatch.operators import alerts, evidence, quality, rows
from tidewatch.operators.verdict import known
from tidewatch.plans import train as training

CARRY_LIST = ", ".join(CARRY)


@query("lookup_label_map", f"WITH {RAW_SQL} SELECT {CARRY_LIST}, label, {MAPPED} AS class FROM raw")
def _(spark, sf_dir):
    return raw(spark, sf_dir).select(*CARRY, "label", naming.map_label(F.col("label"), cic.LABEL_MAP).alias("class"))


@query("fn_map_label", f"""WITH {RAW_SQL} SELECT {MAPPED} AS class, trim(label) AS text, count(*) AS n FROM raw
  GROUP BY 1, 2""")
def _(spark, sf_dir):
    label = F.col("label")
    return raw(spark, sf_dir).groupBy(naming.map_label(label, cic.LABEL_MAP).alias("class"),
                                      coerce.strip(label).alias("text")).agg(F.count("*").alias("n"))


@query("scan_scoring_input", f"""WITH {RAW_SQL}, t AS (SELECT {CARRY_LIST}, quantity, price, discount, tax,
    coalesce({MAPPED}, trim(label)) AS threat_class FROM raw) SELECT * FROM t WHERE threat_class IS NOT NULL""")
def _(spark, sf_dir):
    out = quality.scoring_truth(raw(spark, sf_dir), LINE_SPEC)
    return out.select(*CARRY, "quantity", "price", "discount", "tax", "threat_class")


_PROTO = """CASE l_quantity WHEN 1 THEN '6' WHEN 2 THEN '17.0' WHEN 3 THEN 'junk' WHEN 4 THEN NULL WHEN 5 THEN 'NaN'
  WHEN 6 THEN '1' WHEN 7 THEN '58' WHEN 8 THEN '0' WHEN 9 THEN 'inf' ELSE CAST(l_linenumber AS {text}) END"""


@query("lookup_protocol", f"""WITH p AS (SELECT {CARRY_LIST}, {_PROTO.format(text='VARCHAR')} AS proto FROM lineitem),
  n AS (SELECT *, CASE WHEN isfinite(TRY_CAST(proto AS DOUBLE)) THEN CAST(trunc(TRY_CAST(proto AS DOUBLE)) AS BIGINT)
    END AS k FROM p)
  SELECT {CARRY_LIST}, CASE WHEN k IS NULL THEN 'UNKNOWN' WHEN k = 0 THEN 'OTHER' WHEN k = 1 THEN 'ICMP'
    WHEN k = 6 THEN 'TCP' WHEN k = 17 THEN 'UDP' WHEN k = 58 THEN 'ICMPv6' ELSE 'PROTO-' || k END AS protocol FROM n""")
def _(spark, sf_dir):
    text = F.expr(_PROTO.format(text="STRING"))
    return lineitem(spark, sf_dir).select(*CARRY, naming.protocol_name(text).alias("protocol"))


_PORTS = ", ".join(f"({k}, '{v}')" for k, v in cic.WELL_KNOWN_PORTS.items())
_PORT_CASE = """CASE WHEN name IS NOT NULL THEN 'port ' || port || ' (' || name || ')'
  WHEN port < 1024 THEN 'port ' || port || ', in the system range'
  WHEN port < 49152 THEN 'port ' || port || ', registered but of no standard service'
  ELSE 'port ' || port || ', in the dynamic range' END"""


@query("lookup_service_port", f"""WITH s(port, name) AS (VALUES {_PORTS}),
  o AS (SELECT o_orderkey, CAST(o_custkey % 65536 AS BIGINT) AS port FROM orders)
  SELECT o_orderkey, o.port AS port, {_PORT_CASE.replace('port', 'o.port').replace("'o.port '", "'port '")} AS described
  FROM o LEFT JOIN s ON o.port = s.port""")
def _(spark, sf_dir):
    ports = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.pmod("o_custkey", F.lit(65536)).alias("port"))
    services = spark.createDataFrame(list(cic.WELL_KNOWN_PORTS.items()), "port long, name string")
    joined = evidence.lookup(ports, services, ["port"])
    prefix = F.concat(F.lit("port "), F.col("port").cast("string"))
    return joined.select("o_orderkey", "port", F.when(F.col("name").isNotNull(), F.concat(
        prefix, F.lit(" ("), "name", F.lit(")"))).when(
        F.col("port") < 1024, F.concat(prefix, F.lit(", in the system range"))).when(
        F.col("port") < 49152, F.concat(prefix, F.lit(", registered but of no standard service"))).otherwise(
        F.concat(prefix, F.lit(", in the dynamic range"))).alias("described"))


@query("fn_describe_port", f"""WITH s(port, name) AS (VALUES {_PORTS}),
  o AS (SELECT {CARRY_LIST}, CAST(floor(l_extendedprice) AS BIGINT) AS port FROM lineitem)
  SELECT {CARRY_LIST}, {_PORT_CASE.replace('port', 'o.port').replace("'o.port '", "'port '")} AS described
  FROM o LEFT JOIN s ON o.port = s.port""")
def _(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*CARRY, naming.describe_port(F.col("l_extendedprice")).alias("described"))


_LONG = " UNION ALL ".join(f"SELECT {CARRY_LIST}, truth, '{c}' AS feature, {c} AS value FROM flows"
                           for c in LINE_FEATURES)


def _long(spark, sf_dir):
    return evidence.unpivot(flows(spark, sf_dir), [*CARRY, "truth"], LINE_FEATURES)


@query("lookup_bounds", f"""WITH {LINE_SPLIT_SQL}, x AS ({_LONG}),
  w AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c}_lo AS lower, {c}_hi AS upper, {c}_med AS median FROM b"
                            for c in LINE_FEATURES)})
  SELECT {CARRY_LIST}, feature, value, round(lower, 6) AS lower, round(upper, 6) AS upper, round(median, 6) AS median,
    value > upper OR value < lower AS outside FROM x JOIN w USING (feature)""")
def _(spark, sf_dir):
    train = split_flows(flows(spark, sf_dir), LINE_SPEC, CARRY).filter(~F.col("is_test"))
    bounds = training.quantile_bounds(train, LINE_FEATURES, 0.05).drop("n")
    joined = evidence.lookup(_long(spark, sf_dir), bounds, ["feature"])
    return joined.select(*CARRY, "feature", "value", *[F.round(c, 6).alias(c) for c in ("lower", "upper", "median")],
                         ((F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))).alias("outside"))


_MEDIANS_SQL = " UNION ALL ".join(
    f"SELECT truth, '{c}' AS feature, quantile_cont({c}, 0.5) AS median FROM flows "
    f"WHERE truth IN ('BENIGN', 'DDoS', 'PortScan', 'Botnet') GROUP BY 1" for c in LINE_FEATURES)


@query("lookup_reference_median", f"""WITH {FLOWS_SQL}, x AS ({_LONG}), m AS ({_MEDIANS_SQL})
  SELECT {CARRY_LIST}, feature, truth, value, round(median, 6) AS median FROM x LEFT JOIN m USING (truth, feature)""")
def _(spark, sf_dir):
    medians = evidence.class_medians(flows(spark, sf_dir), LINE_FEATURES, "truth", CLASSES)
    table = medians.select(F.col("class").alias("truth"), "feature", F.round("median", 6).alias("median"))
    return evidence.lookup(_long(spark, sf_dir), table, ["truth", "feature"])


@query("lookup_importance", f"""WITH {FLOWS_SQL}, x AS ({_LONG}), i(feature, importance) AS (VALUES ('price', 0.4),
    ('quantity', 0.3), ('discount', 0.2))
  SELECT {CARRY_LIST}, feature, value, CAST(coalesce(importance, 0.0) AS DOUBLE) AS importance
  FROM x LEFT JOIN i USING (feature)""")
def _(spark, sf_dir):
    known = {f: v for f, v in LINE_IMPORTANCES.items() if f != "tax"}
    table = spark.createDataFrame(list(known.items()), "feature string, importance double")
    joined = evidence.lookup(_long(spark, sf_dir).drop("truth"), table, ["feature"])
    return joined.withColumn("importance", F.coalesce("importance", F.lit(0.0)))


_RULES = ", ".join(f"('{c}', {i}, '{r.feature}', '{r.direction}')"
                   for c, rs in LINE_RULES.items() for i, r in enumerate(rs))


@query("lookup_rules", f"""WITH {FLOWS_SQL}, r(model_prediction, pos, feature, direction) AS (VALUES {_RULES})
  SELECT {CARRY_LIST}, model_prediction, count(feature) AS rules,
    string_agg(feature || ':' || direction, ',' ORDER BY pos) AS listed
  FROM flows LEFT JOIN r USING (model_prediction) GROUP BY ALL""")
def _(spark, sf_dir):
    # Rules re-aggregated on the small side first: the join stays one row to one.
    table = spark.createDataFrame([(c, i, r.feature, r.direction) for c, rs in LINE_RULES.items()
                                   for i, r in enumerate(rs)],
                                  "model_prediction string, pos int, feature string, direction string")
    listed = table.groupBy("model_prediction").agg(
        F.count("*").alias("rules"),
        F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "feature", "direction").alias("text")))).alias("a"))
    joined = evidence.lookup(flows(spark, sf_dir).select(*CARRY, "model_prediction"), listed, ["model_prediction"])
    return joined.select(*CARRY, "model_prediction", F.coalesce("rules", F.lit(0)).alias("rules"),
                         F.concat_ws(",", F.transform("a", lambda x: x["text"])).alias("listed"))


@query("filter_known_class", f"""WITH {FLOWS_SQL} SELECT {CARRY_LIST}, truth,
    truth IN ('BENIGN', 'DDoS', 'PortScan', 'Botnet') AS known FROM flows""")
def _(spark, sf_dir):
    answer = F.coalesce(known(F.col("truth"), CLASSES), F.lit(False))
    return flows(spark, sf_dir).select(*CARRY, "truth", answer.alias("known"))


# --- records as maps -----------------------------------------------------------------
_RECORD = """map_filter(map('quantity', CAST(l_quantity AS STRING), 'price', CAST(l_extendedprice AS STRING),
  'discount', CAST(l_discount AS STRING), 'tax', CAST(l_tax AS STRING)),
  (k, v) -> NOT (k = 'tax' AND l_linenumber = 1) AND NOT (k = 'quantity' AND l_linenumber = 2)
    AND NOT (k = 'price' AND l_linestatus = 'F' AND l_linenumber = 3))"""
_NO_TAX, _NO_QTY = "l_linenumber = 1", "l_linenumber = 2"
_NO_PRICE = "(l_linestatus = 'F' AND l_linenumber = 3)"
_MISSING = (f"concat_ws(',', CASE WHEN {_NO_QTY} THEN 'quantity' END, CASE WHEN {_NO_PRICE} THEN 'price' END, "
            f"CASE WHEN {_NO_TAX} THEN 'tax' END)")
_REFUSED = f"({_NO_TAX} OR {_NO_QTY} OR {_NO_PRICE})"
_SATISFIES = f"concat_ws(',', CASE WHEN NOT {_REFUSED} THEN 'WIDE' END, CASE WHEN NOT ({_NO_QTY}) THEN 'NARROW' END)"


def _records(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*CARRY, F.expr(_RECORD).alias("record"))


@query("proj_contract_rowwise", f"""SELECT {CARRY_LIST}, NOT {_REFUSED} AS contract_satisfied,
    {_REFUSED} AS needs_review, CASE WHEN {_REFUSED} THEN 'UNKNOWN' END AS threat_class,
    CASE WHEN {_REFUSED} THEN CAST(0 AS DOUBLE) END AS confidence, {_MISSING} AS missing, {_SATISFIES} AS satisfies
  FROM lineitem""")
def _(spark, sf_dir):
    out = rows.rowwise_contract(_records(spark, sf_dir), "record", LINE_SPEC)
    return out.select(*CARRY, "contract_satisfied", "needs_review", "threat_class", "confidence",
                      F.concat_ws(",", "missing_features").alias("missing"),
                      F.concat_ws(",", "satisfies").alias("satisfies"))


@query("proj_profiles_satisfied", f"""SELECT {CARRY_LIST}, {_SATISFIES} AS satisfies, {_MISSING} AS missing
  FROM lineitem""")
def _(spark, sf_dir):
    record = F.col("record")
    return _records(spark, sf_dir).select(
        *CARRY, F.concat_ws(",", rows.profiles_satisfied(record, LINE_SPEC.profiles)).alias("satisfies"),
        F.concat_ws(",", rows.missing_keys(record, LINE_SPEC.features())).alias("missing"))


@query("op_unknown_result", f"""SELECT {CARRY_LIST}, 'UNKNOWN' AS threat_class, CAST(0 AS DOUBLE) AS confidence,
    'INFO' AS severity, FALSE AS is_alertable, TRUE AS needs_review, TRUE AS model_ready,
    FALSE AS contract_satisfied, 'UNKNOWN' AS reliability, {_MISSING} AS missing,
    CASE WHEN {_NO_TAX} THEN 'discount,price,quantity' WHEN {_NO_QTY} THEN 'discount,price,tax'
      ELSE 'discount,quantity,tax' END AS evidence_features FROM lineitem WHERE {_REFUSED}""")
def _(spark, sf_dir):
    checked = rows.rowwise_contract(_records(spark, sf_dir), "record", LINE_SPEC).filter("needs_review")
    refused = checked.select(*CARRY, "record", F.col("missing_features").alias("_missing"))
    out = alerts.unknown_results(refused, "record", reason=F.lit("feature contract not satisfied"), missing=F.col("_missing"),
                          profile="WIDE", contract_ok=F.lit(False), model_ready=True)
    return out.select(*CARRY, "threat_class", "confidence", "severity", "is_alertable", "needs_review", "model_ready",
                      "contract_satisfied", "reliability", F.concat_ws(",", "missing_features").alias("missing"),
                      F.concat_ws(",", F.map_keys("evidence")).alias("evidence_features"))


@query("diff_columns", f"""WITH c(profile, name) AS (VALUES ('WIDE', 'quantity'), ('WIDE', 'price'),
    ('WIDE', 'discount'), ('WIDE', 'tax'), ('NARROW', 'quantity'), ('NARROW', 'discount')),
  p AS (SELECT l_linenumber, l_linestatus, count(*) AS n, any_value({_NO_TAX}) AS a, any_value({_NO_QTY}) AS b,
    any_value({_NO_PRICE}) AS d FROM lineitem GROUP BY 1, 2)
  SELECT profile, name, CAST(sum(n) AS BIGINT) AS n FROM p, c
  WHERE (name = 'tax' AND a) OR (name = 'quantity' AND b) OR (name = 'price' AND d) GROUP BY 1, 2""")
def _(spark, sf_dir):
    record = F.col("record")
    gaps = F.array(*[F.struct(F.lit(p).alias("profile"), F.array_except(
        F.array(*[F.lit(f) for f in feats]), F.map_keys(record)).alias("names"))
        for p, feats in LINE_SPEC.profiles.items()])
    pairs = _records(spark, sf_dir).select(F.explode(gaps).alias("g")).select(
        "g.profile", F.explode("g.names").alias("name"))
    return pairs.groupBy("profile", "name").agg(F.count("*").alias("n"))


# --- identity fields and confidence -----------------------------------------------------
_IP = """CASE l_quantity WHEN 1 THEN NULL WHEN 2 THEN '  ' WHEN 3 THEN 'NaN' WHEN 4 THEN 'none' WHEN 5 THEN '<NA>'
  ELSE concat(' 10.0.', l_linenumber, '.', l_suppkey, ' ') END"""


@query("fn_clean_ip", f"""WITH t AS (SELECT {CARRY_LIST}, {_IP} AS ip FROM lineitem)
  SELECT {CARRY_LIST}, CASE WHEN ip IS NULL OR lower(trim(ip)) IN ('', 'nan', 'none', '<na>') THEN '0.0.0.0'
    ELSE trim(ip) END AS ip FROM t""")
def _(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*CARRY, coerce.clean_ip(F.expr(_IP)).alias("ip"))


@query("fn_optional_str", f"""WITH t AS (SELECT {CARRY_LIST}, {_IP} AS ip FROM lineitem)
  SELECT {CARRY_LIST}, CASE WHEN lower(trim(ip)) NOT IN ('', 'nan', 'none', '<na>') THEN trim(ip) END AS text FROM t""")
def _(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*CARRY, coerce.optional_text(F.expr(_IP)).alias("text"))


_PORT_TEXT = """CASE l_quantity WHEN 1 THEN 'bad' WHEN 2 THEN '70000' WHEN 3 THEN '-5' WHEN 4 THEN 'inf'
  WHEN 5 THEN NULL ELSE CAST(l_extendedprice AS {text}) END"""


@query("fn_clean_port", f"""WITH t AS (SELECT {CARRY_LIST}, {_PORT_TEXT.format(text='VARCHAR')} AS p FROM lineitem),
  n AS (SELECT {CARRY_LIST}, CASE WHEN isfinite(TRY_CAST(p AS DOUBLE)) THEN trunc(TRY_CAST(p AS DOUBLE)) END AS k FROM t)
  SELECT {CARRY_LIST}, CAST(CASE WHEN k BETWEEN 0 AND 65535 THEN k ELSE 0 END AS INTEGER) AS port FROM n""")
def _(spark, sf_dir):
    text = F.expr(_PORT_TEXT.format(text="STRING"))
    return lineitem(spark, sf_dir).select(*CARRY, coerce.clean_port(text).alias("port"))


_CONF_TEXT = """CASE l_quantity WHEN 1 THEN 'junk' WHEN 2 THEN 'NaN' WHEN 3 THEN '1.5' WHEN 4 THEN '-0.2' WHEN 5 THEN NULL
  ELSE CAST(l_discount AS {text}) END"""


@query("fn_clamp_confidence", f"""WITH t AS (SELECT {CARRY_LIST},
    TRY_CAST({_CONF_TEXT.format(text='VARCHAR')} AS DOUBLE) AS c FROM lineitem)
  SELECT {CARRY_LIST}, CASE WHEN c IS NULL OR isnan(c) THEN CAST(0 AS DOUBLE) ELSE least(greatest(c, 0), 1) END
    AS confidence FROM t""")
def _(spark, sf_dir):
    text = F.expr(_CONF_TEXT.format(text="STRING"))
    return lineitem(spark, sf_dir).select(*CARRY, coerce.clamp_confidence(text).alias("confidence"))


_BAND = """CASE WHEN confidence >= 0.9 THEN 'CRITICAL' WHEN confidence >= 0.75 THEN 'HIGH'
  WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"""


@query("fn_severity_band", f"WITH {FLOWS_SQL} SELECT {CARRY_LIST}, confidence, {_BAND} AS band FROM flows")
def _(spark, sf_dir):
    return flows(spark, sf_dir).select(*CARRY, "confidence", sev.band(F.col("confidence")).alias("band"))


_RUNG = """CASE WHEN l_quantity = 1 THEN 'INFO' WHEN l_quantity = 2 THEN 'other' WHEN l_discount >= 0.09 THEN 'CRITICAL'
  WHEN l_discount >= 0.07 THEN 'HIGH' WHEN l_discount >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END"""


@query("fn_escalate", f"""WITH t AS (SELECT {CARRY_LIST}, {_RUNG} AS severity FROM lineitem)
  SELECT {CARRY_LIST}, severity, CASE severity WHEN 'INFO' THEN 'LOW' WHEN 'LOW' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'HIGH'
    WHEN 'HIGH' THEN 'CRITICAL' ELSE severity END AS raised FROM t""")
def _(spark, sf_dir):
    rungs = lineitem(spark, sf_dir).select(*CARRY, F.expr(_RUNG).alias("severity"))
    return rungs.withColumn("raised", sev.escalate(F.col("severity")))


@query("fn_severity_rank", f"""WITH t AS (SELECT {CARRY_LIST}, {_RUNG} AS severity FROM lineitem)
  SELECT {CARRY_LIST}, severity, coalesce(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity), 0) - 1
    AS rank FROM t""")
def _(spark, sf_dir):
    rungs = lineitem(spark, sf_dir).select(*CARRY, F.expr(_RUNG).alias("severity"))
    return rungs.withColumn("rank", sev.ladder_rank(F.col("severity")))


_HEADER = """concat(CASE WHEN l_linenumber = 1 THEN chr(65279) ELSE '' END,
  CASE WHEN l_quantity > 25 THEN '  ' ELSE '' END, 'Flow', CASE WHEN l_linenumber > 4 THEN '   ' ELSE chr(160) END,
  CASE WHEN l_returnflag = 'A' THEN chr(9) ELSE ' ' END, 'Duration', CASE WHEN l_quantity = 3 THEN '.1' ELSE '' END,
  ' ', l_suppkey, CASE WHEN l_quantity < 5 THEN ' ' ELSE '' END)"""


@query("proj_normalise_header", f"""SELECT {CARRY_LIST}, trim(regexp_replace(replace(replace({_HEADER}, chr(65279), ''),
  chr(160), ' '), '\\s+', ' ', 'g')) AS name FROM lineitem""")
def _(spark, sf_dir):
    # Spark's chr() stops at one byte, so the two special characters are spelled out.
    text = _HEADER.replace("chr(65279)", "'\ufeff'").replace("chr(160)", "'\u00a0'")
    return lineitem(spark, sf_dir).select(*CARRY, naming.canonical_header(F.expr(text)).alias("name"))
