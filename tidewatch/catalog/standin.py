"""Stand-in flow tables derived from the given tables, in Spark and in SQL.

``lineitem`` and ``orders`` play the flow records; every row takes part. Input
preparation is stated once, as expressions both engines read; everything after
it is expressed twice, by the operators in Spark and by hand in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import cic
from tidewatch.operators import verdict
from tidewatch.operators.evidence import class_medians, medians_dict
from tidewatch.plans import train as training
from tidewatch.session import materialize, per_table, spread
from tidewatch.spec import DistributionReference, EvidencePolicy, FlowSpec, Rule, TrainingPolicy

SEED = 42
QUANTILE = 0.05
CARRY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
CLASSES = ("BENIGN", "DDoS", "PortScan", "Botnet")

LINE_SPEC = FlowSpec(
    name="lineitem",
    profiles={"WIDE": ("quantity", "price", "discount", "tax"), "NARROW": ("quantity", "discount")},
    default_profile="WIDE", label_column="label", label_map=cic.LABEL_MAP, classes=CLASSES,
    identity=("src", "seen_at"), timestamp_column="seen_at")
LINE_FEATURES = LINE_SPEC.profiles["WIDE"]

ORDER_SPEC = FlowSpec(
    name="orders", profiles={"ORDERS": ("total", "cust", "yday")}, default_profile="ORDERS",
    label_column="truth", label_map=cic.LABEL_MAP, classes=CLASSES, identity=("o_custkey",))
ORDER_FEATURES = ORDER_SPEC.profiles["ORDERS"]

# --- raw text rows, with cells of every kind of damage ----------------------------
EMPTY = "(l_quantity = 8 AND l_linenumber = 5)"
LABEL = """CASE WHEN l_quantity = 9 AND l_linenumber = 6 THEN NULL
  WHEN l_quantity = 10 THEN 'Heartbleed' WHEN l_quantity = 11 AND l_linenumber = 7 THEN 'Mystery'
  WHEN l_returnflag = 'N' THEN ' BENIGN' WHEN l_returnflag = 'R' THEN 'DDoS '
  WHEN l_linestatus = 'F' THEN 'Bot' ELSE 'PortScan' END"""
RAW_COLUMNS = {
    "src": "CAST(l_suppkey AS {text})",
    "seen_at": "CAST(CAST(l_shipdate AS DATE) AS {text})",
    "quantity": """CASE WHEN l_quantity = 1 AND l_linenumber = 1 THEN 'Infinity'
      WHEN l_quantity = 2 AND l_linenumber = 1 THEN 'x' WHEN l_quantity = 3 AND l_linenumber = 2 THEN ''
      WHEN l_quantity = 4 AND l_linenumber = 2 THEN NULL ELSE CAST(l_quantity AS {text}) END""",
    "price": """CASE WHEN l_quantity = 5 AND l_linenumber = 3 THEN 'NaN'
      WHEN l_quantity = 6 AND l_linenumber = 3 THEN '1e39'
      ELSE CAST(floor(l_extendedprice / 20000.0) * 20000.0 AS {text}) END""",
    "discount": "CASE WHEN l_quantity = 7 AND l_linenumber = 4 THEN '-inf' ELSE CAST(l_discount AS {text}) END",
    "tax": "CAST(l_tax AS {text})",
    "label": LABEL,
}


def _raw_select(text: str, double: str) -> list[str]:
    out = []
    for name, expression in RAW_COLUMNS.items():
        body = expression.format(text=text)
        if name == "price":
            body = body.replace("CAST(floor", f"CAST(CAST(floor").replace("* 20000.0 AS", f"* 20000.0 AS {double}) AS")
        out.append(f"CASE WHEN {EMPTY} THEN NULL ELSE {body} END AS {name}")
    return out


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows in the shape a flow CSV is read in."""
    return spread(lineitem(spark, sf_dir)).selectExpr(*CARRY, *_raw_select("STRING", "DOUBLE"))


RAW_SQL = f"raw AS (SELECT {', '.join(CARRY)}, {', '.join(_raw_select('VARCHAR', 'DOUBLE'))} FROM lineitem)"

# --- lineitem as typed, predicted flows ---------------------------------------------
FLOW_COLUMNS = (
    "CAST(l_quantity AS DOUBLE) AS quantity", "CAST(l_extendedprice AS DOUBLE) AS price",
    "CAST(l_discount AS DOUBLE) AS discount", "CAST(l_tax AS DOUBLE) AS tax",
    """CASE WHEN l_quantity = 10 THEN 'Heartbleed' WHEN l_quantity = 11 THEN 'DoS Hulk'
      WHEN l_returnflag = 'N' THEN 'BENIGN' WHEN l_returnflag = 'R' THEN 'DDoS'
      WHEN l_linestatus = 'F' THEN 'Botnet' ELSE 'PortScan' END AS truth""",
    """CASE WHEN l_quantity > 38 THEN 'DDoS' WHEN l_quantity > 30 THEN 'PortScan'
      WHEN l_quantity > 25 THEN 'Botnet' ELSE 'BENIGN' END AS model_prediction""",
    "least(CAST(1.0 AS DOUBLE), CAST(l_discount AS DOUBLE) * 10) AS confidence",
)


def flows(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """``heavy`` is for work per row that outweighs dealing the rows out."""
    table = lineitem(spark, sf_dir)
    return (spread(table) if heavy else table).selectExpr(*CARRY, *FLOW_COLUMNS)


FLOWS_SQL = f"flows AS (SELECT {', '.join(CARRY)}, {', '.join(FLOW_COLUMNS)} FROM lineitem)"

# --- orders as typed, predicted flows -----------------------------------------------
ORDER_COLUMNS = (
    "o_orderkey AS seq", "o_custkey", "CAST(o_totalprice AS DOUBLE) AS total", "CAST(o_custkey AS DOUBLE) AS cust",
    "CAST(dayofyear(o_orderdate) AS DOUBLE) AS yday",
    """CASE o_orderpriority WHEN '1-URGENT' THEN 'DDoS' WHEN '2-HIGH' THEN 'PortScan'
      WHEN '3-MEDIUM' THEN 'Botnet' ELSE 'BENIGN' END AS truth""",
    """CASE WHEN o_orderstatus = 'F' THEN 'BENIGN' WHEN o_orderstatus = 'O' THEN 'DDoS'
      WHEN o_totalprice > 250000 THEN 'PortScan' ELSE 'Botnet' END AS model_prediction""",
    "least(CAST(1.0 AS DOUBLE), CAST(o_totalprice AS DOUBLE) / 500000) AS confidence",
)


def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*ORDER_COLUMNS)


ORDERS_SQL = f"flows AS (SELECT {', '.join(ORDER_COLUMNS)} FROM orders)"

# --- references: small fitted artefacts, kept per table folder ------------------------
def split_flows(df: DataFrame, spec: FlowSpec, key: tuple[str, ...]) -> DataFrame:
    return training.split(df, spec, TrainingPolicy(seed=SEED), key, target="truth")


def fitted(df: DataFrame, spec: FlowSpec, features: tuple[str, ...], key: tuple[str, ...],
           quantile: float = QUANTILE) -> DistributionReference:
    train = split_flows(df, spec, key).filter(~F.col("is_test"))
    bounds = training.quantile_bounds(train, features, quantile)
    return training.reference_from(bounds, features, quantile)


@per_table("lineitem")
def line_reference(spark: SparkSession, sf_dir: str) -> DistributionReference:
    return fitted(flows(spark, sf_dir), LINE_SPEC, LINE_FEATURES, CARRY)


@per_table("orders")
def order_reference(spark: SparkSession, sf_dir: str) -> DistributionReference:
    return fitted(order_flows(spark, sf_dir), ORDER_SPEC, ORDER_FEATURES, ("seq",))


def assessed(spark: SparkSession, sf_dir: str, detail: bool = False) -> DataFrame:
    return verdict.assess(flows(spark, sf_dir, heavy=detail), line_reference(spark, sf_dir), detail=detail)


@per_table("orders")
def order_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stored alert table: verdict, flow id, truth and correctness."""
    rows = verdict.assess(order_flows(spark, sf_dir), order_reference(spark, sf_dir))
    rows = rows.withColumns({
        "flow_id": F.format_string("F%06d", "seq"), "threat_class": F.col("reported_threat"),
        "ground_truth": F.col("truth"), "correct": verdict.correct(F.col("truth"), F.col("model_prediction"))})
    return materialize(rows, "order-alerts")


def split_sql(key: tuple[str, ...]) -> str:
    texts = ", ".join(f"CAST({c} AS VARCHAR)" for c in key)
    keys = ", ".join(key)
    domain = ", ".join(f"'{c}'" for c in CLASSES)
    return f"""hashed AS (SELECT *, md5(concat_ws('|', '{SEED}', {texts})) AS h FROM flows),
    splits AS (SELECT *, truth IN ({domain}) AND row_number() OVER (PARTITION BY truth ORDER BY h, {keys})
      <= CAST(round(0.25 * count(*) OVER (PARTITION BY truth)) AS BIGINT) AS is_test FROM hashed)"""


def bounds_sql(features: tuple[str, ...]) -> str:
    cols = ", ".join(f"quantile_cont({f}, {QUANTILE}) AS {f}_lo, quantile_cont({f}, {1 - QUANTILE}) AS {f}_hi, "
                     f"quantile_cont({f}, 0.5) AS {f}_med" for f in features)
    return f"b AS (SELECT {cols} FROM splits WHERE NOT is_test)"


def severity_sql(threat: str, confidence: str, tier: str) -> str:
    """Columns severity, base_severity, escalated, is_alertable, needs_review."""
    level = (f"CASE WHEN {confidence} >= 0.9 THEN 'CRITICAL' WHEN {confidence} >= 0.75 THEN 'HIGH' "
             f"WHEN {confidence} >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END")
    up = (f"CASE WHEN {confidence} >= 0.75 THEN 'CRITICAL' WHEN {confidence} >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END")
    esc = f"{threat} IN ('DDoS', 'Botnet')"
    final = f"CASE WHEN {esc} THEN {up} ELSE {level} END"
    off = f"{tier} = 'UNRELIABLE'"
    calm = f"{threat} = 'BENIGN'"
    return f"""CASE WHEN {off} THEN 'HIGH' WHEN {calm} THEN 'INFO' ELSE {final} END AS severity,
      CASE WHEN {off} THEN 'HIGH' WHEN {calm} THEN 'INFO' ELSE {level} END AS base_severity,
      CASE WHEN {off} OR {calm} THEN FALSE ELSE {esc} AND {confidence} < 0.9 END AS escalated,
      CASE WHEN {off} THEN TRUE WHEN {calm} THEN FALSE ELSE ({final}) <> 'LOW' END AS is_alertable,
      {tier} IN ('UNRELIABLE', 'DEGRADED') AS needs_review"""


def assessed_sql(features: tuple[str, ...]) -> str:
    out = {f: f"({f} > {f}_hi OR {f} < {f}_lo)" for f in features}
    count = " + ".join(f"CAST({c} AS INTEGER)" for c in out.values())
    worst = ", ".join(f"CASE WHEN {f} > {f}_hi THEN ({f} - {f}_hi) / greatest({f}_hi - {f}_lo, 1e-9) "
                      f"WHEN {f} < {f}_lo THEN ({f}_lo - {f}) / greatest({f}_hi - {f}_lo, 1e-9) ELSE 0 END"
                      for f in features)
    return f"""v AS (SELECT flows.*, b.*, {count} AS n_violations, greatest({worst}) AS worst_excursion FROM flows, b),
    t AS (SELECT *, CASE WHEN n_violations >= 2 THEN 'UNRELIABLE' WHEN n_violations = 1 THEN 'DEGRADED'
        ELSE 'RELIABLE' END AS reliability,
      CASE WHEN n_violations = 0 THEN 0.0 ELSE least(0.5 * least(n_violations / {float(len(features))}, 1.0)
        + 0.5 * least(worst_excursion / 10.0, 1.0) + 0.25, 1.0) END AS ood_score FROM v),
    r AS (SELECT *, n_violations < 2 AS in_distribution,
      CASE WHEN reliability = 'UNRELIABLE' THEN 'UNKNOWN_OOD' ELSE model_prediction END AS reported_threat FROM t),
    a AS (SELECT *, {severity_sql('reported_threat', 'confidence', 'reliability')} FROM r)"""


LINE_SPLIT_SQL = f"{FLOWS_SQL}, {split_sql(CARRY)}, {bounds_sql(LINE_FEATURES)}"
LINE_SQL = f"WITH {LINE_SPLIT_SQL}, {assessed_sql(LINE_FEATURES)}"
ORDER_SQL = f"""WITH {ORDERS_SQL}, {split_sql(('seq',))}, {bounds_sql(ORDER_FEATURES)}, {assessed_sql(ORDER_FEATURES)},
  alerts AS (SELECT *, printf('F%06d', seq) AS flow_id, reported_threat AS threat_class, truth AS ground_truth,
    truth = model_prediction AS correct FROM a)"""

# --- cleaning in SQL ---------------------------------------------------------------
NUMBER = "CASE WHEN isfinite(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END"
MAPPED = """CASE trim(label) WHEN 'BENIGN' THEN 'BENIGN' WHEN 'DDoS' THEN 'DDoS' WHEN 'PortScan' THEN 'PortScan'
  WHEN 'Bot' THEN 'Botnet' END"""
_RETAINED = ("src", "seen_at", "discount", "price", "quantity", "tax", "label")
_EMPTY = " AND ".join(f"{c} IS NULL" for c in _RETAINED)
TEXT_SQL = f"""{RAW_SQL}, texts AS (SELECT {', '.join(CARRY)},
  {', '.join(f"CASE WHEN {c} NOT IN ('', 'NaN') THEN {c} END AS {c}" for c in _RETAINED)} FROM raw)"""
PREPARED_SQL = f"""{TEXT_SQL}, prepared AS (SELECT {', '.join(CARRY)}, src, seen_at AS capture_timestamp,
  {', '.join(f"{NUMBER.format(c=c)} AS {c}" for c in ('discount', 'price', 'quantity', 'tax'))},
  {MAPPED} AS threat_class FROM texts WHERE NOT ({_EMPTY}) AND label IS NOT NULL AND {MAPPED} IS NOT NULL)"""
DEDUP_SQL = f"""{PREPARED_SQL}, dedup AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY discount, price, quantity, tax, threat_class ORDER BY {', '.join(CARRY)}) AS rn FROM prepared)
  WHERE rn = 1)"""
COMPLETE_SQL = f"""{DEDUP_SQL}, complete AS (SELECT * FROM dedup WHERE quantity IS NOT NULL AND price IS NOT NULL
  AND discount IS NOT NULL AND tax IS NOT NULL)"""

# --- evidence of the stand-in --------------------------------------------------------
LINE_RULES = {
    "PortScan": (Rule("quantity", "high", "quantity far above benign"), Rule("tax", "low", "tax next to none"),
                 Rule("discount", "near", "discount as in scans")),
    "DDoS": (Rule("price", "high", "price far above benign"), Rule("quantity", "near", "quantity as in floods"),
             Rule("discount", "low", "discount next to none"), Rule("tax", "near", "tax as in floods"),
             Rule("quantity", "high", "quantity far above benign")),
    "Botnet": (Rule("price", "low", "price far below benign"), Rule("tax", "high", "tax far above benign")),
    "BENIGN": (Rule("price", "near", "price as usual"), Rule("quantity", "near", "quantity as usual"),
               Rule("discount", "near", "discount as usual")),
}
LINE_IMPORTANCES = {"price": 0.4, "quantity": 0.3, "discount": 0.2, "tax": 0.1}


@per_table("lineitem")
def line_evidence(spark: SparkSession, sf_dir: str) -> EvidencePolicy:
    medians = class_medians(flows(spark, sf_dir), LINE_FEATURES, "truth", CLASSES)
    return EvidencePolicy(rules=LINE_RULES, medians=medians_dict(medians), aggregate_notes=cic.NOTES)


ORDER_RULES = {
    "PortScan": (Rule("total", "low", "total far below benign"), Rule("yday", "near", "season as in scans")),
    "DDoS": (Rule("total", "high", "total far above benign"), Rule("cust", "near", "customers as in floods"),
             Rule("yday", "low", "early in the year")),
    "Botnet": (Rule("cust", "low", "old customers"), Rule("total", "near", "total as in botnets")),
    "BENIGN": (Rule("total", "near", "total as usual"), Rule("yday", "near", "season as usual")),
}
ORDER_IMPORTANCES = {"total": 0.5, "cust": 0.3, "yday": 0.2}


@per_table("orders")
def order_evidence(spark: SparkSession, sf_dir: str) -> EvidencePolicy:
    medians = class_medians(order_flows(spark, sf_dir), ORDER_FEATURES, "truth", CLASSES)
    return EvidencePolicy(rules=ORDER_RULES, medians=medians_dict(medians), aggregate_notes=cic.NOTES)
