"""Cleaning, sampling and quality queries over raw lineitem text rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.standin import (CARRY, CLASSES, COMPLETE_SQL, DEDUP_SQL, FLOWS_SQL, LINE_FEATURES, LINE_SPEC,
                                       LINE_SPLIT_SQL, MAPPED, NUMBER, ORDERS_SQL, PREPARED_SQL, RAW_SQL, SEED,
                                       TEXT_SQL, flows, order_flows, raw, split_flows)
from tidewatch.functions.coerce import coerce_feature, to_numeric
from tidewatch.operators import quality, rows, sampling
from tidewatch.operators.evidence import class_medians
from tidewatch.plans import clean as cleaning
from tidewatch.plans import train as training
from tidewatch.spec import TARGET, TrainingPolicy

CARRY_LIST = ", ".join(CARRY)
FEATURES = ("discount", "price", "quantity", "tax")
RETAINED = LINE_SPEC.retained


def _texts(spark, sf_dir):
    return quality.nulls_for_na(raw(spark, sf_dir), RETAINED)


def _prepared(spark, sf_dir):
    return cleaning.prepared(raw(spark, sf_dir), LINE_SPEC, CARRY)


def _distinct(spark, sf_dir):
    return cleaning.deduplicated(_prepared(spark, sf_dir), LINE_SPEC, CARRY)


def _complete(spark, sf_dir):
    return cleaning.usable(_distinct(spark, sf_dir), LINE_SPEC)


# --- projections -----------------------------------------------------------------

@query("proj_prune", f"WITH {RAW_SQL} SELECT src, seen_at, quantity, price, discount, tax, label FROM raw")
def _(spark, sf_dir):
    return quality.prune(raw(spark, sf_dir), LINE_SPEC)


@query("proj_rename_capture_ts", f"WITH {RAW_SQL} SELECT {CARRY_LIST}, src, seen_at AS capture_timestamp, quantity, "
       "price, discount, tax, label FROM raw")
def _(spark, sf_dir):
    return quality.rename_capture(raw(spark, sf_dir), LINE_SPEC)


@query("proj_stable_order", f"WITH {PREPARED_SQL} SELECT src, capture_timestamp, discount, price, quantity, tax, "
       "threat_class FROM prepared")
def _(spark, sf_dir):
    return quality.stable_order(_prepared(spark, sf_dir).drop(*CARRY), LINE_SPEC)


@query("proj_split_identity", f"""WITH {PREPARED_SQL} SELECT quantity, price, discount, tax, src, capture_timestamp
  FROM prepared""")
def _(spark, sf_dir):
    both = rows.split_identity(_prepared(spark, sf_dir), LINE_SPEC)
    return both.select("features.*", "identity.*")


@query("proj_contract", f"WITH {PREPARED_SQL} SELECT quantity, price, discount, tax FROM prepared")
def _(spark, sf_dir):
    return rows.contract(_prepared(spark, sf_dir), LINE_FEATURES)


@query("proj_zero_fill", f"""WITH {TEXT_SQL}, n AS (SELECT {CARRY_LIST},
    {', '.join(f"{NUMBER.format(c=c)} AS {c}" for c in FEATURES)} FROM texts)
  SELECT {CARRY_LIST}, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in FEATURES)},
    concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in LINE_FEATURES)}) AS missing,
    NOT (quantity IS NULL AND price IS NULL AND discount IS NULL AND tax IS NULL) AS usable FROM n""")
def _(spark, sf_dir):
    typed = quality.typed(_texts(spark, sf_dir), FEATURES)
    filled = rows.zero_fill(typed, LINE_FEATURES)
    return filled.select(*CARRY, *FEATURES, F.concat_ws(",", "missing_features").alias("missing"),
                         F.col("model_ready_input").alias("usable"))


# --- filters -----------------------------------------------------------------------
_EMPTY = " AND ".join(f"{c} IS NULL" for c in RETAINED)


@query("filter_empty_rows", f"WITH {TEXT_SQL} SELECT {CARRY_LIST}, {', '.join(RETAINED)} FROM texts WHERE NOT ({_EMPTY})")
def _(spark, sf_dir):
    return quality.drop_empty(_texts(spark, sf_dir), RETAINED)


@query("filter_missing_label", f"WITH {TEXT_SQL} SELECT {CARRY_LIST}, label FROM texts WHERE label IS NOT NULL")
def _(spark, sf_dir):
    return quality.drop_unlabelled(_texts(spark, sf_dir), "label").select(*CARRY, "label")


@query("filter_unmapped_label", f"""WITH {TEXT_SQL} SELECT {CARRY_LIST}, {MAPPED} AS threat_class FROM texts
  WHERE {MAPPED} IS NOT NULL""")
def _(spark, sf_dir):
    return quality.labelled(_texts(spark, sf_dir), LINE_SPEC).select(*CARRY, TARGET)


@query("filter_null_features", f"WITH {COMPLETE_SQL} SELECT * FROM complete")
def _(spark, sf_dir):
    return _complete(spark, sf_dir)


@query("filter_scoreable", f"""WITH {TEXT_SQL}, n AS (SELECT {CARRY_LIST}, {NUMBER.format(c='quantity')} AS quantity,
    {NUMBER.format(c='discount')} AS discount FROM texts)
  SELECT * FROM n WHERE quantity IS NOT NULL AND discount IS NOT NULL""")
def _(spark, sf_dir):
    narrow = LINE_SPEC.features("NARROW")
    return quality.scoreable(_texts(spark, sf_dir), narrow).select(*CARRY, *narrow)


@query("filter_scoreable_counts", f"""WITH {TEXT_SQL}, n AS (SELECT {NUMBER.format(c='quantity')} AS quantity,
    {NUMBER.format(c='discount')} AS discount FROM texts)
  SELECT count(*) AS rows_read, count(*) FILTER (quantity IS NOT NULL AND discount IS NOT NULL) AS rows_scored,
    count(*) FILTER (quantity IS NULL OR discount IS NULL) AS rows_dropped,
    round(count(*) FILTER (quantity IS NULL OR discount IS NULL) / count(*), 8) AS dropped_share FROM n""")
def _(spark, sf_dir):
    out = quality.scoreable_counts(_texts(spark, sf_dir), LINE_SPEC.features("NARROW"))
    return out.withColumn("dropped_share", F.round("dropped_share", 8))


@query("check_finite", f"""WITH {TEXT_SQL}, n AS (SELECT {', '.join(
    f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)} FROM texts), c AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL OR NOT isfinite({c})) AS rows FROM n"
                      for c in FEATURES)})
  SELECT * FROM c WHERE rows > 0""")
def _(spark, sf_dir):
    numbers = _texts(spark, sf_dir).select(*[F.col(c).try_cast("double").alias(c) for c in FEATURES])
    return quality.nonfinite_counts(numbers, FEATURES)


@query("filter_exclude_benign", f"WITH {FLOWS_SQL} SELECT {CARRY_LIST}, truth FROM flows WHERE truth <> 'BENIGN'")
def _(spark, sf_dir):
    return flows(spark, sf_dir).filter(F.col("truth") != LINE_SPEC.benign).select(*CARRY, "truth")


# --- distinct, sampling, splitting ---------------------------------------------------

@query("distinct_flows", f"WITH {DEDUP_SQL} SELECT * FROM dedup")
def _(spark, sf_dir):
    return _distinct(spark, sf_dir)


_KEY_TEXT = ", ".join(f"CAST({c} AS VARCHAR)" for c in CARRY)


def _capped_sql(cap: int) -> str:
    return f"""{COMPLETE_SQL}, capped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
      PARTITION BY threat_class ORDER BY md5(concat_ws('|', '{SEED}', {_KEY_TEXT}))) AS rn FROM complete)
    WHERE rn <= {cap})"""


CAP = 2_000


@query("sample_class_cap", f"WITH {_capped_sql(CAP)} SELECT * FROM capped")
def _(spark, sf_dir):
    return sampling.class_cap(_complete(spark, sf_dir), TARGET, CARRY, CAP, SEED, CLASSES)


@query("sample_class_cap_counting", f"WITH {_capped_sql(CAP)} SELECT * FROM capped")
def _(spark, sf_dir):
    return sampling.class_cap(_complete(spark, sf_dir), TARGET, CARRY, CAP, SEED, CLASSES)


_ORDER_HASH = f"md5(concat_ws('|', '{SEED}', CAST(seq AS VARCHAR)))"


@query("sample_shuffle", f"WITH {ORDERS_SQL} SELECT seq, total, truth FROM flows ORDER BY {_ORDER_HASH}, seq")
def _(spark, sf_dir):
    return sampling.shuffled(order_flows(spark, sf_dir), ["seq"], SEED).select("seq", "total", "truth")


@query("split_stratified", f"WITH {LINE_SPLIT_SQL} SELECT {CARRY_LIST}, truth, is_test FROM splits")
def _(spark, sf_dir):
    return split_flows(flows(spark, sf_dir), LINE_SPEC, CARRY).select(*CARRY, "truth", "is_test")


@query("split_stratified_counting", f"WITH {LINE_SPLIT_SQL} SELECT {CARRY_LIST}, truth, is_test FROM splits")
def _(spark, sf_dir):
    out = sampling.stratified_split(flows(spark, sf_dir), "truth", CARRY, 0.25, SEED, CLASSES)
    return out.select(*CARRY, "truth", "is_test")


@query("limit_first_n", f"WITH {ORDERS_SQL} SELECT seq, total, truth FROM flows ORDER BY seq LIMIT 1000")
def _(spark, sf_dir):
    return order_flows(spark, sf_dir).select("seq", "total", "truth").orderBy("seq").limit(1_000)


# --- counters ------------------------------------------------------------------------

@query("agg_dropped_labels", f"""WITH {TEXT_SQL} SELECT trim(label) AS label, count(*) AS rows,
    CASE WHEN trim(label) = 'Heartbleed' THEN 'out of scope' ELSE 'not in label map' END AS reason
  FROM texts WHERE label IS NOT NULL AND {MAPPED} IS NULL GROUP BY 1, 3""")
def _(spark, sf_dir):
    return quality.dropped_labels(_texts(spark, sf_dir), LINE_SPEC)


@query("agg_null_attribution", f"""WITH {DEDUP_SQL}, c AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS rows FROM dedup" for c in FEATURES)})
  SELECT * FROM c WHERE rows > 0""")
def _(spark, sf_dir):
    return quality.null_attribution(_distinct(spark, sf_dir), FEATURES)


_JUNK = " + ".join(f"CAST({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL AS BIGINT)" for c in FEATURES)
_INF = " + ".join(f"CAST(coalesce(isinf(TRY_CAST({c} AS DOUBLE)), FALSE) AS BIGINT)" for c in FEATURES)


@query("agg_quality_counters", f"""WITH {TEXT_SQL}, f AS (SELECT ({_EMPTY}) AS e, label,
    {MAPPED} AS cls, {_JUNK} AS junk, {_INF} AS inf FROM texts)
  SELECT count(*) AS rows_in, count(*) FILTER (e) AS empty_rows,
    count(*) FILTER (NOT e AND label IS NULL) AS missing_label,
    CAST(sum(junk) FILTER (NOT e AND label IS NOT NULL) AS BIGINT) AS non_numeric_cells,
    CAST(sum(inf) FILTER (NOT e AND label IS NOT NULL) AS BIGINT) AS infinite_cells,
    count(*) FILTER (NOT e AND label IS NOT NULL AND cls IS NULL) AS unmapped_labels,
    count(*) FILTER (NOT e AND label IS NOT NULL AND cls IS NOT NULL) AS rows_kept FROM f""")
def _(spark, sf_dir):
    return quality.quality_counters(_texts(spark, sf_dir), LINE_SPEC)


@query("agg_numeric_health", f"""WITH {TEXT_SQL}, c AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NULL) AS missing, "
    f"count(*) FILTER (isinf(TRY_CAST({c} AS DOUBLE))) AS infinite, "
    f"count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NULL AND {c} IS NOT NULL) AS non_numeric FROM texts"
    for c in FEATURES)}) SELECT * FROM c WHERE missing + infinite + non_numeric > 0""")
def _(spark, sf_dir):
    return quality.numeric_health(_texts(spark, sf_dir), FEATURES)


_VERDICT = f"""CASE WHEN trim(label) = 'Heartbleed' THEN 'dropped: out of scope'
  WHEN {MAPPED} IS NULL THEN 'dropped: not in label map' WHEN {MAPPED} = label THEN 'kept'
  ELSE 'renamed: ' || {MAPPED} END"""


@query("agg_label_profile", f"""WITH {TEXT_SQL}, c AS (SELECT label, count(*) AS rows, {_VERDICT} AS verdict,
    {MAPPED} AS cls FROM texts WHERE label IS NOT NULL GROUP BY label)
  SELECT label, rows, verdict, round(sum(CASE WHEN cls IS NOT NULL THEN rows ELSE 0 END) OVER ()
    / sum(rows) OVER (), 8) AS kept_share FROM c""")
def _(spark, sf_dir):
    return quality.label_profile(_texts(spark, sf_dir), LINE_SPEC).withColumn("kept_share", F.round("kept_share", 8))


@query("agg_class_distribution", f"""WITH {FLOWS_SQL}, c AS (SELECT truth AS class, count(*) AS rows FROM flows
    GROUP BY 1), d AS (SELECT unnest(['BENIGN', 'DDoS', 'PortScan', 'Botnet']) AS class)
  SELECT coalesce(d.class, c.class) AS class, coalesce(rows, 0) AS rows,
    round(coalesce(rows, 0) / sum(coalesce(rows, 0)) OVER (), 8) AS share, d.class IS NULL AS unexpected
  FROM d FULL JOIN c ON d.class = c.class""")
def _(spark, sf_dir):
    out = quality.class_distribution(flows(spark, sf_dir), LINE_SPEC, "truth")
    return out.withColumn("share", F.round("share", 8))


@query("agg_dataset_summary", f"""WITH {TEXT_SQL}, c AS (SELECT {MAPPED} AS class, count(*) AS rows FROM texts
    WHERE {MAPPED} IS NOT NULL GROUP BY 1)
  SELECT class, rows, round(rows / sum(rows) OVER (), 8) AS share,
    class = first_value(class) OVER (ORDER BY rows, class) AS is_rarest,
    min(rows) OVER () / sum(rows) OVER () < 0.05 AS imbalanced FROM c""")
def _(spark, sf_dir):
    return quality.dataset_summary(_texts(spark, sf_dir), LINE_SPEC).withColumn("share", F.round("share", 8))


_WIDE = ("quantity", "price", "discount", "tax")


@query("agg_class_medians", f"""WITH {FLOWS_SQL} {' UNION ALL '.join(
    f"SELECT truth AS class, '{c}' AS feature, count({c}) AS n, round(quantile_cont({c}, 0.5), 6) AS median FROM flows "
    f"WHERE truth IN ('BENIGN', 'DDoS', 'PortScan', 'Botnet') GROUP BY 1" for c in _WIDE)}""")
def _(spark, sf_dir):
    out = class_medians(flows(spark, sf_dir), _WIDE, "truth", CLASSES)
    return out.withColumn("median", F.round("median", 6))


_BOUNDS = f"""WITH {LINE_SPLIT_SQL} {' UNION ALL '.join(
    f"SELECT '{c}' AS feature, round({c}_lo, 6) AS lower, round({c}_hi, 6) AS upper, round({c}_med, 6) AS median, "
    f"(SELECT count(*) FROM splits WHERE NOT is_test) AS n FROM b" for c in _WIDE)}"""


def _bounds(spark, sf_dir):
    train = split_flows(flows(spark, sf_dir), LINE_SPEC, CARRY).filter(~F.col("is_test"))
    out = training.quantile_bounds(train, LINE_FEATURES, 0.05)
    return out.withColumns({c: F.round(c, 6) for c in ("lower", "upper", "median")})


@query("agg_quantile_bounds", _BOUNDS)
def _(spark, sf_dir):
    return _bounds(spark, sf_dir)


@query("agg_quantile_bounds_counting", _BOUNDS)
def _(spark, sf_dir):
    return _bounds(spark, sf_dir)


@query("sink_clean_audit", f"""WITH {_capped_sql(CAP)}, t AS (SELECT ({_EMPTY}) AS e, label, {MAPPED} AS cls,
    {_JUNK} AS junk, {_INF} AS inf FROM texts)
  SELECT 'rows_in' AS step, '' AS detail, count(*) AS rows FROM t
  UNION ALL SELECT 'empty_rows', '', count(*) FROM t WHERE e
  UNION ALL SELECT 'missing_label', '', count(*) FROM t WHERE NOT e AND label IS NULL
  UNION ALL SELECT 'non_numeric_cells', '', CAST(sum(junk) AS BIGINT) FROM t WHERE NOT e AND label IS NOT NULL
  UNION ALL SELECT 'infinite_cells', '', CAST(sum(inf) AS BIGINT) FROM t WHERE NOT e AND label IS NOT NULL
  UNION ALL SELECT 'unmapped_labels', '', count(*) FROM t WHERE NOT e AND label IS NOT NULL AND cls IS NULL
  UNION ALL SELECT 'rows_kept', '', count(*) FROM t WHERE NOT e AND label IS NOT NULL AND cls IS NOT NULL
  UNION ALL SELECT 'distinct_rows', '', count(*) FROM dedup
  UNION ALL SELECT 'unusable_rows', '', (SELECT count(*) FROM dedup) - (SELECT count(*) FROM complete)
  UNION ALL SELECT 'dropped_label', trim(label), count(*) FROM t WHERE label IS NOT NULL AND cls IS NULL GROUP BY 2
  UNION ALL SELECT 'written', threat_class, count(*) FROM capped GROUP BY 2""")
def _(spark, sf_dir):
    return cleaning.clean(raw(spark, sf_dir), LINE_SPEC, TrainingPolicy(class_cap=CAP, seed=SEED), CARRY).audit


# --- numbers from text -----------------------------------------------------------------

@query("fn_to_numeric", f"WITH {TEXT_SQL} SELECT {CARRY_LIST}, {', '.join(
    f'{NUMBER.format(c=c)} AS {c}' for c in FEATURES)} FROM texts")
def _(spark, sf_dir):
    return _texts(spark, sf_dir).select(*CARRY, *[to_numeric(F.col(c)).alias(c) for c in FEATURES])


@query("fn_coerce_feature", f"""WITH {RAW_SQL} SELECT {CARRY_LIST}, {', '.join(
    f"CASE WHEN abs(TRY_CAST({c} AS DOUBLE)) <= 3.0e38 THEN TRY_CAST({c} AS DOUBLE) END AS {c}"
    for c in FEATURES)} FROM raw""")
def _(spark, sf_dir):
    return raw(spark, sf_dir).select(*CARRY, *[coerce_feature(F.col(c)).alias(c) for c in FEATURES])


@query("union_files", f"""WITH {FLOWS_SQL} SELECT l_orderkey AS key, quantity, price, truth,
    CAST(NULL AS DOUBLE) AS total FROM flows
  UNION ALL SELECT o_orderkey, NULL, NULL, o_orderpriority, o_totalprice FROM orders""")
def _(spark, sf_dir):
    lines = flows(spark, sf_dir).select(F.col("l_orderkey").alias("key"), "quantity", "price", "truth")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("truth"))
    return lines.unionByName(orders, allowMissingColumns=True)


@query("sequence_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders")
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return rows.with_sequence(orders, "o_orderkey")


@query("fn_flow_id", """SELECT o_orderkey, printf('F%06d', row_number() OVER (ORDER BY o_orderkey)) AS stream_id,
  printf('S%06d', row_number() OVER (ORDER BY o_orderkey) - 1) AS batch_id,
  printf('F%06d', o_orderkey + 999990) AS long_id FROM orders""")
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    numbered = rows.with_sequence(orders, "o_orderkey")
    return numbered.select("o_orderkey", rows.flow_id(F.col("seq"), "F").alias("stream_id"),
                           rows.flow_id(F.col("seq") - 1, "S").alias("batch_id"),
                           rows.flow_id(F.col("o_orderkey") + 999_990, "F").alias("long_id"))
