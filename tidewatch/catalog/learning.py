"""Model queries: forest, novelty detector, artefacts, comparison of profiles.

The class of a flow is a stated function of its features here, so a right forest
answers every flow as SQL does; forests have the policy's default size.
"""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.standin import CARRY, FLOW_COLUMNS, CLASSES, LINE_FEATURES, LINE_SPEC, ORDER_SPEC, SEED, lineitem, order_flows
from tidewatch.operators import evaluation, forest, novelty
from tidewatch.plans import score
from tidewatch.plans import train as training
from tidewatch.session import materialize, per_table, scratch_path, spread
from tidewatch.spec import TARGET, NoveltyPolicy, TrainingPolicy

CARRY_LIST = ", ".join(CARRY)
POLICY = TrainingPolicy(class_cap=None, seed=SEED)
NOVELTY = NoveltyPolicy(trees=100, sample_rows=256, contamination=0.01)

RULE = """CASE WHEN quantity > 38 THEN CASE WHEN discount > 0.045 THEN 'DDoS' WHEN tax > 0.045 THEN 'Botnet' ELSE 'BENIGN' END
  WHEN quantity > 24 THEN CASE WHEN tax < 0.025 THEN 'PortScan' WHEN discount < 0.025 THEN 'DDoS' ELSE 'BENIGN' END
  WHEN quantity < 5 THEN CASE WHEN discount > 0.075 THEN 'Botnet' ELSE 'PortScan' END ELSE 'BENIGN' END"""
# Flows of two classes that no model is trained on lie among those of the rule.
TRUTH = f"CASE WHEN quantity = 10 THEN 'Heartbleed' WHEN quantity = 11 THEN 'DoS Hulk' ELSE {RULE} END"
ORDER_RULE = """CASE WHEN yday <= 90 THEN 'DDoS' WHEN yday > 300 THEN 'PortScan' WHEN total > 250000 THEN 'Botnet' ELSE 'BENIGN' END"""
FLOWS_SQL = f"""measured AS (SELECT {CARRY_LIST}, {', '.join(FLOW_COLUMNS[:4])} FROM lineitem),
  flows AS (SELECT *, {TRUTH} AS truth, {RULE} AS answer FROM measured)"""


def _scored_flows(spark, sf_dir):
    """All flows, those of classes the model never saw included."""
    measured = spread(lineitem(spark, sf_dir)).selectExpr(*CARRY, *FLOW_COLUMNS[:4])
    return measured.withColumn(TARGET, F.expr(TRUTH))


def _labelled(spark, sf_dir):
    return _scored_flows(spark, sf_dir).filter(F.col(TARGET).isin(*CLASSES))


@per_table("lineitem")
def training_table(spark, sf_dir):
    """All flows of known class; the classifier is fitted on the whole training part."""
    return materialize(_labelled(spark, sf_dir), "training")


@per_table("lineitem")
def trained(spark, sf_dir):
    return training.train(training_table(spark, sf_dir), LINE_SPEC, CARRY, "WIDE", POLICY, NOVELTY)


@per_table("orders")
def order_model(spark, sf_dir):
    """A profile fitted on orders, for the streaming queries."""
    measured = order_flows(spark, sf_dir).drop("truth", "model_prediction", "confidence")
    table = materialize(measured.withColumn(TARGET, F.expr(ORDER_RULE)), "order-training")
    return training.train(table, ORDER_SPEC, ("seq",), "ORDERS", POLICY, NOVELTY)


@per_table("lineitem")
def _parts(spark, sf_dir):
    return materialize(training.split(training_table(spark, sf_dir), LINE_SPEC, POLICY, CARRY), "split")


def _test_rows(spark, sf_dir):
    return _parts(spark, sf_dir).filter("is_test")


@query("ml_label_index", f"""WITH {FLOWS_SQL} SELECT {CARRY_LIST}, truth,
    CAST(dense_rank() OVER (ORDER BY truth) - 1 AS DOUBLE) AS label_index FROM flows
  WHERE truth IN ('BENIGN', 'DDoS', 'PortScan', 'Botnet')""")
def _(spark, sf_dir):
    table = _labelled(spark, sf_dir).select(*CARRY, F.col(TARGET).alias("truth"))
    indexer = StringIndexer(inputCol="truth", outputCol="label_index", stringOrderType="alphabetAsc").fit(table)
    return indexer.transform(table)


@query("ml_class_weights", f"""WITH {FLOWS_SQL}, c AS (SELECT truth AS class, count(*) AS n FROM flows
    WHERE truth IN ('BENIGN', 'DDoS', 'PortScan', 'Botnet') GROUP BY 1)
  SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 8) AS weight FROM c""")
def _(spark, sf_dir):
    table = _labelled(spark, sf_dir)
    weight = forest.class_weight(forest.class_counts(table))
    rows = table.select(F.col(TARGET).alias("class"), weight.alias("w"))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.round(F.max("w"), 8).alias("weight"))


# What training reads: flows of known class without the test rows.
_KEYS = ", ".join(f"CAST({c} AS VARCHAR)" for c in CARRY)
_SPLIT_SQL = f"""{FLOWS_SQL}, ranked AS (SELECT *, md5(concat_ws('|', '{SEED}', {_KEYS})) AS h FROM flows
    WHERE truth IN ('BENIGN', 'DDoS', 'PortScan', 'Botnet')),
  parts AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY h)
    <= CAST(round({POLICY.test_share} * count(*) OVER (PARTITION BY truth)) AS BIGINT) AS is_test FROM ranked),
  train AS (SELECT * FROM parts WHERE NOT is_test)"""
_DRAWS = " + ".join(f"CASE WHEN bits >= '{n:04x}' THEN 1 ELSE 0 END" for n in forest.POISSON.tolist())


@query("ml_train_forest", f"""WITH {_SPLIT_SQL}, t AS (SELECT CAST(unnest(generate_series(0, {POLICY.trees - 1})) AS INTEGER) AS tree),
  bags AS (SELECT tree, truth, substr(md5(concat_ws('|', '{SEED}', concat('bag', CAST(tree // {forest.PER_HASH} AS VARCHAR)), {_KEYS})),
    1 + 4 * (tree % {forest.PER_HASH}), 4) AS bits FROM train, t),
  n AS (SELECT tree, truth AS class, CAST(sum({_DRAWS}) AS BIGINT) AS drawn FROM bags GROUP BY 1, 2)
  SELECT tree, class, drawn, drawn AS in_leaves, CAST(0 AS BIGINT) AS broken, TRUE AS pure, (SELECT count(*) FROM train) AS training_rows FROM n""")
def _(spark, sf_dir):
    """Each tree's own sample per class, found again in its leaves; leaves are pure as the classes can be told apart."""
    model = trained(spark, sf_dir).model
    leaves = model.nodes.filter("feature < 0").groupBy("tree").agg(F.max(F.size(F.filter("drawn", lambda n: n > 0))).alias("kinds"))
    return forest.soundness(model).join(F.broadcast(leaves), "tree").select(
        "tree", "class", "drawn", "in_leaves", "broken", (F.col("kinds") == 1).alias("pure"), F.lit(model.rows).cast("long").alias("training_rows"))


def _sound():
    """The confidence is the largest probability, it is the prediction's, and all add up to one."""
    p = F.col("class_probabilities")
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(F.map_values(p))
    return (F.abs(total - 1) < 2e-3) & (p[F.col("model_prediction")] == best) & (F.bround("confidence", 4) == best)


@query("ml_score_totals", f"""WITH {FLOWS_SQL} SELECT truth, count(*) AS scored, count(*) AS sound, count(*) AS right_answer
    FROM flows GROUP BY 1""")
def _(spark, sf_dir):
    scored = score.predictions(_scored_flows(spark, sf_dir), trained(spark, sf_dir))
    return scored.groupBy(F.col(TARGET).alias("truth")).agg(
        F.count("*").alias("scored"), F.count_if(_sound()).alias("sound"),
        F.count_if(F.col("model_prediction") == F.expr(RULE)).alias("right_answer"))


@query("ml_score", f"WITH {FLOWS_SQL} SELECT {CARRY_LIST}, truth AS threat_class, answer AS model_prediction, TRUE AS sound FROM flows")
def _(spark, sf_dir):
    """Each flow's prediction, with probabilities and novelty score reduced to whether they are sound."""
    scored = score.predictions(_scored_flows(spark, sf_dir), trained(spark, sf_dir))
    return scored.select(*CARRY, TARGET, "model_prediction", (_sound() & F.col("novelty_score").between(-1, 0)).alias("sound"))


@query("ml_score_rows")
def _(spark, sf_dir):
    scored = score.predictions(_scored_flows(spark, sf_dir), trained(spark, sf_dir))
    return scored.select(*CARRY, TARGET, "model_prediction", "confidence", "class_probabilities", "novelty_score")


@query("ml_importance")
def _(spark, sf_dir):
    return forest.importances(trained(spark, sf_dir).model)


@query("rank_importance")
def _(spark, sf_dir):
    return forest.importances(trained(spark, sf_dir).model).orderBy("rank")


_PERFECT = ", ".join(f"CAST(1 AS DOUBLE) AS {c}" for c in (
    "accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"))


@query("ml_evaluate", f"WITH {_SPLIT_SQL} SELECT count(*) AS rows, {_PERFECT} FROM parts WHERE is_test")
def _(spark, sf_dir):
    root = scratch_path(spark, "profiles")
    training.save(trained(spark, sf_dir), root, spark)
    model = training.load(spark, root, LINE_SPEC, "WIDE")
    scored = forest.score(_test_rows(spark, sf_dir), model.model, model.classes)
    return training.metrics(scored, model.classes)[1]


@query("ml_ood_reference", f"""WITH {_SPLIT_SQL} {' UNION ALL '.join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.001), 6) AS lower, round(quantile_cont({c}, 0.999), 6) AS upper, "
    f"round(quantile_cont({c}, 0.5), 6) AS median, count({c}) AS n FROM train" for c in LINE_FEATURES)}""")
def _(spark, sf_dir):
    train = _parts(spark, sf_dir).filter("NOT is_test")
    bounds = training.quantile_bounds(train, LINE_FEATURES, 0.001)
    return bounds.withColumns({c: F.round(c, 6) for c in ("lower", "upper", "median")})


# --- the novelty detector in SQL: samples, growth level by level, walk level by level ----
def _number(text: str) -> str:
    """A number of eight hexadecimal digits."""
    return " + ".join(f"(instr('0123456789abcdef', substr({text}, {i}, 1)) - 1) * {16 ** (8 - i)}" for i in range(1, 9))


def _novelty_sql() -> str:
    """Tables ``inodes`` (the detector's nodes) and ``train``."""
    trees, rows, feats = NOVELTY.trees, NOVELTY.sample_rows, LINE_FEATURES
    columns, two32 = ", ".join(feats), float(1 << 32)
    ctes = [f"""{_SPLIT_SQL}, benign AS (SELECT * FROM train WHERE truth = 'BENIGN'),
  size AS (SELECT count(*) AS n, least(1.0, {novelty.SLACK * rows} / greatest(count(*), 1)) AS part FROM benign),
  hexed AS (SELECT *, md5(concat_ws('|', '{SEED}', 'novelty', 'arc', {_KEYS})) AS ah FROM benign),
  arcs AS (SELECT *, CAST({_number('ah')} AS DOUBLE) * {trees} / {two32} AS place FROM hexed),
  ends AS (SELECT arcs.*, CAST(floor(place) AS BIGINT) AS e1, greatest(CAST(floor(place - part * {trees}) AS BIGINT) + 1,
    CAST(floor(place) AS BIGINT) - {trees - 1}) AS e0 FROM arcs, size),
  drawn AS (SELECT *, unnest(generate_series(e0, e1)) AS e FROM ends WHERE e0 <= e1),
  dealt AS (SELECT *, CAST((e % {trees} + {trees}) % {trees} AS INTEGER) AS tree FROM drawn),
  sampled AS (SELECT * FROM dealt QUALIFY row_number() OVER (PARTITION BY tree ORDER BY
    md5(concat_ws('|', '{SEED}', 'novelty', CAST(tree AS VARCHAR), {_KEYS})), {CARRY_LIST}) <= {rows}),
  bounded AS (SELECT tree, CAST(ceil(log2(greatest(count(*), 2))) AS INTEGER) AS deepest FROM sampled GROUP BY 1),
  s0 AS (SELECT tree, deepest, CAST(1 AS BIGINT) AS node, {columns} FROM sampled JOIN bounded USING (tree))"""]
    depths = range((rows - 1).bit_length() + 1)
    can = [f"CASE WHEN hi{i} > lo{i} THEN 1 ELSE 0 END" for i in range(len(feats))]
    upto = [" + ".join(can[:i + 1]) for i in range(len(feats))]
    for d in depths:
        ends = ", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(feats))
        pick = " ".join(f"WHEN hi{i} > lo{i} AND {upto[i]} = chosen + 1 THEN {i}" for i in range(len(feats)))
        low, high, value = (f"CASE feature {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(xs))} END" for xs in (
            [f"lo{i}" for i in range(len(feats))], [f"hi{i}" for i in range(len(feats))], feats))
        ctes.append(f"""g{d} AS (SELECT tree, node, deepest, count(*) AS n, {ends},
    md5(concat_ws('|', '{SEED}', 'split', CAST(tree AS VARCHAR), CAST(node AS VARCHAR))) AS h FROM s{d} GROUP BY 1, 2, 3),
  c{d} AS (SELECT *, CASE WHEN {d} < deepest AND {upto[-1]} > 0 THEN ({_number('h')}) % ({upto[-1]}) ELSE -1 END AS chosen FROM g{d}),
  f{d} AS (SELECT *, CASE WHEN chosen < 0 THEN -1 {pick} ELSE -1 END AS feature FROM c{d}),
  v{d} AS (SELECT *, {low} AS a, {high} AS b, CAST({_number('substr(h, 9, 8)')} AS DOUBLE) / {two32} AS u FROM f{d}),
  t{d} AS (SELECT *, CASE WHEN feature < 0 THEN 0.0 WHEN a + u * (b - a) >= b THEN a ELSE a + u * (b - a) END AS threshold FROM v{d})""")
        if d < depths[-1]:
            ctes.append(f"""s{d + 1} AS (SELECT tree, deepest, 2 * node + CASE WHEN ({value}) <= threshold THEN 0 ELSE 1 END AS node, {columns}
    FROM s{d} JOIN (SELECT tree, node, feature, threshold FROM t{d}) USING (tree, node) WHERE feature >= 0)""")
    path = "CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n END"
    nodes = " UNION ALL ".join(f"SELECT tree, node, CAST(feature AS INTEGER) AS feature, threshold, {d} + {path} AS depth FROM t{d}" for d in depths)
    return ", ".join([*ctes, f"inodes AS ({nodes})"])


def _walk_sql(table: str) -> str:
    """Table ``walked``: the rows of ``table`` with ``r`` and their novelty score."""
    value = f"CASE feature {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(LINE_FEATURES))} END"
    columns = ", ".join(LINE_FEATURES)
    ctes = [f"placed AS (SELECT *, row_number() OVER () AS r FROM {table})",
            f"w0 AS (SELECT r, tree, node, {columns}, feature, threshold, depth FROM placed, inodes WHERE node = 1)"]
    deepest = (NOVELTY.sample_rows - 1).bit_length()
    for d in range(deepest):
        ctes.append(f"""w{d + 1} AS (SELECT w.r, w.tree, w.node, {', '.join('w.' + f for f in LINE_FEATURES)}, i.feature, i.threshold, i.depth
    FROM (SELECT r, tree, 2 * node + CASE WHEN ({value}) <= threshold THEN 0 ELSE 1 END AS node, {columns} FROM w{d} WHERE feature >= 0) w
    JOIN inodes i ON i.tree = w.tree AND i.node = w.node)""")
    leaves = " UNION ALL ".join(f"SELECT r, depth FROM w{d} WHERE feature < 0" for d in range(deepest + 1))
    scale = novelty.average_path(NOVELTY.sample_rows)
    ctes.append(f"sums AS (SELECT r, -pow(2.0, -(sum(depth) / {NOVELTY.trees} / {scale!r})) AS novelty_score FROM ({leaves}) GROUP BY r)")
    return ", ".join([*ctes, "walked AS (SELECT * FROM placed JOIN sums USING (r))"])


_NOVELTY_STATS = f"""SELECT count(*) AS n_rows, CAST({NOVELTY.contamination} AS DOUBLE) AS contamination,
    quantile_cont(novelty_score, {NOVELTY.contamination}) AS threshold, quantile_cont(novelty_score, 0.5) AS benign_score_median,
    quantile_cont(novelty_score, 0.01) AS benign_score_p1 FROM walked"""


@query("ml_novelty_fit", f"""WITH {_novelty_sql()} SELECT tree, node, feature, round(threshold, 6) AS threshold,
    CASE WHEN feature < 0 THEN -1 ELSE 2 * node END AS left, CASE WHEN feature < 0 THEN -1 ELSE 2 * node + 1 END AS right,
    round(depth, 9) AS depth FROM inodes""")
def _(spark, sf_dir):
    nodes = trained(spark, sf_dir).novelty_nodes
    return nodes.withColumns({"threshold": F.round("threshold", 6), "depth": F.round("depth", 9)})


@query("ml_novelty_score", f"WITH {_novelty_sql()}, {_walk_sql('flows')} SELECT {CARRY_LIST}, round(novelty_score, 9) AS novelty_score FROM walked")
def _(spark, sf_dir):
    model = trained(spark, sf_dir)
    scored = novelty.with_novelty(_scored_flows(spark, sf_dir), model.novelty_nodes, LINE_FEATURES, NOVELTY)
    return scored.select(*CARRY, F.round("novelty_score", 9).alias("novelty_score"))


@query("ml_novelty_flags")
def _(spark, sf_dir):
    model = trained(spark, sf_dir)
    scored = novelty.with_novelty(_scored_flows(spark, sf_dir), model.novelty_nodes, LINE_FEATURES, NOVELTY,
                                  model.reference.novelty["threshold"])
    return scored.select(*CARRY, "novelty_score", "novelty_flagged")


@query("agg_novelty_reference", f"""WITH {_novelty_sql()}, {_walk_sql('benign')}, stats AS ({_NOVELTY_STATS})
  SELECT n_rows, contamination, {', '.join(f'round({c}, 9) AS {c}' for c in ('threshold', 'benign_score_median', 'benign_score_p1'))} FROM stats""")
def _(spark, sf_dir):
    model = trained(spark, sf_dir)
    benign = _parts(spark, sf_dir).filter("NOT is_test").filter(F.col(TARGET) == "BENIGN")
    stats = novelty.reference(benign, model.novelty_nodes, LINE_FEATURES, NOVELTY)
    return stats.withColumns({c: F.round(c, 9) for c in ("threshold", "benign_score_median", "benign_score_p1")})


@query("sink_model", f"WITH {_novelty_sql()} SELECT tree, count(*) AS nodes FROM inodes GROUP BY 1")
def _(spark, sf_dir):
    root = scratch_path(spark, "profiles")
    base = training.save(trained(spark, sf_dir), root, spark)
    return spark.read.parquet(f"{base}/novelty").groupBy("tree").agg(F.count("*").alias("nodes"))


@query("ml_compare_profiles")
def _(spark, sf_dir):
    return training.compare_profiles(training_table(spark, sf_dir), LINE_SPEC, CARRY, POLICY)


@query("ml_confidence_bands")
def _(spark, sf_dir):
    model = trained(spark, sf_dir)
    scored = forest.score(_test_rows(spark, sf_dir), model.model, model.classes)
    return evaluation.confidence_bands(scored, model.classes, truth=TARGET)
