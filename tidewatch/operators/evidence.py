"""Evidence: the few feature values that support a classification.

Rules, medians and importances are small fixed tables of the spec, so each class
becomes one array of literal-backed structs and no row leaves its partition.
Long-form lookups are there as joins for callers holding those tables as tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.coerce import finite
from tidewatch.functions.naming import describe_port, port_number
from tidewatch.functions.text import display_value, grouped
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.rows import q
from tidewatch.session import BROADCAST_BYTES, UNKNOWN_BYTES, materialize, planned_bytes
from tidewatch.spec import EvidencePolicy, Rule

METHOD = ("Feature-based evidence: per-class reference medians combined with the model's "
          "global importances. It does not attribute this one prediction to features.")
ITEM = ("struct<feature:string,value:double,display:string,why:string,"
        "comparison:string,importance:double>")
_TINY_RATIO = 1e-9


def _shown(value: float, feature: str, policy: EvidencePolicy) -> str:
    """Display text of a fixed median (the driver-side twin of ``display_value``)."""
    if feature in policy.duration_features and value >= 1000:
        return f"{value:,.0f} us ({value / 1e6:.3f} s)"
    if feature in policy.port_features:
        return str(int(value))
    places = 0 if abs(value) >= 1000 else 2 if abs(value) >= 1 else 3
    text = f"{value:,.{places}f}"
    text = text.rstrip("0").rstrip(".") if places else text
    return f"{text} {policy.units.get(feature, '')}".strip()


def _rule_struct(position: int, rule: Rule, threat: str, policy: EvidencePolicy,
                 importances: Mapping[str, float]) -> Column:
    """A rule with all it needs to judge and word a value, as one literal struct."""
    medians = policy.medians.get(rule.feature) or {}
    benign, weight = medians.get(policy.benign), float(importances.get(rule.feature, 0.0))

    def number(x: float | None) -> Column:
        return F.lit(x).cast("double")

    return F.struct(
        F.lit(-weight).alias("order_key"), F.lit(position).alias("position"), F.lit(rule.feature).alias("feature"),
        F.lit(rule.direction).alias("direction"), F.lit(rule.why).alias("why"),
        number(medians.get(threat)).alias("own"), number(benign).alias("benign"),
        F.lit("" if benign is None else _shown(benign, rule.feature, policy)).alias("benign_text"),
        F.lit(policy.units.get(rule.feature, "")).alias("unit"),
        F.lit(rule.feature in policy.port_features).alias("port"),
        F.lit(rule.feature in policy.duration_features).alias("duration"),
        F.lit(round(weight, 4)).alias("importance"), F.lit(threat).alias("threat"))


def is_notable(value: Column, rule: Column, policy: EvidencePolicy) -> Column:
    """Does the value support the rule's claim, judged against the medians."""
    own, benign = rule["own"], rule["benign"]
    near = (F.when(own.isNull(), F.lit(True)).when(own == 0, F.abs(value) <= 1.0)
            .otherwise(F.abs(value - own) / F.abs(own) <= policy.near_tolerance))
    high = F.when(benign > 0, value >= benign * policy.high_ratio).otherwise(value > 0)
    low = F.when(benign > 0, value <= benign * policy.low_ratio).otherwise(value == 0)
    out = F.when(rule["direction"] == "near", near)
    if policy.well_known_ports:
        out = F.when(rule["direction"] == "nonstandard",
                     ~port_number(value).isin(*policy.well_known_ports)).when(rule["direction"] == "near", near)
    return (out.when(benign.isNull(), F.lit(True)).when(rule["direction"] == "high", high)
            .when(rule["direction"] == "low", low).otherwise(F.lit(True)))


def comparison(value: Column, rule: Column, policy: EvidencePolicy) -> Column:
    """The value set against the benign median, in words; NULL without one."""
    benign, shown, ratio = rule["benign"], rule["benign_text"], value / rule["benign"]
    high, low = ratio >= policy.high_ratio, ratio <= policy.low_ratio
    factor = grouped(F.when(high, ratio).otherwise(1 / F.greatest(ratio, F.lit(_TINY_RATIO))), 1)
    middle = F.when(high, F.lit(" times what half of benign flows stay under: ")).otherwise(F.lit(" times less than the middle of benign flows: "))
    out = F.when(benign.isNull(), F.lit(None).cast("string"))
    if policy.port_features:
        described, usual = describe_port(value, policy.well_known_ports), describe_port(benign, policy.well_known_ports)
        out = out.when(rule["port"], F.concat(described, F.when(F.abs(value - rule["own"]) < 1, F.concat(
            F.lit(" - most training flows of class "), rule["threat"], F.lit(" went there"))).otherwise(
            F.concat(F.lit(" - benign flows mostly go to "), usual))))
    return (out.when(benign == 0, F.when(value > 0, F.rtrim(F.concat(F.lit("the middle of benign flows is 0 "), rule["unit"]))))
            .when(low & (value == 0), F.concat(F.lit("nothing, where the middle of benign flows is "), shown))
            .when(high | low, F.concat(factor, middle, shown))
            .otherwise(F.concat(F.lit("the middle of benign flows is "), shown)))


def with_judged_rules(df: DataFrame, policy: EvidencePolicy, importances: Mapping[str, float],
                      prediction: str) -> DataFrame:
    """Add ``_ranked`` (rules of the row's class with a usable value first: notable,
    then context, each by importance), ``_notable`` and ``_held`` (how many of each).

    Rule ``i`` of whatever class the row has is judged by one shared expression;
    no lambda runs, so the projection compiles.
    """
    have = set(df.columns)
    rules = {c: [r for r in rs if r.feature in have] for c, rs in policy.rules.items()}
    slots = max((len(rs) for rs in rules.values()), default=0)
    if not slots:
        raise ValueError("no rule names a column of this table")

    def by_class(pick) -> Column:
        out = F.lit(None)
        for threat, held in rules.items():
            if (chosen := pick(threat, held)) is not None:
                out = F.when(F.col(prediction) == threat, chosen).otherwise(out)
        return out

    staged = df.withColumns({
        "_r": by_class(lambda c, rs: F.array(*[_rule_struct(i, r, c, policy, importances) for i, r in enumerate(rs)])
                       if rs else None),
        **{f"_v{i}": by_class(lambda c, rs, i=i: finite(q(rs[i].feature).cast("double")) if i < len(rs) else None)
           for i in range(slots)}})
    staged = staged.withColumns({f"_t{i}": F.when(F.col(f"_v{i}").isNull(), F.lit(2)).when(
        is_notable(F.col(f"_v{i}"), F.get("_r", i), policy), F.lit(0)).otherwise(F.lit(1)) for i in range(slots)})
    entries = [F.struct(F.col(f"_t{i}").alias("tier"), F.get("_r", i).alias("rule"), F.col(f"_v{i}").alias("value"))
               for i in range(slots)]
    tiers = [F.col(f"_t{i}") for i in range(slots)]
    staged = staged.withColumns({
        "_ranked": F.sort_array(F.array(*entries)),
        "_notable": reduce(lambda a, b: a + b, [(t == 0).cast("int") for t in tiers]),
        "_held": reduce(lambda a, b: a + b, [(t < 2).cast("int") for t in tiers])})
    return staged.drop("_r", *[f"_v{i}" for i in range(slots)], *[f"_t{i}" for i in range(slots)])


def with_evidence(df: DataFrame, policy: EvidencePolicy, importances: Mapping[str, float] = {},
                  prediction: str = "model_prediction") -> DataFrame:
    """Add ``evidence_detail, evidence, evidence_method, aggregate_context``.

    At most ``max_items`` notable values, topped up with marked context values to
    ``min_items``. Notable ones sort first, so the choice is a prefix.
    """
    note = F.lit(None).cast("string")
    for threat, text in policy.aggregate_notes.items():
        note = F.when(F.col(prediction) == threat, F.lit(text)).otherwise(note)
    judged = with_judged_rules(df, policy, importances, prediction)
    count = F.greatest(F.least(F.col("_notable"), F.lit(policy.max_items)),
                       F.least(F.col("_held"), F.lit(policy.min_items)))
    judged = judged.withColumn("_chosen", F.slice("_ranked", F.lit(1), count)).drop("_ranked", "_notable", "_held")

    def item(k: int) -> Column:
        x = F.get("_chosen", k)
        rule, value = x["rule"], x["value"]
        context = F.concat(F.lit("For context only: this value is not unusual for "), rule["feature"], F.lit(" here."))
        return F.struct(
            rule["feature"].alias("feature"), value.alias("value"),
            display_value(value, rule["unit"], rule["port"], rule["duration"], clocks=bool(policy.duration_features),
                          ports=bool(policy.port_features)).alias("display"),
            F.when(x["tier"] == 0, rule["why"]).otherwise(context).alias("why"),
            comparison(value, rule, policy).alias("comparison"), rule["importance"].alias("importance")).cast(ITEM)

    slots = max(policy.max_items, policy.min_items)
    worded = judged.withColumns({f"_i{k}": F.when(F.size("_chosen") > k, item(k)) for k in range(slots)})
    worded = worded.withColumn("evidence_detail", F.slice(
        F.array(*[F.col(f"_i{k}") for k in range(slots)]), F.lit(1), F.size("_chosen")))
    # A feature may back two rules; its value is the same in both.
    pairs = F.array_distinct(F.arrays_zip(F.col("evidence_detail.feature").alias("f"),
                                          F.col("evidence_detail.value").alias("v")))
    return worded.withColumns({"evidence": F.map_from_entries(pairs), "evidence_method": F.lit(METHOD),
                               "aggregate_context": note}).drop("_chosen", *[f"_i{k}" for k in range(slots)])


# --- long-form lookups -----------------------------------------------------------

def lookup(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a lookup table: broadcast when its size is known to be small,
    else left to the optimizer (sort-merge, skewed keys split by AQE).

    A table made of rows of the driver or from an aggregate over such has no known
    size until it is stored. Joined unbroadcast, a few names as keys would gather all
    rows in as many tasks."""
    if planned_bytes(table) >= UNKNOWN_BYTES and not df.isStreaming:
        table = materialize(table, "lookup")
    side = F.broadcast(table) if planned_bytes(table) <= BROADCAST_BYTES else table
    return df.join(side, list(on), "left")


def unpivot(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), q(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def class_medians(df: DataFrame, features: Sequence[str], target: str, classes: Sequence[str]) -> DataFrame:
    """Median of each feature in each class: ``class, feature, n, median``."""
    out = exact_quantiles(df, features, [0.5], by=target, groups=classes)
    return out.select(F.col(target).alias("class"), "feature", "n", F.element_at("values", 1).alias("median"))


def medians_dict(medians: DataFrame) -> dict[str, dict[str, float]]:
    """The medians table as literals; it has one row per class and feature."""
    out: dict[str, dict[str, float]] = {}
    for row in medians.collect():
        out.setdefault(row["feature"], {})[row["class"]] = row["median"]
    return out
