"""Monitoring queries over the alert table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import severity as sev
from tidewatch.functions.coerce import clamp_unit
from tidewatch.spec import UNKNOWN_CLASS, UNRELIABLE

# What an alert lacking a later schema's fields counts as.
DEFAULTS: dict[str, tuple[str, object]] = {
    "threat_class": ("string", "UNKNOWN"), "severity": ("string", "INFO"),
    "confidence": ("double", 0.0), "is_alertable": ("boolean", False),
    "protocol": ("string", "UNKNOWN"), "ground_truth": ("string", None),
    "correct": ("boolean", None), "needs_review": ("boolean", False),
    "model_prediction": ("string", None), "reliability": ("string", "UNKNOWN"),
    "in_distribution": ("boolean", None), "ood_score": ("double", 0.0),
    "ood_features": ("array<string>", None),
}
CHART_ORDER = ("BENIGN", "DDoS", "PortScan", "Botnet", "UNKNOWN")
QUEUES = ("Alerts", "Review", "Both", "All")


def fill_defaults(df: DataFrame) -> DataFrame:
    """Alert columns of the current schema, defaults where a file lacks them.

    Also fills per row, so a table mixing old and new records reads the same as
    each of its files; unchecked rows stay UNKNOWN, never RELIABLE.
    """
    new = {}
    for name, (kind, value) in DEFAULTS.items():
        default = F.lit(value).cast(kind)
        new[name] = F.coalesce(F.col(name), default) if name in df.columns else default
    return df.withColumns(new)


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def queue(df: DataFrame, which: str = "Both", *, classes: Sequence[str] | None = None,
          severities: Sequence[str] | None = None, tiers: Sequence[str] | None = None,
          min_confidence: float = 0.0) -> DataFrame:
    """Rows of one queue, narrowed by class, severity, reliability and confidence."""
    if which not in QUEUES:
        raise ValueError(f"queue must be one of {QUEUES}")
    alert, review = _flag("is_alertable"), _flag("needs_review")
    mask = {"Alerts": alert, "Review": review & ~alert, "Both": alert | review, "All": F.lit(True)}[which]
    mask = mask & (F.col("confidence") >= min_confidence)
    for column, chosen in (("threat_class", classes), ("severity", severities), ("reliability", tiers)):
        if chosen is not None:
            mask = mask & F.col(column).isin(*chosen)
    return df.filter(mask)


def review_only(df: DataFrame) -> DataFrame:
    return df.filter(_flag("needs_review") & ~_flag("is_alertable"))


def tiles(df: DataFrame) -> DataFrame:
    """The headline numbers in one aggregate."""
    counts = df.agg(
        F.count("*").alias("flows"), F.count_if(_flag("is_alertable")).alias("alerts"),
        F.count_if(_flag("needs_review") & ~_flag("is_alertable")).alias("review"),
        F.count_if(F.col("reliability") == UNRELIABLE).alias("out_of_distribution"))
    return counts.withColumn("ood_share", F.coalesce(
        F.try_divide(F.col("out_of_distribution").cast("double"), F.col("flows").cast("double")), F.lit(0.0)))


def class_chart(df: DataFrame) -> DataFrame:
    """Class counts in the fixed chart order, then the others by count."""
    counts = df.groupBy("threat_class").agg(F.count("*").alias("n"))
    place = F.lit(len(CHART_ORDER))
    for i, name in enumerate(CHART_ORDER):
        place = F.when(F.col("threat_class") == name, F.lit(i)).otherwise(place)
    order = F.row_number().over(Window.orderBy(place, F.desc("n"), "threat_class"))  # one row per class
    return counts.withColumn("position", order)


def model_missing(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("threat_class") == UNKNOWN_CLASS).alias("unknown_rows"))


def live_counters(df: DataFrame) -> DataFrame:
    """Per class and severity: flows, labelled, correct. Also valid on a stream."""
    return df.groupBy("threat_class", "severity").agg(
        F.count("*").alias("flows"), F.count("correct").alias("labelled"),
        F.count_if(F.coalesce(F.col("correct"), F.lit(False))).alias("correct_flows"),
        F.count_if(_flag("is_alertable")).alias("alertable"))


def status(counters: DataFrame) -> DataFrame:
    """Run totals from the counters: one row."""
    sums = counters.agg(*[F.sum(c).alias(c) for c in ("flows", "labelled", "correct_flows", "alertable")])
    return sums.withColumn("live_accuracy", F.bround(
        F.try_divide(F.col("correct_flows").cast("double"), F.col("labelled").cast("double")), 4))


def alert_table(df: DataFrame, limit: int = 300) -> DataFrame:
    """Most severe first, then the latest id; with how many rows match in all."""
    total = df.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    top = (df.withColumn("rank", sev.ladder_rank(F.col("severity")))
           .orderBy(F.desc("rank"), F.desc("flow_id")).limit(limit).withColumn("_one", F.lit(1)))
    return top.join(F.broadcast(total), "_one").drop("_one")  # the total is a single row


def tail(df: DataFrame, limit: int = 5_000, seq: str = "seq") -> DataFrame:
    return df.orderBy(F.desc(seq)).limit(limit)


def latest_ood(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The most recent untrustworthy flow, whole."""
    rows = df.filter(F.col("reliability") == UNRELIABLE)
    newest = rows.agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.col(seq)).alias("r"))
    return newest.filter(F.col("r").isNotNull()).select("r.*")


def id_number(flow_id: Column) -> Column:
    """Digits of a flow id as a number; 0 when it has none."""
    return F.coalesce(F.regexp_extract(flow_id, r"^[A-Za-z]*([0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))


def timeline(df: DataFrame) -> DataFrame:
    """Class and confidence along the observation sequence."""
    return (df.select(id_number(F.col("flow_id")).alias("sequence"), "threat_class",
                      clamp_unit(F.col("confidence")).alias("confidence")).orderBy("sequence"))
