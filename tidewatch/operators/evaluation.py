"""Evaluation aggregates over (truth, prediction, confidence).

Every report is a hash aggregate with map-side partials down to one row per
class pair, band or label; what follows works on those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import severity as sev
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.verdict import known
from tidewatch.spec import UNRELIABLE, SeverityPolicy


def _class_table(df: DataFrame, classes: Sequence[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{name} string, _{name}_pos int")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, classes: Sequence[str], truth: str = "truth",
              prediction: str = "model_prediction") -> DataFrame:
    """Counts over the full class grid, zero cells included."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("predicted")).agg(F.count("*").alias("c"))
    grid = df.sparkSession.createDataFrame([(t, p) for t in classes for p in classes], "truth string, predicted string")
    return grid.join(counts, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("c", F.lit(0)).alias("n"))


def confusion_normalised(matrix: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("truth"))
    return matrix.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def top_confusions(matrix: DataFrame, limit: int = 5) -> DataFrame:
    """The largest off-diagonal cells with their share of the true class."""
    shares = confusion_normalised(matrix).filter(F.col("truth") != F.col("predicted"))
    shares = shares.withColumn("total_errors", F.sum("n").over(Window.partitionBy()))
    return (shares.filter(F.col("n") > 0)
            .orderBy(F.desc("n"), F.desc("truth"), F.desc("predicted")).limit(limit))


def class_prf(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    by_truth = matrix.groupBy(F.col("truth").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    joined = by_truth.join(by_pred, "class", "full").na.fill(0)
    precision, recall = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("support"))
    return (joined.withColumns({"precision": precision, "recall": recall})
            .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .select("class", "precision", "recall", "f1", "support", "tp", "called"))


def overall_metrics(prf: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted averages.

    Macro runs over classes seen in truth or prediction, balanced accuracy over
    classes present in truth.
    """
    seen = prf.filter((F.col("support") > 0) | (F.col("called") > 0))
    n = F.sum("support")

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * F.col("support")), n)

    return seen.agg(
        n.alias("rows"),
        _ratio(F.sum("tp"), n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"), weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"))


def known_only(df: DataFrame, classes: Sequence[str], truth: str = "truth") -> DataFrame:
    return df.filter(known(F.col(truth), classes))


def unseen_only(df: DataFrame, classes: Sequence[str], truth: str = "truth") -> DataFrame:
    return df.filter(F.col(truth).isNotNull() & ~known(F.col(truth), classes))


def confidence_bands(df: DataFrame, classes: Sequence[str], *, truth: str | None = "truth",
                     prediction: str = "model_prediction", policy: SeverityPolicy = sev.POLICY) -> DataFrame:
    """Rows, share and (on rows of known truth) accuracy per confidence band."""
    level = sev.band(F.col("confidence"), policy)
    is_known = known(F.col(truth), classes) if truth else F.lit(False)
    right = is_known & (F.col(truth) == F.col(prediction)) if truth else F.lit(False)
    counts = df.groupBy(level.alias("band")).agg(
        F.count("*").alias("c"), F.count_if(is_known).alias("k"), F.count_if(right).alias("r"))
    table = _class_table(df, [name for _, name in policy.bands], "band")
    n = F.coalesce("c", F.lit(0))
    return table.join(counts, "band", "left").select(
        "band", n.alias("n"), _ratio(n, F.sum(n).over(Window.partitionBy())).alias("share"),
        F.coalesce("k", F.lit(0)).alias("n_known"),
        F.try_divide(F.col("r").cast("double"), F.col("k").cast("double")).alias("accuracy"))


def predicted_distribution(df: DataFrame, classes: Sequence[str], prediction: str = "model_prediction") -> DataFrame:
    counts = df.groupBy(F.col(prediction).alias("class")).agg(
        F.count("*").alias("c"), F.avg("confidence").alias("mean_confidence"))
    n = F.coalesce("c", F.lit(0))
    return _class_table(df, classes, "class").join(counts, "class", "full").select(
        "class", n.alias("n"), _ratio(n, F.sum(n).over(Window.partitionBy())).alias("share"), "mean_confidence")


def value_shares(df: DataFrame, column: str, name: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def reliability_report(df: DataFrame) -> DataFrame:
    """Tier counts and shares, with the overall out-of-distribution rate and mean score."""
    counts = df.groupBy("reliability").agg(F.count("*").alias("n"), F.sum("ood_score").alias("s"))
    total = F.sum("n").over(Window.partitionBy())
    ood = F.sum(F.when(F.col("reliability") == UNRELIABLE, F.col("n")).otherwise(0)).over(Window.partitionBy())
    return counts.select("reliability", "n", (F.col("n") / total).alias("share"), (ood / total).alias("ood_rate"),
                         (F.sum("s").over(Window.partitionBy()) / total).alias("mean_ood_score"))


def feature_violations(df: DataFrame, flags: dict[str, Column], limit: int | None = None) -> DataFrame:
    """How often each feature is out of range: one conditional count per feature."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(flags.values())])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("rows"),
                              _ratio(F.col(f"c{i}"), F.col("_n")).alias("share")) for i, f in enumerate(flags)])
    out = wide.select(F.explode(rows).alias("r")).select("r.*").filter(F.col("rows") > 0)
    return out.orderBy(F.desc("rows"), "feature").limit(limit) if limit else out


def unreliable_predictions(df: DataFrame, prediction: str = "model_prediction") -> DataFrame:
    """What the classifier said on untrustworthy input, and how sure it was."""
    return (df.filter(F.col("reliability") == UNRELIABLE).groupBy(F.col(prediction).alias("class"))
            .agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")))


def severity_report(df: DataFrame, policy: SeverityPolicy = sev.POLICY) -> DataFrame:
    """Counts per severity, zero rungs kept, beside the two queue totals."""
    counts = df.groupBy("severity").agg(
        F.count("*").alias("c"), F.count_if("is_alertable").alias("a"),
        F.count_if(F.col("needs_review") & ~F.col("is_alertable")).alias("r"))
    n, whole = F.coalesce("c", F.lit(0)), Window.partitionBy()
    return _class_table(df, policy.ladder, "severity").join(counts, "severity", "left").select(
        "severity", F.col("_severity_pos").alias("rank"), n.alias("n"), _ratio(n, F.sum(n).over(whole)).alias("share"),
        F.coalesce(F.sum("a").over(whole), F.lit(0)).alias("alertable"),
        F.coalesce(F.sum("r").over(whole), F.lit(0)).alias("review_only"))


def benign_purity(df: DataFrame, classes: Sequence[str], benign: str, truth: str = "truth",
                  prediction: str = "model_prediction") -> DataFrame:
    """Of rows called benign, the share that is; only where unseen classes exist."""
    called = F.col(prediction) == benign
    counts = df.agg(F.count_if(called).alias("called_benign"),
                    F.count_if(called & (F.col(truth) == benign)).alias("truly_benign"),
                    F.count_if(~known(F.col(truth), classes)).alias("unseen"))
    return (counts.filter((F.col("called_benign") > 0) & (F.col("unseen") > 0))
            .withColumn("purity", F.col("truly_benign") / F.col("called_benign")))


def benign_false_positives(df: DataFrame, benign: str, truth: str = "truth",
                           prediction: str = "model_prediction") -> DataFrame:
    """Benign rows called something else: how many, and how sure the classifier was."""
    rows = df.filter(F.col(truth) == benign).select(
        F.when(F.col(prediction) != benign, F.col("confidence")).alias("wrong"))
    counts = rows.agg(
        F.count("*").alias("benign_rows"), F.count("wrong").alias("false_positives"),
        F.avg("wrong").alias("mean_confidence"), F.count_if(F.col("wrong") >= 0.9).alias("critical"))
    median = exact_quantiles(rows, ["wrong"], [0.5]).select(
        F.lit(1).alias("_one"), F.element_at("values", 1).alias("median_confidence"))
    return (counts.withColumn("_one", F.lit(1)).join(F.broadcast(median), "_one", "left").drop("_one")
            .withColumn("rate", _ratio(F.col("false_positives"), F.col("benign_rows"))))


def unseen_classes(df: DataFrame, classes: Sequence[str], benign: str, truth: str = "truth",
                   prediction: str = "model_prediction") -> DataFrame:
    """Per label never trained on: flagged or missed as benign; NULL label = overall."""
    rows = unseen_only(df, classes, truth)
    missed = F.count_if(F.col(prediction) == benign)
    return (rows.rollup(F.col(truth).alias("label"))
            .agg(F.count("*").alias("flows"), missed.alias("missed_as_benign"),
                 F.count_if(F.col("reliability") == UNRELIABLE).alias("rescued"))
            .filter(F.col("flows") > 0)
            .withColumns({"flagged": F.col("flows") - F.col("missed_as_benign"),
                          "miss_rate": F.col("missed_as_benign") / F.col("flows"),
                          "rescue_rate": F.col("rescued") / F.col("flows")}))


def profile_comparison(metrics: DataFrame) -> DataFrame:
    """Profiles side by side with the one of the highest macro F1 marked.

    Takes one row per profile and class: ``profile, n_features, class, f1,
    accuracy, balanced_accuracy, f1_macro``.
    """
    wide = (metrics.groupBy("profile", "n_features", "accuracy", "balanced_accuracy", "f1_macro")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "f1")))).alias("class_f1")))
    best = F.max(F.struct("f1_macro", "profile")).over(Window.partitionBy())["profile"]
    return wide.withColumn("is_best", F.col("profile") == best)


def top_detections(df: DataFrame, limit: int, benign: str, key: str) -> DataFrame:
    """Most confident rows whose reported class is not benign."""
    return (df.filter(F.col("reported_threat") != benign)
            .orderBy(F.desc("confidence"), F.asc(key)).limit(limit))
