"""Row filters of the cleaning job and the counters that account for them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.coerce import finite, is_infinite, na_to_null, parse_double, to_numeric
from tidewatch.functions.naming import drop_reason, map_label, strip, truth_label
from tidewatch.operators.rows import q
from tidewatch.spec import CAPTURE_TS, TARGET, FlowSpec


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def nulls_for_na(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: na_to_null(q(c)) for c in columns})


def is_empty_row(columns: Sequence[str]) -> Column:
    return _all([q(c).isNull() for c in columns])


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(q(label).isNotNull())


def typed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features as finite doubles, in one projection; numeric columns take no way through text."""
    return df.withColumns({c: _number(df, c) for c in columns if c in df.columns})


def _number(df: DataFrame, name: str) -> Column:
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return finite(q(name).cast("double")) if numeric else to_numeric(q(name))


def labelled(df: DataFrame, spec: FlowSpec) -> DataFrame:
    """Class column for the raw label; rows without a class are dropped."""
    out = df.withColumn(TARGET, map_label(q(spec.label_column), spec.label_map))
    return out.filter(F.col(TARGET).isNotNull()).drop(spec.label_column)


def marked_labels(df: DataFrame, spec: FlowSpec, mark: str) -> DataFrame:
    """Class column for the raw label; a label without a class stands, stripped, in ``mark``."""
    out = df.withColumn(TARGET, map_label(q(spec.label_column), spec.label_map))
    return out.withColumn(mark, F.when(F.col(TARGET).isNull(), strip(q(spec.label_column)))).drop(spec.label_column)


def dropped_labels(df: DataFrame, spec: FlowSpec) -> DataFrame:
    """Labels without a class, how many rows each cost, and why."""
    label = strip(q(spec.label_column))
    return (df.filter(q(spec.label_column).isNotNull() & map_label(q(spec.label_column), spec.label_map).isNull())
            .groupBy(label.alias("label")).agg(F.count("*").alias("rows"))
            .withColumn("reason", drop_reason(F.col("label"), spec.label_map)))


def drop_null_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=[f for f in features if f in df.columns])


def null_attribution(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Among rows a null feature costs, how many each feature is null in."""
    counts = df.agg(*[F.count_if(q(f).isNull()).alias(f"c{i}") for i, f in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("rows"))
                      for i, f in enumerate(features)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("rows") > 0)


def scoreable(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose profile features are all usable numbers."""
    return typed(df, features).dropna(how="any", subset=list(features))


def unscoreable(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The other rows: those with a feature that is no usable number, which is NULL here."""
    return typed(df, features).filter(~_all([q(f).isNotNull() for f in features]))


def scoreable_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    usable = _all([_number(df, f).isNotNull() for f in features])
    counts = df.agg(F.count("*").alias("rows_read"), F.count_if(usable).alias("rows_scored"))
    return counts.withColumns({
        "rows_dropped": F.col("rows_read") - F.col("rows_scored"),
        "dropped_share": F.try_divide(F.col("rows_read") - F.col("rows_scored"), F.col("rows_read"))})


def nonfinite_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Columns holding NULL, NaN or infinite values, with their counts."""
    bad = {f: F.count_if(q(f).isNull() | F.isnan(q(f)) | is_infinite(q(f))) for f in features}
    wide = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(bad.values())])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("rows")) for i, f in enumerate(bad)])
    return wide.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("rows") > 0)


def require_finite(df: DataFrame, features: Sequence[str]) -> None:
    """Training guard: raise, naming the columns, when a value is unusable."""
    bad = [r["feature"] for r in nonfinite_counts(df, features).collect()]  # one row per feature at most
    if bad:
        raise ValueError(f"non-finite values in {bad}; clean the table first")


def quality_counters(df: DataFrame, spec: FlowSpec) -> DataFrame:
    """Every counter of the per-row cleaning steps, in one pass over the raw text."""
    return df.agg(*counter_columns(df, spec))


def counter_columns(df: DataFrame, spec: FlowSpec) -> list[Column]:
    """The counters as aggregates, for a pass of their own or to be observed in another."""
    label = spec.label_column
    cells = [c for c in spec.numeric_columns if c in df.columns]
    retained = [c for c in spec.retained if c in df.columns]
    empty = is_empty_row(retained)
    kept = ~empty & q(label).isNotNull() if label in df.columns else ~empty
    junk = _sum([(q(c).isNotNull() & parse_double(q(c)).isNull()).cast("long") for c in cells])
    infinite = _sum([F.coalesce(is_infinite(parse_double(q(c))), F.lit(False)).cast("long") for c in cells])
    unmapped = map_label(q(label), spec.label_map).isNull() if label in df.columns else F.lit(False)
    return [
        F.count("*").alias("rows_in"),
        F.count_if(empty).alias("empty_rows"),
        F.count_if(~empty & ~kept).alias("missing_label"),
        F.coalesce(F.sum(F.when(kept, junk)), F.lit(0)).alias("non_numeric_cells"),
        F.coalesce(F.sum(F.when(kept, infinite)), F.lit(0)).alias("infinite_cells"),
        F.count_if(kept & unmapped).alias("unmapped_labels"),
        F.count_if(kept & ~unmapped).alias("rows_kept"),
    ]


def numeric_health(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Columns with a problem: missing, infinite and non-numeric cells."""
    aggregates = []
    for i, f in enumerate(features):
        number = parse_double(q(f))
        aggregates += [
            F.count_if(number.isNull()).alias(f"m{i}"),
            F.count_if(is_infinite(number)).alias(f"i{i}"),
            F.count_if(number.isNull() & q(f).isNotNull()).alias(f"t{i}"),
        ]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("missing"),
                              F.col(f"i{i}").alias("infinite"), F.col(f"t{i}").alias("non_numeric"))
                     for i, f in enumerate(features)])
    out = df.agg(*aggregates).select(F.explode(rows).alias("r")).select("r.*")
    return out.filter(F.col("missing") + F.col("infinite") + F.col("non_numeric") > 0)


def label_profile(df: DataFrame, spec: FlowSpec, by: Sequence[str] = ()) -> DataFrame:
    """Counts per raw label with what becomes of it, and the share kept."""
    label = q(spec.label_column)
    counts = df.filter(label.isNotNull()).groupBy(*by, label.alias("label")).agg(F.count("*").alias("rows"))
    target = map_label(F.col("label"), spec.label_map)
    verdict = (F.when(target.isNull(), F.concat(F.lit("dropped: "), drop_reason(F.col("label"), spec.label_map)))
               .when(target == F.col("label"), F.lit("kept"))
               .otherwise(F.concat(F.lit("renamed: "), target)))
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    kept = F.sum(F.when(target.isNotNull(), F.col("rows")).otherwise(0)).over(whole)
    return counts.withColumns({"verdict": verdict,
                               "kept_share": F.try_divide(kept, F.sum("rows").over(whole))})


def class_distribution(df: DataFrame, spec: FlowSpec, column: str = TARGET) -> DataFrame:
    """Rows and share per class: absent classes as zero, unexpected ones flagged."""
    spark = df.sparkSession
    counts = df.filter(q(column).isNotNull()).groupBy(q(column).alias("cls")).agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(c,) for c in spec.classes], "cls string")
    joined = domain.withColumn("expected", F.lit(True)).join(counts, "cls", "full")
    rows = F.coalesce(F.col("n"), F.lit(0))
    # The table is one row per class here, so the unpartitioned total is tiny.
    return joined.select(F.col("cls").alias("class"), rows.alias("rows"),
                         F.coalesce(F.try_divide(rows, F.sum(rows).over(Window.partitionBy())), F.lit(0.0)).alias("share"),
                         F.col("expected").isNull().alias("unexpected"))


def dataset_summary(labels_by_file: DataFrame, spec: FlowSpec) -> DataFrame:
    """Class totals over all files, with the rarest class and whether it is under 5 %.

    Takes raw rows with a ``file`` column; one row per class comes out.
    """
    cls = map_label(q(spec.label_column), spec.label_map)
    totals = (labels_by_file.select(cls.alias("class")).filter(F.col("class").isNotNull())
              .groupBy("class").agg(F.count("*").alias("rows")))
    whole = Window.partitionBy()
    rarest = F.min(F.struct("rows", "class")).over(whole)["class"]
    share = F.col("rows") / F.sum("rows").over(whole)
    return totals.withColumns({"share": share, "is_rarest": F.col("class") == rarest,
                               "imbalanced": (F.min("rows").over(whole) / F.sum("rows").over(whole)) < 0.05})


def scoring_truth(df: DataFrame, spec: FlowSpec) -> DataFrame:
    """Truth of a table to score: its class, or the label text itself.

    Rows without truth go, unless no row has any: then the table is unlabelled
    and keeps all its rows and no truth column. Deciding that is one small job.
    """
    out = df.withColumn(TARGET, truth_label(q(spec.label_column), spec.label_map)) \
        if TARGET not in df.columns and spec.label_column in df.columns else df
    if TARGET not in out.columns:
        return out
    if out.filter(F.col(TARGET).isNotNull()).limit(1).isEmpty():
        return out.drop(TARGET)
    return out.filter(F.col(TARGET).isNotNull())


def rename_capture(df: DataFrame, spec: FlowSpec) -> DataFrame:
    ts = spec.timestamp_column
    if ts and ts in df.columns and CAPTURE_TS not in df.columns:
        return df.withColumnRenamed(ts, CAPTURE_TS)
    return df


def stable_order(df: DataFrame, spec: FlowSpec) -> DataFrame:
    """Identity, capture time, features by name, class."""
    identity = [c for c in spec.identity if c in df.columns]
    capture = [CAPTURE_TS] if CAPTURE_TS in df.columns else []
    target = [TARGET] if TARGET in df.columns else []
    rest = sorted(c for c in df.columns if c not in {*identity, *capture, *target})
    return df.select(*[q(c) for c in (*identity, *capture, *rest, *target)])


def prune(df: DataFrame, spec: FlowSpec) -> DataFrame:
    return df.select(*[q(c) for c in df.columns if c in set(spec.retained)])
