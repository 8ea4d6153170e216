"""From raw documents to a training mix, as stages that each keep what they wrote.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept;
all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.decontaminate import decontaminated
from tidewatch.llm.langid import UNDETERMINED, predict, trained
from tidewatch.llm.mixing import CYCLE, cycled, mix, repeated
from tidewatch.llm.neardup import deduplicated
from tidewatch.llm.registry import importable, table
from tidewatch.llm.secrets import find_secrets, redacted
from tidewatch.llm.tables import materialize
from tidewatch.session import drop_scratch, scratch_mark


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that can be told (no letters, no text) go."""
    importable(spark)
    found = predict(docs, trained(docs))
    return found.filter(F.col("found.lang_pred") != UNDETERMINED).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    importable(spark)
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    importable(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; a document with a cut has its length counted anew."""
    found = redacted(find_secrets(docs))
    cut = F.size("spans") > 0
    new = {"text": F.when(cut, F.col("clean")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(cut, F.length("clean").cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document comes once per copy taken."""
    return repeated(mix(docs, weigh=cycled(CYCLE)))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("mixing", mixing)]
# A fitted mixture, hash draws and suffix arrays decide: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stored on its way is dropped once it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = scratch_mark()
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_scratch(spark, mark, keep=docs)
    return docs
