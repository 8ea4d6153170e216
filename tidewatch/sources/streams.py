"""Streaming sources over folders or single files of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import is_directory


def stream_parquet(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of ``path`` as a stream, with the schema of the table there."""
    reader = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("maxFilesPerTrigger", files_per_batch))
    if is_directory(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)  # a streaming source lists folders only
    return reader.option("pathGlobFilter", name).parquet(folder)
