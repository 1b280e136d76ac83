"""Text tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """path, text: a row for each file (whole, so that matches may cross lines) or for each line."""
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json_texts(spark: SparkSession, path: str, text_field: str = "text") -> DataFrame:
    return spark.read.json(path, schema=f"`{text_field}` string").select(F.col(text_field).alias("text"))


def write_matches(matches: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = matches.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
