"""The supplied Parquet tables, and listings of folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, modified) of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def contents(spark: SparkSession, path: str, most: int = 64 << 20) -> DataFrame:
    """path, length, content (bytes) and text (UTF-8; NULL where it isn't) of whole files, of at most so many bytes; larger ones have NULL content."""
    files = spark.read.format("binaryFile").load(path)
    content = F.when(F.col("length") <= most, F.col("content"))
    return files.select("path", "length", content.alias("content"), F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).alias("text"))
