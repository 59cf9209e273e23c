"""Crawl history: a headerless CSV of one URL per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """URLs seen so far; blank lines are skipped."""
    rows = spark.read.csv(path, schema="url string")
    return rows.filter(F.col("url") != "")


def append_history(links: DataFrame, path: str) -> None:
    links.select("url").write.mode("append").csv(path)
