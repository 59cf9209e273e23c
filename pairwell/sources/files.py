"""Document files and side outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_documents(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """``(path, content)`` of files with the suffix in any case; a missing path is an error."""
    any_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return files.option("pathGlobFilter", f"*{any_case}").load(path).select("path", "content")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, other scripts left as they are."""
    df.write.mode("overwrite").json(path)


def write_texts(converted: DataFrame, path: str) -> None:
    """Converted text keyed by file stem."""
    converted.select("stem", "text").write.mode("overwrite").parquet(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Rows that failed, with the raw input and the reason."""
    rejects.write.mode("append").parquet(path)
