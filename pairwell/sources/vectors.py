"""Vectors of texts, kept across batches and jobs.

The store is content-addressed: a row per model and text, under the SHA-256 of the text. A job asks
its model only for texts that the store does not hold, and adds their vectors as a part of its own. A part
counts once Spark has committed it; two jobs that add the same text leave two equal rows, of which one is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.sources.compaction import Folder

KEPT = T.StructType([T.StructField("text_key", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


@dataclass(frozen=True)
class VectorStore:
    """Folder of the store, and the name and version of the model whose vectors are meant."""

    path: str
    model: str

    def folder(self) -> str:
        if not self.model or not all(c.isalnum() or c in "._-" for c in self.model):
            raise ValueError("a model's name has letters, digits, dots, hyphens and underscores")
        return f"{self.path}/{self.model}"

    def parts(self, spark: SparkSession) -> list[str]:
        names = Folder(spark, self.folder()).names()
        return sorted(p for p in (f"{self.folder()}/{name}" for name in names) if Folder(spark, f"{p}/_SUCCESS").exists())

    def read(self, spark: SparkSession) -> DataFrame:
        """``(text_key, vector)`` of the model; a key may come twice."""
        parts = self.parts(spark)
        return spark.read.schema(KEPT).parquet(*parts) if parts else spark.createDataFrame([], KEPT)

    def known(self, keys: DataFrame) -> DataFrame:
        """The stored vectors of ``keys(text_key)``, one each. Only rows of these keys are shuffled, if any."""
        stored = self.read(keys.sparkSession)
        return stored.join(keys, "text_key", "left_semi").dropDuplicates(["text_key"])

    def add(self, vectors: DataFrame, part: str) -> str:
        """Write a part; the same name again replaces what an earlier try wrote. Returns its folder."""
        # Sorted keys and their Bloom filters let a look-up of few keys skip row groups.
        writer = vectors.select("text_key", "vector").sortWithinPartitions("text_key").write.mode("overwrite")
        writer.option("parquet.bloom.filter.enabled#text_key", "true").parquet(f"{self.folder()}/{part}")
        return f"{self.folder()}/{part}"

    def compact(self, spark: SparkSession, part: str, files: int) -> list[str]:
        """Write all vectors, one per key, as one part; returns the parts that it replaces, to be removed by the caller."""
        old = [p for p in self.parts(spark) if not p.endswith(f"/{part}")]
        whole = spark.read.schema(KEPT).parquet(*old) if old else spark.createDataFrame([], KEPT)
        self.add(whole.dropDuplicates(["text_key"]).repartition(files, "text_key"), part)
        return old
