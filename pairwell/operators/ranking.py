"""Top-k per group and rank numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """Best ``k`` rows per group, numbered from 1 in column ``rank``.

    Spark cuts every map-side partition to ``k`` rows per group before the
    shuffle, so a hot group never travels whole.
    """
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def as_channel(best: DataFrame, k: int) -> DataFrame:
    """Ranked lists ``(cv_id, doc_id, source, rank, raw_score)`` of searches."""
    ranked = top_k(best, ["cv_id", "source"], "score", "doc_id", k)
    return ranked.select("cv_id", "doc_id", "source", "rank", F.col("score").alias("raw_score"))
