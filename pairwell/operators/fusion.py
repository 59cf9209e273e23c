"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions.scores import CHANNEL_WEIGHTS, RRF_K, rrf_term


def _by_source(values: Mapping[str, float]) -> Column:
    pairs = [F.lit(part) for item in values.items() for part in item]
    return F.create_map(*pairs)[F.col("source")]


def rrf(
    channels: list[DataFrame],
    weights: Mapping[str, float] = CHANNEL_WEIGHTS,
    k: int = RRF_K,
    digits: int | None = None,
) -> DataFrame:
    """Fuse ranked lists into ``(cv_id, doc_id, rrf_score, sources, rank)``.

    ``sources`` maps a channel to its rank and raw score. Ties go to the smaller
    ``doc_id``; ``digits`` rounds the score before it ranks.
    """
    hits = reduce(DataFrame.unionByName, channels)
    entry = F.struct("source", F.struct("rank", "raw_score"))
    # Added up in the order of the channels, so that equal ranks give equal sums.
    terms = F.array_sort(F.collect_list(rrf_term(_by_source(weights), F.col("rank"), k)))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    fused = hits.groupBy("cv_id", "doc_id").agg(
        (total if digits is None else F.round(total, digits)).alias("rrf_score"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sources"),
    )
    order = Window.partitionBy("cv_id").orderBy(F.col("rrf_score").desc(), F.col("doc_id").asc())
    return fused.withColumn("rank", F.row_number().over(order))


def channel_counts(channels: list[DataFrame]) -> DataFrame:
    """Hits per profile and channel."""
    hits = reduce(DataFrame.unionByName, channels)
    return hits.groupBy("cv_id", "source").agg(F.count("*").alias("hits"))


def explain_sources(sources: Column) -> Column:
    """Why a posting matched, as JSON."""
    return F.to_json(sources)
