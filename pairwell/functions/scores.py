"""Score formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank constant, BM25 parameters and channel weights.
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75
BM25_BOOST = 2.0
TOP_K_PER_CHANNEL = 10
FINAL_K = 5
CHANNEL_WEIGHTS = {
    "sem_description_vector": 1.2,
    "sem_experience_vector": 0.8,
    "lsh_minhash": 1.5,
    "bm25": 1.0,
}

SCORE_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_plus_one(a: Column, b: Column) -> Column:
    """Cosine similarity moved to the range 0..2."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)) + 1.0


def sketch_jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x
    )
    return same / F.size(a)


def rrf_term(weight: Column, rank: Column, k: int = RRF_K) -> Column:
    return weight / (F.lit(k) + rank)


def bm25_idf(docs_with_term: Column, docs: int) -> Column:
    return F.log(1 + (F.lit(docs) - docs_with_term + 0.5) / (docs_with_term + 0.5))
