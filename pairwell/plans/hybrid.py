"""Hybrid search: four ranked lists from one pass over the postings, fused."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.scores import CHANNEL_WEIGHTS, FINAL_K, TOP_K_PER_CHANNEL
from pairwell.functions.text import tokens
from pairwell.operators.block_join import Limits, best_of_each, measured
from pairwell.operators.bm25 import bm25_search
from pairwell.operators.embed import DIM, Embedder, embed_columns
from pairwell.operators.fusion import explain_sources, rrf
from pairwell.operators.lsh import lsh_search
from pairwell.operators.ranking import as_channel
from pairwell.operators.sketch import NUM_PERM, THRESHOLD, skills_signature
from pairwell.operators.vector import vector_search
from pairwell.session import shared_dir


def prepare_profiles(
    profiles: DataFrame,
    embedder: Embedder | None = None,
    dim: int = DIM,
    num_perm: int = NUM_PERM,
    on_error: str = "raise",
) -> DataFrame:
    """Add what the searches need to ``(cv_id, title, skills, description, experience)``.

    ``on_error="zero"`` gives a text on which the model fails the zero vector, which stands
    for no query.
    """
    sketched = profiles.withColumn("skills_signature", skills_signature(F.col("skills"), num_perm))
    texts = {"description": "description_vector", "experience": "experience_vector"}
    return embed_columns(sketched, texts, embedder, dim, on_error=on_error)


#: Columns of a posting that the searches read, besides the words of its title.
SEARCHED = ("skills_signature", "description_vector", "experience_vector")


def search_columns(postings: DataFrame) -> DataFrame:
    """``(doc_id, tokens, skills_signature, two vectors)`` of postings, written once.

    For postings whose search columns are computed: they are computed once, however often they are read.
    Stored postings need no copy.
    """
    rows = searched(postings)
    path = shared_dir(postings.sparkSession, "search-columns")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def searched(postings: DataFrame) -> DataFrame:
    """What the searches read of postings; a column ``tokens`` (words of the title) is taken as it is."""
    words = F.col("tokens") if "tokens" in postings.columns else tokens(F.col("title"))
    return postings.select("doc_id", words.alias("tokens"), *SEARCHED)


def search_channels(
    profiles: DataFrame,
    postings: DataFrame,
    k: int = TOP_K_PER_CHANNEL,
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    limits: Limits = Limits(),
    digits: int | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Ranked lists ``(cv_id, doc_id, source, rank, raw_score)`` by description, experience, skills and title.

    All four come from one scan of the postings. Without ``stats`` (stored term statistics,
    ``bm25.term_counts``) the words of all titles are counted first, in a pass that reads nothing else.
    ``digits`` rounds scores before they rank.
    """
    stored = searched(postings)
    description, experience = "description_vector", "experience_vector"
    searches = [
        vector_search(profiles, description, description, "sem_description_vector", digits),
        vector_search(profiles, experience, experience, "sem_experience_vector", digits),
        lsh_search(profiles, threshold, num_perm, "sketch", "lsh_minhash", digits, "skills_signature", "skills_signature"),
        bm25_search(profiles, stored, limits=limits, digits=digits, stats=stats),
    ]
    return as_channel(best_of_each(searches, stored, k, limits), k)


def hybrid_match(
    profiles: DataFrame,
    postings: DataFrame,
    k: int = TOP_K_PER_CHANNEL,
    final_k: int | None = FINAL_K,
    weights: Mapping[str, float] = CHANNEL_WEIGHTS,
    limits: Limits = Limits(),
    digits: int | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """The best postings of every profile: ``(cv_id, doc_id, rrf_score, sources, rank)``."""
    fused = rrf([search_channels(profiles, postings, k, limits=limits, digits=digits, stats=stats)], weights, digits=digits)
    return fused if final_k is None else fused.filter(F.col("rank") <= final_k)


def with_documents(matches: DataFrame, postings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add title, skills and experience of the matched postings.

    The matches are computed and written first. If their measured size fits the
    bound they are broadcast and the postings are not shuffled.
    """
    fields = postings.select("doc_id", "title", "skills", "experience")
    path = shared_dir(matches.sparkSession, "matches")
    matches.write.parquet(path)
    matches = matches.sparkSession.read.schema(matches.schema).parquet(path)
    ids = F.octet_length(F.concat(F.col("cv_id").cast("string"), F.col("doc_id").cast("string")))
    if measured(matches, ids + F.octet_length(explain_sources(F.col("sources"))) + 64) <= limits.broadcast_bytes:
        return fields.join(F.broadcast(matches), "doc_id")
    return matches.join(fields, "doc_id")


def report(found: DataFrame) -> DataFrame:
    """Display form: shortened title and experience, score text, reasons as JSON."""
    return found.select(
        "cv_id",
        "rank",
        "doc_id",
        F.left("title", F.lit(40)).alias("title"),
        F.format_number("rrf_score", 5).alias("score"),
        F.array_join("skills", ", ").alias("skills"),
        F.concat(F.left("experience", F.lit(100)), F.lit("...")).alias("experience"),
        explain_sources(F.col("sources")).alias("why"),
    )
