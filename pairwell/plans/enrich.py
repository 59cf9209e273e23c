"""From decoded messages to enriched postings; the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.cleaning import (
    clean_description,
    clean_location,
    clean_min_experience,
    skill_list,
    skills_text,
)
from pairwell.operators.embed import DIM, Embedder, embed_columns
from pairwell.operators.sketch import NUM_PERM, skills_signature
from pairwell.schemas import POSTING
from pairwell.sources.messages import posting_id
from pairwell.sources.vectors import VectorStore

# Constants of every enriched posting.
DOC_TYPE = "job"
ORIGIN = "job_description"


def enrich(
    messages: DataFrame,
    embedder: Embedder | None = None,
    dim: int = DIM,
    num_perm: int = NUM_PERM,
    on_error: str = "raise",
    store: VectorStore | None = None,
) -> DataFrame:
    """Clean fields, split skills, sketch them and embed two texts.

    With ``on_error="reject"`` the columns ``value`` and ``embed_error`` follow; the latter
    is null where the model has embedded both texts. ``store`` keeps the model's vectors.
    """
    cleaned = messages.select(
        posting_id(F.col("link"), F.col("value")).alias("posting_id"),
        F.lit(DOC_TYPE).alias("doc_type"),
        "title",
        skill_list(F.col("required_skills")).alias("skills"),
        clean_description(F.col("description")).alias("description"),
        F.col("job_requirements").alias("experience"),
        clean_location(F.col("location")).alias("location"),
        clean_min_experience(F.col("min_experience_years"), F.col("min_experience_number")).alias(
            "experience_years"
        ),
        "link",
        "value",
    )
    sketched = cleaned.withColumn("skills_text", skills_text(F.col("skills"))).withColumn(
        "skills_signature", skills_signature(F.col("skills"), num_perm)
    )
    texts = {"description": "description_vector", "experience": "experience_vector"}
    vectors = embed_columns(sketched, texts, embedder, dim, on_error=on_error, store=store)
    metadata = F.struct(F.lit(ORIGIN).alias("source"), F.current_timestamp().alias("indexed_at"))
    extra = ["value", "embed_error"] if on_error == "reject" else []
    return vectors.withColumn("metadata", metadata).select(*POSTING.names, *extra)
