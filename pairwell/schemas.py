"""Record types."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and order of a raw posting message.
MESSAGE_FIELDS = [
    "title",
    "location",
    "description",
    "required_skills",
    "min_experience_years",
    "job_requirements",
    "link",
]

# What a field becomes when its key is absent.
MESSAGE_DEFAULTS = {
    "title": "Unknown",
    "location": "",
    "description": "",
    "required_skills": "",
    "min_experience_years": "0",
    "job_requirements": "",
    "link": "",
}

POSTING = T.StructType(
    [
        T.StructField("posting_id", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("skills_signature", T.ArrayType(T.LongType())),
        T.StructField("skills_text", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("description_vector", T.ArrayType(T.FloatType())),
        T.StructField("experience", T.StringType()),
        T.StructField("experience_vector", T.ArrayType(T.FloatType())),
        T.StructField("location", T.StringType()),
        T.StructField("experience_years", T.IntegerType()),
        T.StructField("link", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("source", T.StringType()),
                    T.StructField("indexed_at", T.TimestampType()),
                ]
            ),
        ),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("experience", T.StringType()),
    ]
)
