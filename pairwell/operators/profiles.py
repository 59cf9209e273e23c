"""Profiles out of résumé text or out of a model's JSON reply."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.cleaning import fill_experience
from pairwell.functions.text import strip
from pairwell.operators.json import field, kind, with_json
from pairwell.operators.once import with_once
from pairwell.schemas import PROFILE

SECTIONS = {
    "skills": ["skills", "technical skills", "kỹ năng"],
    "description": ["summary", "profile", "about", "description"],
    "experience": ["experience", "work experience", "work history", "kinh nghiệm"],
}

# Called once per task; returns a function from texts to JSON replies.
Extractor = Callable[[], Callable[[list[str]], list[str]]]


def section(text: Column, names: list[str]) -> Column:
    """Body of the first Markdown section with one of the names; null without one."""
    heading = rf"(?im)^#+[ \t]*(?:{'|'.join(names)})[ \t]*:?[ \t]*$"
    body = rf"(?imsu)^#+[ \t]*(?:{'|'.join(names)})[ \t]*:?[ \t]*$(.*?)(?=^#|\z)"
    return F.when(F.regexp_like(text, F.lit(heading)), strip(F.regexp_extract(text, body, 1)))


def profile_from_sections(text: Column) -> Column:
    """Rule-based profile: first heading or line, and three named sections."""
    heading = strip(F.regexp_extract(text, r"(?m)^#[ \t]+(.*)$", 1))
    line = strip(F.regexp_extract(strip(text), r"\A[^\n]*", 0))
    title = F.coalesce(F.when(heading != "", heading), F.when(line != "", line))
    items = F.split(section(text, SECTIONS["skills"]), r"[,;\n]")
    skills = F.filter(
        F.transform(items, lambda item: strip(F.regexp_replace(item, r"^\s*[-*•]\s*", ""))),
        lambda item: item != "",
    )
    return F.struct(
        title.alias("title"),
        skills.alias("skills"),
        section(text, SECTIONS["description"]).alias("description"),
        fill_experience(section(text, SECTIONS["experience"])).alias("experience"),
    )


EXTRACTORS: dict[str, Callable[[Column], Column]] = {"sections": profile_from_sections}


def extract_profiles(df: DataFrame, text: str, extractor: str | Extractor = "sections") -> DataFrame:
    """Add ``profile`` and ``reason``; rows with a reason are rejects.

    ``extractor`` names a built-in rule set, or is a factory for a model that
    answers in JSON.
    """
    if callable(extractor):
        return read_replies(_ask(df, text, extractor), "reply")
    if extractor not in EXTRACTORS:
        raise ValueError(f"unknown extractor {extractor!r}; known: {sorted(EXTRACTORS)}")
    profile = with_once(df, "profile", EXTRACTORS[extractor](F.col(text)))
    missing = [F.when(F.col(f"profile.{name}").isNull(), F.lit(name)) for name in PROFILE.names]
    return profile.withColumn("reason", _reason(F.array_compact(F.array(*missing))))


def _ask(df: DataFrame, text: str, factory: Extractor) -> DataFrame:
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield batch.assign(reply=model(batch[text].tolist()))

    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType())])
    return df.mapInPandas(answer, schema)


def read_replies(df: DataFrame, reply: str) -> DataFrame:
    """Check a JSON reply field by field: three texts and a list of texts, all required."""
    parsed = with_json(df, reply, "parsed")
    whole = F.col("parsed")
    experience = field(whole, "experience", "string")
    no_experience = F.coalesce(kind(whole, "experience") == "VOID", F.lit(True)) | (experience == "")
    skills = field(whole, "skills", "array<variant>")
    good = {
        "title": kind(whole, "title") == "STRING",
        "skills": F.forall(skills, lambda item: F.schema_of_variant(item) == "STRING"),
        "description": kind(whole, "description") == "STRING",
        "experience": no_experience | (kind(whole, "experience") == "STRING"),
    }
    is_object = F.coalesce(kind(whole).startswith("OBJECT"), F.lit(False))
    wrong = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in good.items()])
    )
    profile = F.struct(
        field(whole, "title", "string").alias("title"),
        field(whole, "skills", "array<string>").alias("skills"),
        field(whole, "description", "string").alias("description"),
        F.when(no_experience, "N/A").otherwise(experience).alias("experience"),
    )
    reason = F.when(~is_object, "not a JSON object").otherwise(_reason(wrong))
    checked = with_once(parsed, "checked", F.struct(profile.alias("profile"), reason.alias("reason")))
    return checked.select(*df.columns, "checked.*")


def _reason(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit("missing or wrong: "), F.array_join(names, ", ")))


def valid_profiles(extracted: DataFrame, *keep: str) -> DataFrame:
    return extracted.filter(F.col("reason").isNull()).select(*keep, "profile.*")


def rejected_profiles(extracted: DataFrame, *keep: str) -> DataFrame:
    return extracted.filter(F.col("reason").isNotNull()).select(*keep, "reason")
