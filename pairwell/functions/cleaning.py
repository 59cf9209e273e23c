"""Cleaning rules for posting and profile fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwell.functions.text import SPACES, strip

# Marks of location lines to drop, and the heading to remove.
DROPPED_LOCATION_MARKS = ["Hết hạn", "lượt xem"]
DESCRIPTION_HEADING = "mô tả công việc"
PAGE_SIZE = 50


def clean_location(text: Column) -> Column:
    """Lines without expiry or view-count marks, stripped, joined by commas."""
    dropped = "|".join(DROPPED_LOCATION_MARKS)
    lines = F.filter(F.split(text, "\n", -1), lambda line: ~F.regexp_like(line, F.lit(dropped)))
    return F.coalesce(F.array_join(F.transform(lines, strip), ", "), F.lit(""))


def clean_description(text: Column) -> Column:
    """Drop every section heading, collapse line breaks, strip."""
    body = F.regexp_replace(text, f"(?iu){DESCRIPTION_HEADING}[:{SPACES}]*", "")
    return F.coalesce(strip(F.regexp_replace(body, r"\n+", "\n")), F.lit(""))


def clean_min_experience(text: Column, number: Column | None = None) -> Column:
    """Years as INT: a JSON number is truncated, a text gives its first digits, else 0."""
    digits = F.regexp_extract(text, r"\d+", 0).try_cast("int")
    if number is None:
        return F.coalesce(digits, F.lit(0))
    return F.coalesce(number.try_cast("int"), digits, F.lit(0))


def skill_list(text: Column) -> Column:
    """Comma-separated skills, stripped; blank items stay."""
    items = F.transform(F.split(text, ",", -1), strip)
    return F.when(text != "", items).otherwise(F.array().cast("array<string>"))


def skills_text(skills: Column) -> Column:
    return F.array_join(skills, " ")


def fill_experience(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "N/A").otherwise(text)


def first_non_blank(*texts: Column) -> Column:
    """The first text with any visible character, else the empty string."""
    return F.coalesce(*[F.when(strip(text) != "", text) for text in texts], F.lit(""))


def grouped_int(text: Column) -> Column:
    """Integer written with thousands commas; null when unreadable."""
    return strip(F.replace(text, F.lit(","), F.lit(""))).try_cast("int")


def page_count(total_text: Column, page_size: int = PAGE_SIZE) -> Column:
    """List pages needed for a total; 1 when the total is unreadable."""
    return F.coalesce(F.ceil(grouped_int(total_text) / page_size), F.lit(1)).cast("int")
