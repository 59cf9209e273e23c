"""Posting pages: fields by rule, and list-page addresses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.cleaning import PAGE_SIZE, page_count
from pairwell.functions.markup import first_match
from pairwell.functions.page_tree import AfterLabel, Path, Selector, UnderHeading, WithAttribute, field_texts

# The labels and places that mark each field on a posting page.
POSTING_RULES: dict[str, list[str | Selector]] = {
    "title": [WithAttribute("h1", "name", "title")],
    "location": [AfterLabel("Địa điểm làm việc", "div", 3)],
    "description": [AfterLabel("Nộp đơn", "div", 5)],
    "required_skills": [AfterLabel("KỸ NĂNG", "p")],
    "min_experience_years": [AfterLabel("SỐ NĂM KINH NGHIỆM TỐI THIỂU", "p")],
    "job_requirements": [
        Path(
            "vnwLayout__col",
            [("div", None), ("div", 3), ("div", None), ("div", None), ("div", 2), ("div", 2), ("div", None)],
        ),
        Path(
            "__next",
            [("main", None), ("div", None), ("main", None), ("div", None), ("div", 3), ("div", 1), ("div", 2), ("div", None)],
        ),
        UnderHeading("h2", "Yêu cầu công việc", "div", "sc-1671001a-6"),
        AfterLabel("Yêu cầu công việc", "div"),
    ],
}


def extract_page_fields(
    pages: DataFrame,
    rules: Mapping[str, list[str | Selector]] = POSTING_RULES,
    html: str = "html",
    url: str = "url",
    defaults: Mapping[str, str] = {"min_experience_years": "0"},
) -> DataFrame:
    """One raw message per page; a field no rule finds gets its default or ``""``.

    A rule is a selector, or a pattern whose group 1 is the field; the rules of one field are
    all of one sort. Pages without any HTML are dropped.
    """
    fields = []
    chosen = {name: found for name, found in rules.items() if found and not isinstance(found[0], str)}
    if chosen:
        pages = pages.filter(F.col(html).isNotNull()).withColumn("page_texts", field_texts(F.col(html), chosen))
    for name, patterns in rules.items():
        text = F.col(f"page_texts.{name}") if name in chosen else first_match(F.col(html), patterns)
        default = defaults.get(name, "")
        fields.append((F.when(text != "", text).otherwise(default) if default else text).alias(name))
    known = pages.filter(F.col(html).isNotNull())
    return known.select(*[c for c in pages.columns if c not in (html, url, "page_texts")], *fields, F.col(url).alias("link"))


def list_page_urls(
    totals: DataFrame, total: str, template: str, start: int = 1, page_size: int = PAGE_SIZE
) -> DataFrame:
    """One row per list page: ``template`` with ``{page}`` filled in."""
    before, after = template.split("{page}")
    count = page_count(F.col(total), page_size)
    numbers = F.when(count >= start, F.sequence(F.lit(start), count))
    return totals.withColumn("page", F.explode(numbers)).withColumn(
        "page_url", F.concat(F.lit(before), F.col("page").cast("string"), F.lit(after))
    )
