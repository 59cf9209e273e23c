"""Fields and text out of HTML kept as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwell.functions.cleaning import first_non_blank
from pairwell.functions.page_tree import decoded
from pairwell.functions.text import strip

# Tags that end a line.
LINE_TAGS = ["br", "p", "div", "li", "h1", "h2", "h3", "tr"]


def inner_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags removed, line tags as breaks, references decoded."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?i)<br\s*/?>|</(?:{'|'.join(LINE_TAGS[1:])})>", "\n")
    text = F.regexp_replace(text, r"<[^<>]*>", "")
    return strip(decoded(text))


def first_match(html: Column, patterns: list[str]) -> Column:
    """Text of the first pattern whose group 1 holds any visible character, else ``""``."""
    return first_non_blank(*[inner_text(F.regexp_extract(html, pattern, 1)) for pattern in patterns])
