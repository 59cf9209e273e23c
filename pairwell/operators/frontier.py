"""Links still to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.encode import url_key
from pairwell.functions.page_tree import element_html, links

# What a posting link contains, and what a company link contains.
POSTING_LINK = "-jv"
COMPANY_LINK = "/nha-tuyen-dung/"
# Fixed value: the list of postings on a list page.
LIST_SCOPE = ("div", "class", "block-job-list")


def discover_links(
    pages: DataFrame,
    include: str = POSTING_LINK,
    exclude: str = COMPANY_LINK,
    page_id: str = "page_id",
    html: str = "html",
    scope: tuple[str, str, str] | None = LIST_SCOPE,
    base: str | None = None,
) -> DataFrame:
    """Every wanted link of every page: ``(page_id, position, url, url_key)``.

    ``scope`` names the element whose links count by tag, attribute and value; ``None`` reads
    the whole page. Relative targets are resolved against the page's address, column ``base``.
    """
    part = element_html(F.col(html), *scope) if scope else F.col(html)
    targets = links(part, None if base is None else F.col(base))
    found = pages.select(F.col(page_id).alias("page_id"), F.posexplode(targets).alias("position", "url"))
    url = F.col("url")
    wanted = (url != "") & url.contains(include) & ~url.contains(exclude)
    return found.filter(wanted).withColumn("url_key", url_key(url))


def distinct_links(found: DataFrame) -> DataFrame:
    """One row per key, as first seen by page and position.

    The minimum is taken map-side first, so a link on every page costs one row
    per task.
    """
    first = F.min(F.struct("page_id", "position", "url")).alias("first")
    return found.groupBy("url_key").agg(first).select("url_key", "first.*")


def unseen(found: DataFrame, history: DataFrame, history_url: str = "url") -> DataFrame:
    """Distinct links whose key is not in the history.

    Both sides are reduced to one row per key before they meet, so no key is hot.
    """
    seen = history.select(url_key(F.col(history_url)).alias("url_key")).distinct()
    return distinct_links(found).join(seen, "url_key", "left_anti")


def merged_history(history: DataFrame, new_links: DataFrame) -> DataFrame:
    """Distinct keys of the history and the new links together."""
    keys = history.select(url_key(F.col("url")).alias("url_key"))
    return keys.union(new_links.select("url_key")).distinct()
