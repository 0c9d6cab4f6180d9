"""Ids inside stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Link patterns of game and team pages.
GAME_LINK = r"contests/(\d+)/"
TEAM_LINK = r"/teams/(\d+)"


def link_ids(pages: DataFrame, pattern: str, key: str = "page_id", text: str = "html") -> DataFrame:
    """Distinct ids captured by the pattern in each page's whole text."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return pages.select(key, F.explode(F.array_distinct(found)).alias("link_id"))
