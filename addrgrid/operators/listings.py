"""Listing extraction from downloaded page text.

The fetch loop of the reference is network work and is not rebuilt; the
parsing part runs on a table of pages: match the link paths, split on '/',
keep the rows with the expected number of parts, de-duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HREF_PATH = r'href="/([^"]*)"'
SALE_PATH = r'residential/sale/[^<"]+'


def extract_listings(pages: DataFrame, pattern: str = HREF_PATH, group: int = 1,
                     names=("suburb",), html: str = "html") -> DataFrame:
    """Distinct tuples of path parts with exactly ``len(names)`` parts."""
    p = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(group))).alias("path"))
    parts = p.select(F.split("path", "/").alias("parts")).where(F.size("parts") == len(names))
    return parts.select(*[F.col("parts")[i].alias(n) for i, n in enumerate(names)]).distinct()


def extract_sale_listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """The original form: residential/sale/{region}/{district}/{suburb}."""
    p = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(SALE_PATH), F.lit(0))).alias("path"))
    parts = p.select(F.split("path", "/").alias("parts")).where(F.size("parts") == 5)
    return parts.select(F.col("parts")[2].alias("region"), F.col("parts")[3].alias("district"),
                        F.col("parts")[4].alias("suburb")).distinct()
