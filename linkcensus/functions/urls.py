"""URL normalization as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_url(column: str | Column) -> Column:
    """Struct of the five stages of one URL, from whole to domain.

    The scheme goes before lower-casing, so only a lower-case ``http(s)://`` is
    cut. ``domain_only`` is null where nothing stands before the first slash.
    """
    whole = F.trim(column)
    bare = F.regexp_replace(whole, r"[?#].*$", "")
    unslashed = F.regexp_replace(bare, r"/+$", "")
    schemeless = F.regexp_replace(unslashed, r"^https?://", "")
    return F.struct(
        F.lower(whole).alias("original_url"),
        F.lower(bare).alias("no_query_fragment"),
        F.lower(unslashed).alias("no_trailing_slash"),
        F.lower(schemeless).alias("no_scheme"),
        F.lower(F.regexp_substr(schemeless, F.lit(r"^[^/]+"))).alias("domain_only"),
    )
