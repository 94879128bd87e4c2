"""Load a watch-list and turn it into match terms."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcensus.functions.urls import normalized_url


def _not_blank(column: str) -> Column:
    return F.col(column).isNotNull() & (F.trim(column) != "")


def watchlist_from_rows(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    """A watch-list from values in the program; null and blank entries go."""
    rows = pa.table({"url_pref": pa.array(list(urls), pa.string())})
    return spark.createDataFrame(rows).filter(_not_blank("url_pref"))


def watchlist_from_text(spark: SparkSession, path: str) -> DataFrame:
    """A watch-list from text files, one URL per line."""
    return spark.read.text(path).select(F.trim("value").alias("url_pref")).filter(_not_blank("url_pref"))


def raw_terms(watchlist: DataFrame) -> DataFrame:
    """The listed URLs as they are, in lower case: ``match_term``."""
    return watchlist.filter(_not_blank("url_pref")).select(F.lower("url_pref").alias("match_term"))


def normalized_terms(watchlist: DataFrame) -> DataFrame:
    """Path term and domain term of every listed URL: ``match_term``."""
    parts = watchlist.select(normalized_url("url_pref").alias("u"))
    return (
        parts.select(F.explode(F.array("u.no_scheme", "u.domain_only")).alias("match_term"))
        .filter(F.col("match_term").isNotNull() & (F.col("match_term") != ""))
        .distinct()
    )
