"""Records at the sites of a scope."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcensus.model import Scope
from linkcensus.operators.keys import BROADCAST_ROWS

LITERAL_SITES = 1_000  # a table of so many sites becomes a list, which prunes partitions and is pushed into scans


def resolved(scope: Scope) -> Scope:
    """The scope with a table of sites looked at once: a list if it is short, else a table without nulls and repeats."""
    if scope.sites is None or isinstance(scope.sites, tuple):
        return scope
    listed = scope.sites.select(F.col(scope.sites.columns[0]).cast("bigint").alias("_site")).filter("_site IS NOT NULL").distinct()
    start = [r._site for r in listed.limit(LITERAL_SITES + 1).collect()]
    if len(start) <= LITERAL_SITES:
        return replace(scope, sites=tuple(sorted(start)))
    return replace(scope, sites=F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed)


def at_sites(df: DataFrame, scope: Scope, column: str = "site_oi") -> DataFrame:
    """Rows of ``df`` at a site of a resolved scope."""
    if scope.sites is None:
        return df
    if isinstance(scope.sites, tuple):
        return df.filter(F.col(column).isin([s for s in scope.sites if s is not None]))
    return df.join(scope.sites, F.col(column) == F.col("_site"), "left_semi")


def at_listed_sites(df: DataFrame, sites: DataFrame, column: str = "site_oi") -> DataFrame:
    """Rows of ``df`` whose site is in ``sites``; a site listed twice counts once."""
    return at_sites(df, resolved(Scope(sites=sites)), column)
