"""Where are the URLs of a watch-list still referenced? A census on Spark."""

from linkcensus.model import BRANCHES, SCHEMAS, Scope
from linkcensus.plans.census import branch_counts, census, watch_list
from linkcensus.sources.tables import Tables, catalog_tables, frames, read_tables
from linkcensus.sources.watchlist import normalized_terms, raw_terms, watchlist_from_rows, watchlist_from_text

__all__ = [
    "BRANCHES", "SCHEMAS", "Scope", "Tables", "branch_counts", "catalog_tables", "census", "frames",
    "normalized_terms", "raw_terms", "read_tables", "watch_list", "watchlist_from_rows", "watchlist_from_text",
]
