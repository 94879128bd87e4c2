"""The logical tables, derived by plain arithmetic from the test-data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkcensus.sources.tables import Tables
from linkcensus.sources.watchlist import watchlist_from_rows

# Parameters that go with this binding.
SITES = (3, 7, 11, 17, 19, 23)
WATCHLIST = (
    "Example.ORG/en",
    "Example.ORG/en/7",
    "https://example.net/fr/?ref=x#top",
    "THAND",
    "License",
    "small ring",
    ": 42}",
    "Household",
)

# The columns read, with their stored types; saves schema discovery.
_STORED = {
    "region": "r_regionkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "events": "event_id bigint, user_id bigint, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string",
    "conversations": "conv_id bigint, text string",
}

_CONTAINERS = 97
_EMBEDDED = "CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 END AS embedded"

_BINDINGS: dict[str, tuple[str, list[str]]] = {
    "asset": ("part", ["p_partkey AS assetoi", "p_size % 25 AS site_oi",
                       f"p_partkey % {_CONTAINERS} AS attachmentco_oi", "p_name AS image"]),
    "conditionindicator": ("supplier", ["s_nationkey AS site_oi", f"s_suppkey % {_CONTAINERS} AS attachmentco_oi"]),
    "indicatorreading": ("events", ["user_id % 25 AS site_oi", f"event_id % {_CONTAINERS} AS attachmentco_oi"]),
    "mtceschedule": ("customer", ["c_nationkey AS site_oi", f"c_custkey % {_CONTAINERS} AS attachmentco_oi"]),
    "project": ("supplier", ["s_nationkey AS site_oi", f"(s_suppkey * 7) % {_CONTAINERS} AS attachmentco_oi"]),
    "standardtask": ("documents", ["doc_id % 25 AS site_oi", f"doc_id % {_CONTAINERS} AS attachmentco_oi",
                                   "text AS longdescript"]),
    "standardjob": ("documents", ["n_chars % 25 AS site_oi", "text AS longdescript"]),
    "workorders": ("orders", ["o_orderkey AS workordersoi", "o_custkey % 25 AS site_oi",
                              "int(substr(o_orderpriority, 1, 1)) AS wostatus",
                              f"o_orderkey % {_CONTAINERS} AS attachmentco_oi"]),
    "workordertask": ("documents", ["doc_id AS workordertaskoi", "doc_id AS workorder_oi",
                                    f"doc_id % {_CONTAINERS} AS attachmentco_oi", "text AS longdescript"]),
    "workrequest": ("customer", ["c_custkey AS workrequestoi", "c_nationkey AS site_oi", "c_custkey % 8 AS wrstatus",
                                 f"c_custkey % {_CONTAINERS} AS attachmentco_oi", "c_mktsegment AS longdescript"]),
    "workrequestcomment": ("conversations", ["conv_id AS workrequest_oi", "text AS commen"]),
    "activityreport": ("events", ["event_id % 200 AS wotask_oi", "user_id % 25 AS site_oi", "props AS taskcomment"]),
    "epworkordermilesto": ("documents", ["doc_id AS workorders_oi", "text AS mscomment"]),
    "eprecommendations": ("documents", ["doc_id % 200 AS asset_oi", "source AS epprojectsha", "text AS epdescriptio"]),
    "closure": ("part", ["p_partkey % 25 AS parent_oi", "p_size AS child_oi"]),
    "attcontainter": ("pages", [f"page_id % {_CONTAINERS} AS attachmentcontaineroi"]),
    "attachment": ("pages", [f"page_id % {_CONTAINERS} AS attcontainer_oi", "url AS filename", _EMBEDDED]),
    "site": ("nation", ["n_nationkey AS siteoi", "n_nationkey AS topasset_oi", "n_regionkey AS timezone_oi"]),
    "timezone": ("region", ["r_regionkey AS omtimezoneoi"]),
    "stdprocedures": ("supplier", ["s_suppkey AS stdprocedureanddocumentsoi", "s_nationkey AS site_oi",
                                   "s_suppkey % 7 AS stddproctype_oi", "s_suppkey AS currentrev_oi"]),
    "stdprocdoctypes": ("region", ["r_regionkey AS stdproceduresanddocstypesoi"]),
    "stdprocedureversn": ("pages", ["page_id AS stdprocedureversionoi", "page_id % 10 AS stdprocedure_oi",
                                    "url AS docmgmtfile"]),
}


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    scans: dict[str, DataFrame] = {}

    def scan(table: str) -> DataFrame:
        if table not in scans:
            scans[table] = spark.read.schema(_STORED[table]).parquet(f"{sf_dir}/{table}.parquet")
        return scans[table]

    def load(name: str) -> DataFrame:
        table, columns = _BINDINGS[name]
        df = scan(table).selectExpr(*columns)
        return df.distinct() if name == "attcontainter" else df

    return Tables(load)


def driver_watchlist(spark: SparkSession) -> DataFrame:
    return watchlist_from_rows(spark, WATCHLIST)
