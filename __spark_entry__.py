
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from linkcensus import BRANCHES, Scope, branch_counts, census, normalized_terms, raw_terms, watch_list, watchlist_from_rows  # noqa: E402
from linkcensus.functions.matching import WatchList, keep_matching  # noqa: E402
from linkcensus.functions.urls import normalized_url  # noqa: E402
from linkcensus.operators.attachments import attachment_kind, chain_rows  # noqa: E402
from linkcensus.operators.covering import without_covered_terms  # noqa: E402
from linkcensus.operators.procedures import in_hierarchy, procedure_tree  # noqa: E402
from linkcensus.operators.scope import at_listed_sites, at_sites  # noqa: E402
from linkcensus.operators.staging import Staging  # noqa: E402
from linkcensus.sources.driver_tables import SITES, driver_tables, driver_watchlist  # noqa: E402

try:  # the training-data operators are a subpackage of their own; they, or a library of theirs, may be absent
    import corpus_pipeline
    from linkcensus.llm.queries import ORACLES, QUERIES
except ImportError as error:
    print(f"training-data queries are left out: {error}", file=sys.stderr)
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    LLM_QUERIES, LLM_ORACLES = {**QUERIES, "pipeline": corpus_pipeline.run}, ORACLES

Query = Callable[[SparkSession, str], DataFrame]
SCOPED = Scope(sites=SITES)

# LIKE terms with wildcards, for the matcher's own query.
LIKE_TERMS = ("thand", "li_ense", "small ring", "tele%number", "50%off_")
# A watch-list with wildcards, for a report.
WILD_URLS = ("https://%.example.net/fr/_?", "HTTP://m.%/EN/5__", ".example.com/de/%ref=_", "li_ense%see", "Small%G", "\"k\": _}", "ma_hine%")
# What a task may hold of a list, to send a short one through the join that long lists take.
SMALL_TASK = 1_000


def entry(spark: SparkSession) -> DataFrame:
    """The scoped census over sf0.001."""
    return report_scoped_like(spark, "/root/testdata/sf0.001")


def report_scoped_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census(driver_tables(spark, sf_dir), driver_watchlist(spark), "like", SCOPED)


def report_scoped_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census(driver_tables(spark, sf_dir), driver_watchlist(spark), "instr", SCOPED)


def report_all_sites_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census(driver_tables(spark, sf_dir), driver_watchlist(spark), "like", Scope())


def report_site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoped report with its sites from a table, repeated and null ones in it."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sites = nations.join(spark.createDataFrame([(s,) for s in (*SITES, *SITES)], "s int"), F.col("n_nationkey") == F.col("s"), "left").select("s")
    return census(driver_tables(spark, sf_dir), driver_watchlist(spark), "like", Scope(sites=sites))


def report_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census(driver_tables(spark, sf_dir), watchlist_from_rows(spark, WILD_URLS), "like", Scope())


def _branch(code: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        watch = watch_list(driver_watchlist(spark), "like")
        counts = branch_counts(driver_tables(spark, sf_dir), watch, SCOPED, [code])
        return counts.select("entity", "count_value")

    return query


def _listed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch-list that grows with the data: the URL of every page."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("url_pref"))


def watchlist_terms_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_terms(_listed_pages(spark, sf_dir))


def match_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_terms(_listed_pages(spark, sf_dir))


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", normalized_url("url").alias("u")).select("page_id", "u.*")


def site_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.createDataFrame([(s,) for s in SITES], "site_oi bigint")
    return at_listed_sites(driver_tables(spark, sf_dir)["asset"], sites).select("assetoi", "site_oi")


def embedded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = driver_tables(spark, sf_dir)["attachment"].select("filename", attachment_kind().alias("kind"))
    return kinds.filter(F.col("kind").isNotNull())


def status_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_tables(spark, sf_dir)["workorders"].filter(SCOPED.open_order()).select("workordersoi", "wostatus")


def status_filter_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_tables(spark, sf_dir)["workrequest"].filter(SCOPED.open_request()).select("workrequestoi", "wrstatus")


def contains_any_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in LIKE_TERMS], "match_term string")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return keep_matching(documents, WatchList(terms, "like"), "text", staging=Staging(spark)).select("doc_id")


def contains_any_instr(spark: SparkSession, sf_dir: str) -> DataFrame:
    watch = watch_list(driver_watchlist(spark), "instr")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return keep_matching(pages, watch, "html", staging=Staging(spark)).select("page_id")


def contains_any_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that mention the path of any page: a list that grows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    terms = pages.select(normalized_url("url")["no_scheme"].alias("match_term"))
    return keep_matching(pages, WatchList(terms, "instr"), "url", "html", staging=Staging(spark), keep=["page_id"])


def _fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents from their 200th character on, and terms from what stands before: four pieces of each document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = F.array(*[F.lower(F.substring("text", a, 30)) for a in (11, 41, 71, 101)])
    terms = documents.select(F.explode(pieces).alias("match_term")).filter("length(match_term) = 30")
    return documents.selectExpr("doc_id", "substring(text, 200) AS text"), terms


def contains_any_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a piece of any document, literally: thousands of terms."""
    documents, terms = _fragments(spark, sf_dir)
    return keep_matching(documents, WatchList(terms, "instr"), "text", staging=Staging(spark), keep=["doc_id"])


def contains_any_beyond_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with wildcards, and the list beyond what a task may hold."""
    documents, terms = _fragments(spark, sf_dir)
    watch = WatchList(terms, "like", task_chars=SMALL_TASK)
    return keep_matching(documents, watch, "text", staging=Staging(spark), keep=["doc_id"])


def reduced_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and text pieces without those that hold another one."""
    terms = normalized_terms(_listed_pages(spark, sf_dir)).unionByName(_fragments(spark, sf_dir)[1])
    terms = terms.select(F.explode(F.array("match_term", F.substring("match_term", 5, 9))).alias("match_term"))
    return without_covered_terms(terms.filter("match_term <> ''"), False, Staging(spark))


def contains_any_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    watch = watch_list(driver_watchlist(spark), "like")
    rows = driver_tables(spark, sf_dir)["eprecommendations"]
    found = keep_matching(rows, watch, "epprojectsha", "epdescriptio", staging=Staging(spark))
    return found.groupBy("asset_oi").agg(F.count(F.lit(1)).alias("n"))


def attachment_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = driver_tables(spark, sf_dir)
    return chain_rows(tables, at_sites(tables["asset"], SCOPED))


def hierarchy_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = driver_tables(spark, sf_dir)
    return in_hierarchy(tables, SCOPED, tables["asset"]).select("assetoi", "site_oi")


def procedure_tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procedure_tree(driver_tables(spark, sf_dir))


def zero_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list nothing mentions still gives a row per entity."""
    nowhere = spark.createDataFrame([("https://no.such.host.invalid/at/all",)], "url_pref string")
    return census(driver_tables(spark, sf_dir), nowhere, "like", SCOPED)


def queries() -> dict[str, Query]:
    return {
        "watchlist_terms_raw": watchlist_terms_raw,
        "url_normalize": url_normalize,
        "match_terms": match_terms,
        "site_scope": site_scope,
        "embedded_split": embedded_split,
        "status_filter_orders": status_filter_orders,
        "status_filter_requests": status_filter_requests,
        "contains_any_like": contains_any_like,
        "contains_any_instr": contains_any_instr,
        "contains_any_long_list": contains_any_long_list,
        "contains_any_thousands": contains_any_thousands,
        "contains_any_beyond_task": contains_any_beyond_task,
        "contains_any_two_columns": contains_any_two_columns,
        "reduced_terms": reduced_terms,
        "attachment_chain": attachment_chain,
        "hierarchy_semi": hierarchy_semi,
        "procedure_tree": procedure_tree_rows,
        "zero_entities": zero_entities,
        **{f"branch_{code.lower()}": _branch(code) for code in BRANCHES},
        "report_scoped_like": report_scoped_like,
        "report_scoped_normalized": report_scoped_normalized,
        "report_all_sites_like": report_all_sites_like,
        "report_wildcards": report_wildcards,
        "report_site_table": report_site_table,
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    with_tables = oracle.with_tables
    normal = oracle.normalize("url")
    like = " OR ".join(f"lower(text) LIKE '%{t}%'" for t in LIKE_TERMS)
    return {
        "watchlist_terms_raw": "SELECT lower(url) AS match_term FROM pages WHERE trim(url) <> ''",
        "url_normalize": "SELECT page_id, " + ", ".join(f"{sql} AS {c}" for c, sql in normal.items()) + " FROM pages",
        "match_terms": f"SELECT term AS match_term FROM ({oracle.normalized('pages', 'url')})",
        "site_scope": with_tables(["asset"], f"SELECT assetoi, site_oi FROM asset WHERE site_oi IN {SITES}"),
        "embedded_split": with_tables(
            ["attachment"],
            "SELECT filename, 'file' AS kind FROM attachment WHERE embedded = 0 OR embedded IS NULL"
            " UNION ALL SELECT filename, 'embedded' AS kind FROM attachment WHERE embedded = 1",
        ),
        "status_filter_orders": with_tables(
            ["workorders"], f"SELECT workordersoi, wostatus FROM workorders WHERE wostatus IN {SCOPED.order_statuses}"
        ),
        "status_filter_requests": with_tables(
            ["workrequest"], f"SELECT workrequestoi, wrstatus FROM workrequest WHERE wrstatus IN {SCOPED.request_statuses}"
        ),
        "contains_any_like": f"SELECT doc_id FROM documents WHERE {like}",
        "contains_any_instr": with_tables(
            [], f"SELECT page_id FROM pages WHERE {oracle.mentions('html')}", oracle.NORMALIZED_WATCH
        ),
        "contains_any_long_list": with_tables(
            [], f"SELECT page_id FROM pages WHERE {oracle.mentions('url', 'html')}", f"SELECT {normal['no_scheme']} term FROM pages"
        ),
        "contains_any_thousands": with_tables(
            [], f"SELECT doc_id FROM documents WHERE {oracle.mentions('substr(text, 200)')}", oracle.FRAGMENTS
        ),
        "contains_any_beyond_task": with_tables(
            [], f"SELECT doc_id FROM documents WHERE {oracle.mentions('substr(text, 200)', like=True)}", oracle.FRAGMENTS
        ),
        "reduced_terms": oracle.reduced(f"{oracle.normalized('pages', 'url')} UNION {oracle.FRAGMENTS}"),
        "contains_any_two_columns": with_tables(
            ["eprecommendations"],
            "SELECT asset_oi, count(*) AS n FROM eprecommendations"
            f" WHERE {oracle.mentions('epprojectsha', 'epdescriptio')} GROUP BY asset_oi",
            oracle.RAW_WATCH,
        ),
        "attachment_chain": with_tables(
            ["asset", "attcontainter", "attachment"],
            "SELECT k.attachmentcontaineroi AS container, count(*) AS chain_rows FROM asset x"
            " JOIN attcontainter k ON k.attachmentcontaineroi = x.attachmentco_oi"
            f" JOIN attachment f ON f.attcontainer_oi = k.attachmentcontaineroi WHERE x.site_oi IN {SITES} GROUP BY 1",
        ),
        "hierarchy_semi": with_tables(
            ["asset", "closure"],
            "SELECT assetoi, site_oi FROM asset"
            f" WHERE assetoi IN (SELECT parent_oi FROM closure WHERE child_oi = {SCOPED.hierarchy_child})",
        ),
        "procedure_tree": with_tables(
            oracle.BOUND,
            "SELECT s.stdprocedureanddocumentsoi AS procedure, i.siteoi AS site_key, p.assetoi AS top_asset,"
            " d.stdproceduresanddocstypesoi AS doc_type, v.stdprocedureversionoi AS version, v.docmgmtfile,"
            " s2.stdprocedureanddocumentsoi AS version_procedure, i2.siteoi AS version_site,"
            f" z.omtimezoneoi AS version_timezone FROM {oracle.TREE}",
        ),
        "zero_entities": oracle.report_sql(watch="SELECT 'https://no.such.host.invalid/at/all' term"),
        **{f"branch_{code.lower()}": oracle.branch_sql(code) for code in BRANCHES},
        "report_scoped_like": oracle.report_sql(),
        "report_scoped_normalized": oracle.report_sql(watch=oracle.NORMALIZED_WATCH),
        "report_all_sites_like": oracle.report_sql(sites=None),
        "report_site_table": oracle.report_sql(),
        "report_wildcards": oracle.report_sql(sites=None, watch=oracle.listed(WILD_URLS), like=True),
        **LLM_ORACLES,
    }
