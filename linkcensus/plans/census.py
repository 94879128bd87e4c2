"""The link reference census.

1. Find hits. Every searched table is scanned once; the match runs in the scan and
   leaves a key and a count per hit. The result, small beside the data, is written
   to the shared folder.
2. Attribute hits. Keys are joined to the records that decide the scope. Where the
   hits of a branch are known to be few, their keys are broadcast and the large
   tables are thinned before any shuffle; otherwise both sides are pre-aggregated
   and shuffled.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcensus.functions.matching import TASK_CHARS, WatchList, keep_matching
from linkcensus.model import BRANCHES, Scope
from linkcensus.operators import keys
from linkcensus.operators.attachments import (
    ATTACHMENT_BRANCHES,
    EMBEDDED_BRANCH,
    OWNERS,
    attachment_counts,
    attachment_kind,
)
from linkcensus.operators.procedures import procedure_count
from linkcensus.operators.scope import resolved
from linkcensus.operators.staging import Staging
from linkcensus.operators.textrefs import OWN_TEXT, TEXT_BRANCHES, searched_rows, text_counts
from linkcensus.sources.watchlist import normalized_terms, raw_terms


def find_hits(
    tables: Mapping[str, DataFrame], watch: WatchList, scope: Scope, branches: set[str], staging: Staging
) -> DataFrame:
    """Every mention of the watch-list as ``kind, key, key2, filename, n``."""
    searched = []
    kinds = (["file"] if branches & set(OWNERS) else []) + (["embedded"] if EMBEDDED_BRANCH in branches else [])
    if kinds:
        attachments = tables["attachment"].select(
            attachment_kind().alias("kind"), F.col("attcontainer_oi").alias("key"), F.col("filename").alias("text")
        )
        searched.append(attachments.filter(F.col("kind").isin(kinds) & F.col("key").isNotNull()))
    for branch in sorted(branches & set(TEXT_BRANCHES)):
        searched.append(searched_rows(branch, tables, scope))
    if "B20" in branches:
        versions = tables["stdprocedureversn"].selectExpr(
            "'B20' AS kind", "stdprocedureversionoi AS key", "stdprocedure_oi AS key2", "docmgmtfile AS text"
        )
        searched.append(versions.filter("key IS NOT NULL"))

    # The filter on the union is pushed down into every scan.
    one, two = [[d for d in searched if ("text2" in d.columns) == both] for both in (False, True)]
    found = []
    for frames, columns in ((one, ["text"]), (two, ["text", "text2"])):
        if frames:
            rows = reduce(_union, frames).withColumn("filename", F.expr("CASE WHEN kind = 'file' THEN text END"))
            keep = [c for c in rows.columns if c not in columns]
            found.append(keep_matching(rows, watch, *columns, staging=staging, keep=keep))
    return (
        reduce(_union, found)
        .withColumn("key2", F.col("key2") if "B20" in branches else F.lit(None).cast("bigint"))
        .groupBy("kind", "key", "key2", "filename")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def _counts(
    tables: Mapping[str, DataFrame], watch: WatchList, scope: Scope, branches: Collection[str], stage: bool
) -> DataFrame:
    """``branch, entity, n``: a zero for every branch asked for, and what was counted."""
    wanted, scope = set(branches), resolved(scope)
    spark = tables["attachment"].sparkSession
    staging = Staging(spark, stage)
    hits = find_hits(tables, watch, scope, wanted, staging)
    rows: dict[str, int] | None = None
    if staging.folder is not None and wanted - set(OWN_TEXT):
        hits = staging.write(hits, by="kind")
        rows = {r.kind: r["count"] for r in hits.groupBy("kind").count().collect()}

    def few(*kinds: str) -> bool:
        """Has a count shown that the hits of these kinds can be broadcast?"""
        return rows is not None and sum(rows.get(k, 0) for k in kinds) <= keys.BROADCAST_ROWS

    counts = []
    if wanted & set(ATTACHMENT_BRANCHES):
        named = hits.filter(F.col("kind").isin("file", "embedded")).withColumnRenamed("key", "container")
        counts.append(attachment_counts(wanted, named, tables, scope, few("file", "embedded")))
    counts += text_counts(wanted & set(TEXT_BRANCHES), hits, tables, scope, few)
    if "B20" in wanted:
        versions = hits.filter(F.col("kind") == "B20").select("key", "key2", "n")
        counts.append(procedure_count(versions, tables, scope, few("B20")))

    asked = sorted(wanted)
    zeros = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{b}', 0L)" for b in asked) + " AS z(branch, n)")
    entity = "CASE branch " + " ".join(f"WHEN '{b}' THEN '{BRANCHES[b]}'" for b in asked) + " END AS entity"
    return reduce(DataFrame.unionByName, [zeros, *counts]).selectExpr("branch", entity, "n")


def branch_counts(
    tables: Mapping[str, DataFrame],
    watch: WatchList,
    scope: Scope = Scope(),
    branches: Collection[str] = tuple(BRANCHES),
    stage: bool = True,
) -> DataFrame:
    """``branch, entity, count_value`` with a row for every branch asked for."""
    counts = _counts(tables, watch, scope, branches, stage)
    return counts.groupBy("branch", "entity").agg(F.sum("n").alias("count_value"))


def watch_list(watchlist: DataFrame, mode: str, task_chars: int = TASK_CHARS) -> WatchList:
    """Match terms of a watch-list with a ``url_pref`` column.

    ``like``: the listed URLs as they are, ``%`` and ``_`` being wildcards.
    ``instr``: path and domain terms of the normalized URLs, taken literally.
    """
    terms = raw_terms(watchlist) if mode == "like" else normalized_terms(watchlist)
    return WatchList(terms, mode, task_chars)


def census(
    tables: Mapping[str, DataFrame],
    watchlist: DataFrame,
    mode: str = "like",
    scope: Scope = Scope(),
    stage: bool = True,
) -> DataFrame:
    """The report: ``entity, total_count`` for every entity, ordered by entity."""
    counts = _counts(tables, watch_list(watchlist, mode), scope, BRANCHES, stage)
    totals = counts.groupBy("entity").agg(F.sum("n").alias("total_count"))
    # Always as many rows as there are entities, so one task sorts them without sampling.
    return totals.coalesce(1).sortWithinPartitions("entity")
