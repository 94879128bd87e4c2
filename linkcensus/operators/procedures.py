"""Procedure versions that name a listed URL, through the procedure tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcensus.model import Scope
from linkcensus.operators import keys
from linkcensus.operators.keys import key_counts, lookup, only_keys, weighted
from linkcensus.operators.skew import hot_keys, left_join


def in_hierarchy(tables: Mapping[str, DataFrame], scope: Scope, assets: DataFrame) -> DataFrame:
    """Assets with the wanted child in the closure table; never more than once."""
    parents = tables["closure"].filter(F.col("child_oi") == scope.hierarchy_child).select("parent_oi").distinct()
    return assets.join(parents, F.col("assetoi") == F.col("parent_oi"), "left_semi")


def procedure_tree(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Procedures with site, top asset, document type and current version, where
    the version has its own procedure, site and time zone; all joins left outer.

    Hot keys of the tables on the left are split, but for tables that one task could take.
    """
    keyed = {
        "site": ["topasset_oi", "timezone_oi"],
        "stdprocedures": ["site_oi", "stddproctype_oi", "currentrev_oi"],
        "stdprocedureversn": ["stdprocedure_oi"],
    }
    large = {t: keys.estimated_bytes(tables[t]) > keys.THIN_BYTES for t in keyed}
    hot = {t: hot_keys(tables[t], columns) if large[t] else {} for t, columns in keyed.items()}

    asset = tables["asset"].select("assetoi")
    sited = left_join(tables["site"], asset, "topasset_oi", "assetoi", hot["site"].get("topasset_oi"))
    sited = sited.select(F.col("siteoi").alias("site_key"), F.col("assetoi").alias("top_asset"))

    zoned = left_join(tables["site"], tables["timezone"], "timezone_oi", "omtimezoneoi", hot["site"].get("timezone_oi"))
    zoned = zoned.select(F.col("siteoi").alias("version_site"), F.col("omtimezoneoi").alias("version_timezone"))
    origin = tables["stdprocedures"].select(
        F.col("stdprocedureanddocumentsoi").alias("version_procedure"), F.col("site_oi").alias("_origin_site")
    )
    origin = left_join(origin, zoned, "_origin_site", "version_site", hot["stdprocedures"].get("site_oi"))
    versions = tables["stdprocedureversn"]
    versions = left_join(versions, origin, "stdprocedure_oi", "version_procedure", hot["stdprocedureversn"].get("stdprocedure_oi"))

    tree = tables["stdprocedures"]
    for right, left_key, right_key in (
        (sited, "site_oi", "site_key"),
        (tables["stdprocdoctypes"], "stddproctype_oi", "stdproceduresanddocstypesoi"),
        (versions, "currentrev_oi", "stdprocedureversionoi"),
    ):
        tree = left_join(tree, right, left_key, right_key, hot["stdprocedures"].get(left_key))
    return tree.select(
        F.col("stdprocedureanddocumentsoi").alias("procedure"),
        "site_key",
        "top_asset",
        F.col("stdproceduresanddocstypesoi").alias("doc_type"),
        F.col("stdprocedureversionoi").alias("version"),
        "docmgmtfile",
        "version_procedure",
        "version_site",
        "version_timezone",
    )


def procedure_count(
    hits: DataFrame,
    tables: Mapping[str, DataFrame],
    scope: Scope,
    few: bool,
) -> DataFrame:
    """``branch, n`` for the tree, from version hits ``key, key2, n``.

    Only counts travel. A left join multiplies by the number of partners, or by one
    where there is none. The site, top asset and version must exist, because the
    hierarchy test and the match both reject null; those joins are inner.
    """
    # Version -> its procedure -> site -> time zone: how many rows each version gives.
    zones = key_counts(tables["timezone"], F.col("omtimezoneoi").alias("zone"), name="zones")
    sites = tables["site"].select(F.col("siteoi").alias("site"), F.col("timezone_oi").alias("zone"))
    per_site = sites.join(zones, "zone", "left").groupBy("site").agg(_rows("zones").alias("per_site"))
    origins = tables["stdprocedures"].select(
        F.col("stdprocedureanddocumentsoi").alias("key2"), F.col("site_oi").alias("site")
    )
    origins = only_keys(origins, "key2", hits.select("key2"), few)
    origins = origins.join(per_site, "site", "left") if few else lookup(origins, per_site, "site", "left", False, "key2")
    per_procedure = origins.groupBy("key2").agg(_rows("per_site").alias("origin_rows"))
    versions = lookup(hits, per_procedure, "key2", "left", few, "key")
    versions = versions.select("key", (F.col("n") * F.coalesce("origin_rows", F.lit(1))).alias("n"))
    if not few:
        versions = versions.groupBy("key").agg(F.sum("n").alias("n"))

    # Procedure -> site -> top asset in the hierarchy.
    tops = tables["asset"].join(tables["site"], F.col("assetoi") == F.col("topasset_oi"), "left_semi")
    top = key_counts(in_hierarchy(tables, scope, tops.select("assetoi")), F.col("assetoi").alias("asset"), name="assets")
    sited = tables["site"].select(F.col("siteoi").alias("site"), F.col("topasset_oi").alias("asset"))
    sited = sited.join(top, "asset").groupBy("site").agg(F.sum("assets").alias("site_rows"))

    procedures = tables["stdprocedures"].select(
        "currentrev_oi", F.col("site_oi").alias("site"), F.col("stddproctype_oi").alias("doc_type")
    )
    by_site = (
        weighted(versions, procedures, "currentrev_oi", few, "site", "doc_type")
        .groupBy("site", "doc_type")
        .agg(F.sum("n").alias("n"))
    )
    types = key_counts(tables["stdprocdoctypes"], F.col("stdproceduresanddocstypesoi").alias("doc_type"), name="types")
    rows = by_site.join(sited, "site").join(types, "doc_type", "left")
    total = F.sum(F.col("n") * F.col("site_rows") * F.coalesce("types", F.lit(1)))
    return rows.agg(total.alias("n")).select(F.lit("B20").alias("branch"), "n")


def _rows(partners: str) -> Column:
    """Rows a left outer join gives a group: each as often as it has partners, or once."""
    return F.sum(F.coalesce(partners, F.lit(1)))
