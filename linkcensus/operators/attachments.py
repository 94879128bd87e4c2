"""Attachments that name a listed URL, counted per kind of owner.

Owner -> container -> attachment is a two-hop join. All nine owner tables and the
container table are folded into one row per container (which kinds own it, how
often it is listed), and every attachment hit meets that row once.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcensus.model import Scope
from linkcensus.operators.keys import lookup, only_keys, perhaps_keys
from linkcensus.operators.scope import at_sites

# Branch -> table whose records own the containers.
OWNERS: dict[str, str] = {
    "B01": "asset",
    "B03": "conditionindicator",
    "B04": "indicatorreading",
    "B05": "mtceschedule",
    "B06": "project",
    "B07": "standardtask",
    "B08": "workorders",
    "B09": "workordertask",
    "B10": "workrequest",
}
EMBEDDED_BRANCH = "B02"
EMBEDDED_OWNER = "B01"
ATTACHMENT_BRANCHES = (*OWNERS, EMBEDDED_BRANCH)


def attachment_kind(column: str = "embedded") -> Column:
    """``file`` for 0 and null, ``embedded`` for 1, null for any other value."""
    return F.when(F.coalesce(column, F.lit(0)) == 0, "file").when(F.col(column) == 1, "embedded")


def owner_records(branch: str, tables: Mapping[str, DataFrame], scope: Scope) -> DataFrame:
    """The records in scope that may own attachments for ``branch``."""
    df = tables[OWNERS[branch]]
    if branch == "B08":
        df = df.filter(scope.open_order())
    elif branch == "B10":
        df = df.filter(scope.open_request())
    if branch == "B09":
        # A task has no site and no status of its own; its order has. Whether some task owns a
        # container is all that counts, so each pair of order and container comes to the join once.
        pairs = df.filter("attachmentco_oi IS NOT NULL").select("workorder_oi", "attachmentco_oi").distinct()
        orders = at_sites(tables["workorders"].filter(scope.open_order()), scope).select("workordersoi")
        orders = perhaps_keys(orders, "workordersoi", pairs.select("workorder_oi"))
        return pairs.join(orders, F.col("workorder_oi") == F.col("workordersoi"), "left_semi")
    return at_sites(df, scope)


def container_owners(
    branches: set[str], tables: Mapping[str, DataFrame], scope: Scope, wanted: DataFrame, few: bool
) -> DataFrame:
    """One row per listed container: ``container, owners, embedding_owners, listed``.

    ``owners`` has a bit per branch of OWNERS, ``embedding_owners`` counts the
    records that own it for the embedded branch, ``listed`` the container rows. Only
    containers of ``wanted`` matter; ``few`` says that these are within BROADCAST_ROWS.
    """
    rows = []
    for bit, branch in enumerate(OWNERS):
        embeds = branch == EMBEDDED_OWNER and EMBEDDED_BRANCH in branches
        if branch not in branches and not embeds:
            continue
        source = tables
        if branch == "B09":
            # Thinned by container first, so that fewer orders are looked up.
            thin = only_keys(tables["workordertask"], "attachmentco_oi", wanted, few)
            source = ChainMap({"workordertask": thin}, tables)
        rows.append(
            owner_records(branch, source, scope).selectExpr(
                "attachmentco_oi AS container", f"{1 << bit} AS owners", f"{int(embeds)}L AS embedding_owners", "0L AS listed"
            )
        )
    rows.append(
        tables["attcontainter"].selectExpr(
            "attachmentcontaineroi AS container", "0 AS owners", "0L AS embedding_owners", "1L AS listed"
        )
    )
    # The thinning is pushed down into every scan.
    return (
        only_keys(reduce(DataFrame.unionByName, rows).filter("container IS NOT NULL"), "container", wanted, few)
        .groupBy("container")
        .agg(
            F.bit_or("owners").alias("owners"),
            F.sum("embedding_owners").alias("embedding_owners"),
            F.sum("listed").alias("listed"),
        )
        .filter((F.col("owners") != 0) & (F.col("listed") > 0))
    )


def attachment_counts(
    branches: set[str],
    hits: DataFrame,
    tables: Mapping[str, DataFrame],
    scope: Scope,
    few: bool,
) -> DataFrame:
    """``branch, n`` from attachment hits ``kind, container, filename, n``.

    Files count once per distinct, case-sensitive name and branch; embedded
    attachments count once per row of the join.
    """
    holders = container_owners(branches, tables, scope, hits.select("container"), few)
    reached = lookup(hits, holders, "container", "inner", few, "filename")
    is_file = F.col("kind") == "file"
    per_name = reached.groupBy("filename").agg(
        F.bit_or(F.when(is_file, F.col("owners")).otherwise(0)).alias("owners"),
        F.sum(
            F.when(is_file, 0).otherwise(F.col("n") * F.col("embedding_owners") * F.col("listed"))
        ).alias("embedded_rows"),
    )
    sums = {
        b: F.sum(F.shiftright("owners", bit).bitwiseAND(1))
        for bit, b in enumerate(OWNERS)
        if b in branches
    }
    if EMBEDDED_BRANCH in branches:
        sums[EMBEDDED_BRANCH] = F.sum("embedded_rows")
    totals = per_name.agg(*[F.coalesce(s, F.lit(0)).cast("bigint").alias(b) for b, s in sums.items()])
    return totals.select(
        F.explode(F.create_map(*[c for b in sums for c in (F.lit(b), F.col(b))])).alias("branch", "n")
    )


def chain_rows(tables: Mapping[str, DataFrame], owners: DataFrame) -> DataFrame:
    """Rows of owner -> container -> attachment per container, counted not built."""
    links = reduce(
        DataFrame.unionByName,
        [
            owners.select(F.col("attachmentco_oi").alias("container"), F.lit("a").alias("side")),
            tables["attcontainter"].select(F.col("attachmentcontaineroi").alias("container"), F.lit("b").alias("side")),
            tables["attachment"].select(F.col("attcontainer_oi").alias("container"), F.lit("c").alias("side")),
        ],
    ).filter(F.col("container").isNotNull())
    n = {s: F.count_if(F.col("side") == s) for s in "abc"}
    return (
        links.groupBy("container")
        .agg((n["a"] * n["b"] * n["c"]).alias("chain_rows"))
        .filter(F.col("chain_rows") > 0)
    )
