"""Free-text fields that mention a listed URL.

Every field is matched where it is scanned, before any join, so text never goes
through a shuffle: what is left of a hit is the key of the parent record that
decides its scope, with a count.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcensus.model import Scope
from linkcensus.operators.keys import weighted
from linkcensus.operators.scope import at_sites

# Branches scoped by the record that holds the text: table, text columns.
OWN_TEXT: dict[str, tuple[str, tuple[str, ...]]] = {
    "B11": ("asset", ("image",)),
    "B12": ("standardtask", ("longdescript",)),
    "B13": ("standardjob", ("longdescript",)),
    "B14": ("workrequest", ("longdescript",)),
}
# Branches scoped by a parent record: table, key of the parent, text columns.
CHILD_TEXT: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "B15": ("workordertask", "workorder_oi", ("longdescript",)),
    "B16": ("workrequestcomment", "workrequest_oi", ("commen",)),
    "B17": ("epworkordermilesto", "workorders_oi", ("mscomment",)),
    "B18": ("activityreport", "wotask_oi", ("taskcomment",)),
    "B19": ("eprecommendations", "asset_oi", ("epprojectsha", "epdescriptio")),
}
TEXT_BRANCHES = (*OWN_TEXT, *CHILD_TEXT)


def searched_rows(branch: str, tables: Mapping[str, DataFrame], scope: Scope) -> DataFrame:
    """Rows searched for ``branch``: ``kind, key, text`` and perhaps ``text2``."""
    if branch in OWN_TEXT:
        table, columns = OWN_TEXT[branch]
        df = at_sites(tables[table], scope)
        if branch == "B14":
            df = df.filter(scope.open_request())
        key = "CAST(NULL AS BIGINT)"
    else:
        table, key, columns = CHILD_TEXT[branch]
        df = tables[table].filter(f"{key} IS NOT NULL")
        # An activity has a site of its own; the other children take the parent's.
        if branch == "B18":
            df = at_sites(df, scope)
    texts = [f"{c} AS {name}" for c, name in zip(columns, ("text", "text2"))]
    return df.selectExpr(f"'{branch}' AS kind", f"{key} AS key", *texts)


def text_counts(
    branches: set[str],
    hits: DataFrame,
    tables: Mapping[str, DataFrame],
    scope: Scope,
    few: Callable[..., bool],
) -> list[DataFrame]:
    """``branch, n`` frames from text hits ``kind, key, n``.

    ``few`` tells whether the hits of given kinds are within BROADCAST_ROWS.
    """
    counts = []
    own = branches & set(OWN_TEXT)
    if own:
        counts.append(hits.filter(F.col("kind").isin(sorted(own))).select(F.col("kind").alias("branch"), "n"))

    orders = tables["workorders"].filter(scope.open_order())
    parents = [
        (("B15", "B17"), orders, "workordersoi"),
        (("B16",), tables["workrequest"].filter(scope.open_request()), "workrequestoi"),
        (("B19",), tables["asset"], "assetoi"),
    ]
    for kinds, parent, key in parents:
        asked = sorted(branches.intersection(kinds))
        if asked:
            found = hits.filter(F.col("kind").isin(asked)).select(F.col("kind").alias("branch"), "key", "n")
            reached = weighted(found, at_sites(parent, scope).select(key), key, few(*asked))
            counts.append(reached.groupBy("branch").agg(F.sum("n").alias("n")))

    if "B18" in branches:
        # Activity -> task -> order. The activity brought its own site, so any open
        # order will do. How many orders the tasks name is not known, so a bit map thins them.
        found = hits.filter(F.col("kind") == "B18").select("key", "n")
        tasks = tables["workordertask"].select("workordertaskoi", "workorder_oi")
        by_order = (
            weighted(found, tasks, "workordertaskoi", few("B18"), "workorder_oi")
            .groupBy(F.col("workorder_oi").alias("key"))
            .agg(F.sum("n").alias("n"))
        )
        reached = weighted(by_order, orders.select("workordersoi"), "workordersoi", False)
        counts.append(reached.agg(F.sum("n").alias("n")).select(F.lit("B18").alias("branch"), "n"))
    return counts
