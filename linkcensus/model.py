"""Logical tables, entity labels and default parameters of the census."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Logical tables and the columns the census reads from them.
SCHEMAS: dict[str, str] = {
    "asset": "assetoi bigint, site_oi bigint, attachmentco_oi bigint, image string",
    "conditionindicator": "site_oi bigint, attachmentco_oi bigint",
    "indicatorreading": "site_oi bigint, attachmentco_oi bigint",
    "mtceschedule": "site_oi bigint, attachmentco_oi bigint",
    "project": "site_oi bigint, attachmentco_oi bigint",
    "standardtask": "site_oi bigint, attachmentco_oi bigint, longdescript string",
    "standardjob": "site_oi bigint, longdescript string",
    "workorders": "workordersoi bigint, site_oi bigint, wostatus int, attachmentco_oi bigint",
    "workordertask": "workordertaskoi bigint, workorder_oi bigint, attachmentco_oi bigint, longdescript string",
    "workrequest": "workrequestoi bigint, site_oi bigint, wrstatus int, attachmentco_oi bigint, longdescript string",
    "workrequestcomment": "workrequest_oi bigint, commen string",
    "activityreport": "wotask_oi bigint, site_oi bigint, taskcomment string",
    "epworkordermilesto": "workorders_oi bigint, mscomment string",
    "eprecommendations": "asset_oi bigint, epprojectsha string, epdescriptio string",
    "closure": "parent_oi bigint, child_oi bigint",
    "attcontainter": "attachmentcontaineroi bigint",
    "attachment": "attcontainer_oi bigint, filename string, embedded int",
    "site": "siteoi bigint, topasset_oi bigint, timezone_oi bigint",
    "timezone": "omtimezoneoi bigint",
    "stdprocedures": "stdprocedureanddocumentsoi bigint, site_oi bigint, stddproctype_oi bigint, currentrev_oi bigint",
    "stdprocdoctypes": "stdproceduresanddocstypesoi bigint",
    "stdprocedureversn": "stdprocedureversionoi bigint, stdprocedure_oi bigint, docmgmtfile string",
}

# The branches that are counted and the entity each adds to.
BRANCHES: dict[str, str] = {
    "B01": "ASSET",
    "B02": "ASSET",
    "B03": "CONDITIONINDICATOR",
    "B04": "INDICATORREADING",
    "B05": "MTCESCHEDULE",
    "B06": "PROJECT",
    "B07": "STANDARDTASK",
    "B08": "WORKORDERS",
    "B09": "WORKORDERTASK",
    "B10": "WORKREQUEST",
    "B11": "ASSET",
    "B12": "STANDARDTASK",
    "B13": "STANDARDJOB",
    "B14": "WORKREQUEST",
    "B15": "WORKORDERTASK",
    "B16": "WORKREQUESTCOMMENT",
    "B17": "EPWORKORDERMILESTO",
    "B18": "ACTIVITYREPORT",
    "B19": "EPRECOMMENDATIONS",
    "B20": "STDPROCEDUREVERSN",
}

# Status codes and hierarchy member that are in scope.
ORDER_STATUSES = (1, 3, 4, 6, 30, 50, 70)
REQUEST_STATUSES = (1, 2, 3, 6)
HIERARCHY_CHILD = 11


@dataclass(frozen=True)
class Scope:
    """Which records count. ``sites=None`` means every site, a null one too.

    ``sites`` may be a table, whose first column lists them; see ``operators.scope``.
    """

    sites: tuple[int, ...] | DataFrame | None = None
    order_statuses: tuple[int, ...] = ORDER_STATUSES
    request_statuses: tuple[int, ...] = REQUEST_STATUSES
    hierarchy_child: int = HIERARCHY_CHILD

    def open_order(self) -> Column:
        return F.col("wostatus").isin(list(self.order_statuses))

    def open_request(self) -> Column:
        return F.col("wrstatus").isin(list(self.request_statuses))
