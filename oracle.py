"""DuckDB SQL for every key of ``queries()``, over the driver's tables.

Written branch by branch with plain joins and EXISTS, independently of the Spark
plans: no hits table, no counts by key, no bit masks, no reduced term list.
"""

from __future__ import annotations

from linkcensus.model import BRANCHES, HIERARCHY_CHILD, ORDER_STATUSES, REQUEST_STATUSES
from linkcensus.sources.driver_tables import SITES, WATCHLIST

_C = 97

# Logical tables as SELECTs over the driver's tables.
BOUND = {
    "asset": f"SELECT p_partkey assetoi, CAST(p_size % 25 AS BIGINT) site_oi, p_partkey % {_C} attachmentco_oi, p_name image FROM part",
    "conditionindicator": f"SELECT s_nationkey site_oi, s_suppkey % {_C} attachmentco_oi FROM supplier",
    "indicatorreading": f"SELECT user_id % 25 site_oi, event_id % {_C} attachmentco_oi FROM events",
    "mtceschedule": f"SELECT c_nationkey site_oi, c_custkey % {_C} attachmentco_oi FROM customer",
    "project": f"SELECT s_nationkey site_oi, (s_suppkey * 7) % {_C} attachmentco_oi FROM supplier",
    "standardtask": f"SELECT doc_id % 25 site_oi, doc_id % {_C} attachmentco_oi, text longdescript FROM documents",
    "standardjob": "SELECT n_chars % 25 site_oi, text longdescript FROM documents",
    "workorders": "SELECT o_orderkey workordersoi, o_custkey % 25 site_oi,"
                  f" CAST(substr(o_orderpriority, 1, 1) AS INTEGER) wostatus, o_orderkey % {_C} attachmentco_oi FROM orders",
    "workordertask": f"SELECT doc_id workordertaskoi, doc_id workorder_oi, doc_id % {_C} attachmentco_oi, text longdescript FROM documents",
    "workrequest": "SELECT c_custkey workrequestoi, c_nationkey site_oi, CAST(c_custkey % 8 AS INTEGER) wrstatus,"
                   f" c_custkey % {_C} attachmentco_oi, c_mktsegment longdescript FROM customer",
    "workrequestcomment": "SELECT conv_id workrequest_oi, text commen FROM conversations",
    "activityreport": "SELECT event_id % 200 wotask_oi, user_id % 25 site_oi, props taskcomment FROM events",
    "epworkordermilesto": "SELECT doc_id workorders_oi, text mscomment FROM documents",
    "eprecommendations": "SELECT doc_id % 200 asset_oi, source epprojectsha, text epdescriptio FROM documents",
    "closure": "SELECT p_partkey % 25 parent_oi, p_size child_oi FROM part",
    "attcontainter": f"SELECT DISTINCT page_id % {_C} attachmentcontaineroi FROM pages",
    "attachment": f"SELECT page_id % {_C} attcontainer_oi, url filename,"
                  " CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 END embedded FROM pages",
    "site": "SELECT n_nationkey::BIGINT siteoi, n_nationkey::BIGINT topasset_oi, n_regionkey::BIGINT timezone_oi FROM nation",
    "timezone": "SELECT r_regionkey::BIGINT omtimezoneoi FROM region",
    "stdprocedures": "SELECT s_suppkey stdprocedureanddocumentsoi, s_nationkey::BIGINT site_oi,"
                     " s_suppkey % 7 stddproctype_oi, s_suppkey currentrev_oi FROM supplier",
    "stdprocdoctypes": "SELECT r_regionkey::BIGINT stdproceduresanddocstypesoi FROM region",
    "stdprocedureversn": "SELECT page_id stdprocedureversionoi, page_id % 10 stdprocedure_oi, url docmgmtfile FROM pages",
}


def _values(items) -> str:
    return ", ".join("('" + str(i).replace("'", "''") + "')" for i in items)


def normalize(column: str) -> dict[str, str]:
    bare = f"regexp_replace(trim({column}), '[?#].*$', '')"
    unslashed = f"regexp_replace({bare}, '/+$', '')"
    schemeless = f"regexp_replace({unslashed}, '^https?://', '')"
    return {
        "original_url": f"lower(trim({column}))",
        "no_query_fragment": f"lower({bare})",
        "no_trailing_slash": f"lower({unslashed})",
        "no_scheme": f"lower({schemeless})",
        "domain_only": f"lower(nullif(regexp_extract({schemeless}, '^[^/]+'), ''))",
    }


def normalized(source: str, column: str) -> str:
    n = normalize(column)
    return " UNION ".join(
        f"SELECT {n[c]} term FROM {source} WHERE {n[c]} IS NOT NULL AND {n[c]} <> ''" for c in ("no_scheme", "domain_only")
    )


def listed(urls) -> str:
    return f"SELECT lower(url) term FROM (VALUES {_values(urls)}) l(url)"


RAW_WATCH = listed(WATCHLIST)
NORMALIZED_WATCH = normalized(f"(VALUES {_values(WATCHLIST)}) l(url)", "url")


# Four pieces of the beginning of every document.
FRAGMENTS = "SELECT DISTINCT term FROM (" + " UNION ALL ".join(
    f"SELECT lower(substr(text, {a}, 30)) term FROM documents" for a in (11, 41, 71, 101)
) + ") WHERE length(term) = 30"


def reduced(terms: str) -> str:
    """Terms and the nine characters from the fifth on of each, without those that hold another one."""
    return (
        f"WITH whole AS ({terms}), t AS (SELECT term FROM whole UNION SELECT substr(term, 5, 9) FROM whole)"
        " SELECT term AS match_term FROM t WHERE term <> '' AND NOT EXISTS"
        " (SELECT 1 FROM t AS s WHERE s.term <> '' AND s.term <> t.term AND contains(t.term, s.term))"
    )


def mentions(*columns: str, like: bool = False) -> str:
    """``like``: ``%`` and ``_`` in a term are wildcards; nothing escapes them."""
    form = "lower({}) LIKE '%' || w.term || '%'" if like else "instr(lower({}), w.term) > 0"
    test = " OR ".join(form.format(c) for c in columns)
    return f"EXISTS (SELECT 1 FROM watch w WHERE {test})"


def branch_count_sql(code: str, sites: tuple[int, ...] | None, like: bool = False) -> tuple[str, tuple[str, ...]]:
    """The count of one branch and the logical tables it reads."""

    def here(alias: str) -> str:
        return "true" if sites is None else f"{alias}.site_oi IN {tuple(sites)}"

    order_open = f"o.wostatus IN {ORDER_STATUSES}"
    request_open = f"r.wrstatus IN {REQUEST_STATUSES}"
    owners = {
        "B01": ("asset x", here("x")),
        "B02": ("asset x", here("x")),
        "B03": ("conditionindicator x", here("x")),
        "B04": ("indicatorreading x", here("x")),
        "B05": ("mtceschedule x", here("x")),
        "B06": ("project x", here("x")),
        "B07": ("standardtask x", here("x")),
        "B08": ("workorders x", f"{here('x')} AND {order_open.replace('o.', 'x.')}"),
        "B09": ("workordertask x JOIN workorders o ON o.workordersoi = x.workorder_oi", f"{here('o')} AND {order_open}"),
        "B10": ("workrequest x", f"{here('x')} AND {request_open.replace('r.', 'x.')}"),
    }
    texts = {
        "B11": ("asset x", here("x"), ("x.image",)),
        "B12": ("standardtask x", here("x"), ("x.longdescript",)),
        "B13": ("standardjob x", here("x"), ("x.longdescript",)),
        "B14": ("workrequest r", f"{here('r')} AND {request_open}", ("r.longdescript",)),
        "B15": ("workordertask x JOIN workorders o ON o.workordersoi = x.workorder_oi",
                f"{here('o')} AND {order_open}", ("x.longdescript",)),
        "B16": ("workrequestcomment x JOIN workrequest r ON r.workrequestoi = x.workrequest_oi",
                f"{here('r')} AND {request_open}", ("x.commen",)),
        "B17": ("epworkordermilesto x JOIN workorders o ON o.workordersoi = x.workorders_oi",
                f"{here('o')} AND {order_open}", ("x.mscomment",)),
        "B18": ("activityreport x JOIN workordertask t ON t.workordertaskoi = x.wotask_oi"
                " JOIN workorders o ON o.workordersoi = t.workorder_oi", f"{here('x')} AND {order_open}", ("x.taskcomment",)),
        "B19": ("eprecommendations x JOIN asset p ON p.assetoi = x.asset_oi", here("p"),
                ("x.epprojectsha", "x.epdescriptio")),
    }
    if code in owners:
        source, where = owners[code]
        measure, flag = (
            ("count(*)", "f.embedded = 1") if code == "B02" else ("count(DISTINCT f.filename)", "coalesce(f.embedded, 0) = 0")
        )
        sql = (
            f"SELECT {measure} FROM {source} JOIN attcontainter k ON k.attachmentcontaineroi = x.attachmentco_oi"
            f" JOIN attachment f ON f.attcontainer_oi = k.attachmentcontaineroi"
            f" WHERE {where} AND {flag} AND {mentions('f.filename', like=like)}"
        )
        extra = ("attcontainter", "attachment")
    elif code in texts:
        source, where, columns = texts[code]
        sql, extra = f"SELECT count(*) FROM {source} WHERE {where} AND {mentions(*columns, like=like)}", ()
    else:
        source = TREE
        sql = (
            f"SELECT count(*) FROM {TREE} WHERE p.assetoi IN (SELECT parent_oi FROM closure WHERE child_oi = {HIERARCHY_CHILD})"
            f" AND {mentions('v.docmgmtfile', like=like)}"
        )
        extra = ("closure",)
    words = source.replace("(", " ").split()
    return sql, tuple(t for t in BOUND if t in words) + extra


TREE = (
    "stdprocedures s LEFT JOIN site i ON i.siteoi = s.site_oi LEFT JOIN asset p ON p.assetoi = i.topasset_oi"
    " LEFT JOIN stdprocdoctypes d ON d.stdproceduresanddocstypesoi = s.stddproctype_oi"
    " LEFT JOIN stdprocedureversn v ON v.stdprocedureversionoi = s.currentrev_oi"
    " LEFT JOIN stdprocedures s2 ON s2.stdprocedureanddocumentsoi = v.stdprocedure_oi"
    " LEFT JOIN site i2 ON i2.siteoi = s2.site_oi LEFT JOIN timezone z ON z.omtimezoneoi = i2.timezone_oi"
)


def with_tables(tables, sql: str, watch: str | None = None) -> str:
    names = [t for t in BOUND if t in set(tables)]
    ctes = [f"{t} AS ({BOUND[t]})" for t in names] + ([f"watch AS ({watch})"] if watch else [])
    return f"WITH {', '.join(ctes)} {sql}"


def branch_sql(code: str, sites=SITES, watch: str = RAW_WATCH) -> str:
    count, tables = branch_count_sql(code, sites)
    return with_tables(tables, f"SELECT '{BRANCHES[code]}' AS entity, ({count}) AS count_value", watch)


def report_sql(sites=SITES, watch: str = RAW_WATCH, like: bool = False) -> str:
    parts = [f"SELECT '{BRANCHES[b]}' AS entity, ({branch_count_sql(b, sites, like)[0]}) AS n" for b in BRANCHES]
    union = " UNION ALL ".join(parts)
    return with_tables(
        BOUND, f"SELECT entity, CAST(sum(n) AS BIGINT) AS total_count FROM ({union}) GROUP BY entity ORDER BY entity", watch
    )
