"""The shape of the physical plans."""

import re

import pytest

from linkcensus import BRANCHES, Scope, branch_counts, frames, watch_list
from linkcensus.operators import keys
from linkcensus.operators.attachments import container_owners
from linkcensus.operators.staging import Staging
from linkcensus.plans.census import find_hits
from linkcensus.sources.driver_tables import SITES, driver_tables, driver_watchlist

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hits_plan(spark):
    tables, watch = driver_tables(spark, SF_DIR), watch_list(driver_watchlist(spark), "like")
    return plan_of(find_hits(tables, watch, Scope(sites=SITES), set(BRANCHES), Staging(spark)))


def test_hits_take_one_shuffle_and_no_join(hits_plan):
    assert len(re.findall(r"Exchange ", hits_plan)) == 1
    assert "Join" not in hits_plan and "CartesianProduct" not in hits_plan


def test_every_searched_table_is_scanned_once(hits_plan):
    # pages: attachments and versions; documents: five tables bound to it; the rest once.
    scans = re.findall(r"FileScan parquet.*?/(\w+)\.parquet", hits_plan)
    assert {t: scans.count(t) for t in set(scans)} == {
        "pages": 2, "documents": 5, "part": 1, "customer": 1, "conversations": 1, "events": 1
    }


def test_filters_reach_the_scan_before_the_match(hits_plan):
    customers = next(line for line in hits_plan.splitlines() if "customer.parquet" in line)
    assert "PushedFilters: [In(c_nationkey, " in customers


def test_few_hits_are_broadcast_and_many_are_not(spark, monkeypatch):
    tables, watch = driver_tables(spark, SF_DIR), watch_list(driver_watchlist(spark), "like")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = plan_of(branch_counts(tables, watch, Scope(sites=SITES), ["B01", "B15"]))
        monkeypatch.setattr(keys, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(keys, "THIN_BYTES", -1)
        many = plan_of(branch_counts(tables, watch, Scope(sites=SITES), ["B01", "B15"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in few and "SortMergeJoin" not in few
    # beyond the bound only bit maps of keys are broadcast
    joins = [line for line in many.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("_word" in line for line in joins) and "_salt" in many


def test_no_nested_loops_anywhere(spark):
    tables, watch = driver_tables(spark, SF_DIR), watch_list(driver_watchlist(spark), "instr")
    plan = plan_of(branch_counts(tables, watch, Scope(sites=SITES)))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_hot_order_of_tasks_is_split(spark):
    """The one join of raw rows: AQE splits the partition of a hot order."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    tasks = spark.range(0, 200_000, 1, 8).selectExpr(
        "id AS workordertaskoi", "IF(id % 3 = 0, 7, id) AS workorder_oi", "id AS attachmentco_oi", "'' AS longdescript"
    )
    orders = spark.range(0, 200_000, 1, 8).selectExpr(
        "id AS workordersoi", "3 AS site_oi", "1 AS wostatus", "id AS attachmentco_oi"
    )
    containers = spark.range(0, 200_000, 1, 8).selectExpr("id AS attachmentcontaineroi")
    tables = frames({"workordertask": tasks, "workorders": orders, "attcontainter": containers})
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        owners = container_owners({"B09"}, tables, Scope(sites=(3,)), containers, False)
        assert len(owners.collect()) == 200_000
        assert "SortMergeJoin(skew=true)" in plan_of(owners)
    finally:
        for key in conf:
            spark.conf.unset(key)


def thinned(spark, branch, monkeypatch, few):
    """What a branch shuffles of its orders, and the plan."""
    tables, watch = driver_tables(spark, SF_DIR), watch_list(driver_watchlist(spark), "like")
    monkeypatch.setattr(keys, "THIN_BYTES", -1)
    if not few:
        monkeypatch.setattr(keys, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan_of(branch_counts(tables, watch, Scope(sites=SITES), [branch]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("branch", ["B09", "B18"])
def test_orders_are_thinned_before_their_shuffle(spark, monkeypatch, branch, few):
    lines = thinned(spark, branch, monkeypatch, few).splitlines()
    scans = [i for i, line in enumerate(lines) if "orders.parquet" in line]
    assert scans
    for scan in scans:
        depth = len(lines[scan]) - len(lines[scan].lstrip(" :"))
        above = [line for line in lines[:scan] if len(line) - len(line.lstrip(" :")) < depth]
        joined = next(line for line in reversed(above) if "Join" in line or "Exchange" in line)
        assert "BroadcastHashJoin" in joined, joined


def test_bit_map_lets_wanted_keys_through_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(keys, "THIN_BYTES", -1)
    rows = spark.range(200_000).selectExpr("IF(id % 1000 = 0, NULL, id) AS k", "id AS n")
    wanted = spark.range(0, 2_000, 2).selectExpr("IF(id = 0, NULL, id) AS key")
    left = keys.perhaps_keys(rows, "k", wanted)
    assert left.columns == ["k", "n"]
    found = {r.k for r in left.collect()}
    assert {i for i in range(2, 2_000, 2) if i % 1000} <= found and None not in found and len(found) < 1_100
    assert keys.perhaps_keys(rows, "k", wanted.filter("false")).count() == 0
