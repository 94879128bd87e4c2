"""The census on awkward data: repeated and null keys, hot keys, no hits, long lists."""

import pytest
from pyspark.sql import functions as F

import oracle
from linkcensus import BRANCHES, Scope, branch_counts, census, watch_list, watchlist_from_rows
from linkcensus.operators import keys
from linkcensus.operators import scope as scope_operators
from linkcensus.plans import census as plan
from tests.logical import duck_branches, random_rows, spark_tables

LIST = ["https://Docs.example.org/a/b/?q=1#f", "intranet/a", "intranet/a/b", "docs.example.org"]
SITES = (1, 3, 11)


def values(terms):
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in terms) + ") l(term)"


def counts(tables, watch, scope, **kw):
    return {r.branch: r.count_value for r in branch_counts(tables, watch, scope, **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("path", ["few hits", "many hits", "unstaged"])
def test_all_branches_equal_plain_sql(spark, monkeypatch, seed, path):
    if path == "many hits":
        monkeypatch.setattr(keys, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(keys, "THIN_BYTES", -1)
    rows = random_rows(seed)
    tables = spark_tables(spark, rows)
    watchlist = watchlist_from_rows(spark, LIST)
    for mode, sites in (("like", SITES), ("instr", None)):
        terms = [t.match_term for t in (plan.raw_terms if mode == "like" else plan.normalized_terms)(watchlist).collect()]
        got = counts(tables, watch_list(watchlist, mode), Scope(sites=sites), stage=path != "unstaged")
        assert got == duck_branches(rows, sites, values(terms))
        assert sum(got.values()) > 0


def test_hot_container_and_hot_parent(spark, monkeypatch):
    """A third of all rows under one key, on both sides of every join."""
    rows = random_rows(7)
    rows["asset"] += [(1, 1, 1, "intranet/a")] * 40
    rows["attachment"] += [(1, f"intranet/a/{i}", i % 3) for i in range(60)]
    rows["workordertask"] += [(1, 1, 1, "intranet/a")] * 40
    rows["workorders"] += [(1, 1, 1, 1)] * 10
    rows["activityreport"] += [(1, 1, "docs.example.org")] * 40
    rows["stdprocedures"] += [(1, 1, 1, 1)] * 20
    rows["stdprocedureversn"] += [(1, 1, "intranet/a")] * 20
    tables, watchlist = spark_tables(spark, rows), watchlist_from_rows(spark, LIST)
    want = duck_branches(rows, SITES, values([t.lower() for t in LIST]))
    assert counts(tables, watch_list(watchlist, "like"), Scope(sites=SITES)) == want
    monkeypatch.setattr(keys, "BROADCAST_ROWS", -1)
    assert counts(tables, watch_list(watchlist, "like"), Scope(sites=SITES)) == want


@pytest.mark.parametrize("mode, sites", [("like", SITES), ("instr", None)])
def test_list_beyond_a_task(spark, mode, sites):
    rows = random_rows(4)
    tables, watchlist = spark_tables(spark, rows), watchlist_from_rows(spark, [*LIST, "50% o", "a_b"])
    terms = [t.match_term for t in (plan.raw_terms if mode == "like" else plan.normalized_terms)(watchlist).collect()]
    watch = watch_list(watchlist, mode, task_chars=12)
    want = duck_branches(rows, sites, values(terms), like=mode == "like")
    assert counts(tables, watch, Scope(sites=sites)) == want
    assert watch.terms(None) is None
    assert counts(tables, watch, Scope(sites=sites), stage=False) == want


@pytest.mark.parametrize("literal", [1000, 0])
def test_sites_from_a_table(spark, monkeypatch, literal):
    monkeypatch.setattr(scope_operators, "LITERAL_SITES", literal)
    rows = random_rows(9)
    sites = spark.createDataFrame([(s,) for s in (*SITES, *SITES, None)], "site int")
    watchlist = watchlist_from_rows(spark, LIST)
    got = counts(spark_tables(spark, rows), watch_list(watchlist, "like"), Scope(sites=sites))
    assert got == duck_branches(rows, SITES, values([t.lower() for t in LIST]))


def test_embedded_counts_rows_and_files_count_names(spark):
    rows = {t: [] for t in random_rows(0)}
    rows["asset"] = [(1, 1, 10, None), (2, 1, 10, None), (3, 1, None, None)]
    rows["attcontainter"] = [(10,), (10,), (11,)]
    rows["conditionindicator"] = [(1, 11)]
    rows["attachment"] = [
        (10, "http://h/A", 0), (10, "http://h/a", None), (11, "http://h/a", 0),
        (10, "http://h/e", 1), (10, "http://h/x", 2), (10, None, 0),
    ]
    got = counts(spark_tables(spark, rows), watch_list(watchlist_from_rows(spark, ["HTTP://H/"]), "like"), Scope(sites=(1,)))
    assert got["B01"] == 2   # names that differ in case only are two
    assert got["B02"] == 4   # two owners times the container listed twice
    assert got["B03"] == 1   # the same name counts again under another entity


def test_two_columns_count_once_and_two_terms_count_once(spark):
    rows = {t: [] for t in random_rows(0)}
    rows["asset"] = [(1, 1, None, "intranet/a docs.example.org")]
    rows["eprecommendations"] = [(1, "intranet/a", "docs.example.org"), (1, None, "intranet/a"), (2, "intranet/a", None)]
    got = counts(spark_tables(spark, rows), watch_list(watchlist_from_rows(spark, LIST), "like"), Scope(sites=(1,)))
    assert (got["B11"], got["B19"]) == (1, 2)


def test_repeated_document_type_doubles_the_tree(spark):
    rows = {t: [] for t in random_rows(0)}
    rows["stdprocedures"] = [(5, 1, 9, 50)]
    rows["site"] = [(1, 7, None)]
    rows["asset"] = [(7, 99, None, None)]
    rows["closure"] = [(7, 11), (7, 11)]
    rows["stdprocdoctypes"] = [(9,), (9,)]
    rows["stdprocedureversn"] = [(50, 5, "intranet/a")]
    watchlist = watchlist_from_rows(spark, LIST)
    for sites in ((1,), None):   # this branch has no site scope
        got = counts(spark_tables(spark, rows), watch_list(watchlist, "like"), Scope(sites=sites))
        assert got["B20"] == 2


def test_no_match_gives_all_entities_zero(spark):
    report = census(spark_tables(spark, random_rows(5)), watchlist_from_rows(spark, ["zzz.invalid"])).collect()
    assert [tuple(r) for r in report] == [(e, 0) for e in sorted(set(BRANCHES.values()))]


def test_empty_list_matches_nothing(spark):
    tables = spark_tables(spark, random_rows(5))
    for mode in ("like", "instr"):
        report = census(tables, watchlist_from_rows(spark, ["", "  ", None]), mode)
        assert report.agg(F.sum("total_count")).first()[0] == 0


def test_reports_relate(spark):
    """Normalized finds at least what raw finds, all sites at least what some do."""
    tables, watchlist = spark_tables(spark, random_rows(6)), watchlist_from_rows(spark, LIST)
    raw = counts(tables, watch_list(watchlist, "like"), Scope(sites=SITES))
    normal = counts(tables, watch_list(watchlist, "instr"), Scope(sites=SITES))
    everywhere = counts(tables, watch_list(watchlist, "like"), Scope())
    assert all(raw[b] <= normal[b] and raw[b] <= everywhere[b] for b in BRANCHES)
    assert raw["B20"] == everywhere["B20"]


def test_one_branch_alone_equals_its_share(spark):
    tables, watch = spark_tables(spark, random_rows(2)), watch_list(watchlist_from_rows(spark, LIST), "like")
    together = counts(tables, watch, Scope(sites=SITES))
    for branch in ("B02", "B09", "B12", "B18", "B20"):
        assert counts(tables, watch, Scope(sites=SITES), branches=[branch]) == {branch: together[branch]}


def test_plain_sql_covers_every_branch():
    assert set(oracle.BRANCHES) == set(BRANCHES)
