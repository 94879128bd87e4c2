"""Watch-lists, URL normalization and table bindings."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from linkcensus import SCHEMAS, catalog_tables, frames, normalized_terms, raw_terms, read_tables, watchlist_from_rows, watchlist_from_text
from linkcensus.functions.urls import normalized_url
from linkcensus.operators.scope import at_listed_sites
from linkcensus.operators.staging import shared_folder


def test_text_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("https://A.example/x  \n\n   \nb.example\n")
    got = [r.url_pref for r in watchlist_from_text(spark, str(tmp_path / "list.txt")).collect()]
    assert got == ["https://A.example/x", "b.example"]


def test_text_file_with_crlf_blank_lines_and_no_last_newline(spark, tmp_path):
    (tmp_path / "list.txt").write_bytes("https://A.example/x \r\n\r\n \t \r\nhttps://b.example/ü\r\nlast".encode())
    got = [r.url_pref for r in watchlist_from_text(spark, str(tmp_path / "list.txt")).collect()]
    assert [g for g in got if g.strip()] == ["https://A.example/x", "https://b.example/ü", "last"]
    (tmp_path / "empty.txt").write_bytes(b"")
    assert watchlist_from_text(spark, str(tmp_path / "empty.txt")).collect() == []


def test_catalog_tables(spark):
    spark.sql("SELECT CAST(7 AS INT) AS omtimezoneoi, 'x' AS extra").createOrReplaceTempView("zones")
    assert catalog_tables(spark, {"timezone": "zones"})["timezone"].dtypes == [("omtimezoneoi", "bigint")]


def test_site_partitions_are_pruned(spark, tmp_path):
    spark.range(100).selectExpr("id AS assetoi", "id % 10 AS site_oi").write.partitionBy("site_oi").parquet(str(tmp_path / "asset"))
    sites = spark.createDataFrame([(3,), (3,), (None,)], "site int")
    found = at_listed_sites(spark.read.parquet(str(tmp_path / "asset")), sites)
    assert found.count() == 10
    assert "PartitionFilters: [isnotnull(site_oi" in found._jdf.queryExecution().executedPlan().toString()


def test_raw_terms_keep_case_folded_text_and_blanks_go(spark):
    rows = watchlist_from_rows(spark, [" A/b ", None, "", "   ", "A_b%"])
    assert sorted(r.match_term for r in raw_terms(rows).collect()) == [" a/b ", "a_b%"]


@pytest.mark.parametrize(
    "url, stages",
    [
        ("http://h/p//?q=1#f", ("http://h/p//?q=1#f", "http://h/p//", "http://h/p", "h/p", "h")),
        ("HTTPS://Host/", ("https://host/", "https://host/", "https://host", "https://host", "https:")),
        (" https://Host/A B/ ", ("https://host/a b/", "https://host/a b/", "https://host/a b", "host/a b", "host")),
        ("/only/path", ("/only/path", "/only/path", "/only/path", "/only/path", None)),
        ("https://", ("https://", "https://", "https:", "https:", "https:")),
        ("?x=1", ("?x=1", "", "", "", None)),
        ("\thost\t", ("\thost\t", "\thost\t", "\thost\t", "\thost\t", "\thost\t")),
        (None, (None,) * 5),
    ],
)
def test_normalization(spark, url, stages):
    df = spark.createDataFrame([(url,)], "u string").select(normalized_url("u").alias("n")).select("n.*")
    assert tuple(df.first()) == stages


def test_normalized_terms_are_distinct_and_not_blank(spark):
    rows = watchlist_from_rows(spark, ["http://h/p", "https://h/p/?x", "/only/path", "?q", "h"])
    assert sorted(r.match_term for r in normalized_terms(rows).collect()) == ["/only/path", "h", "h/p"]


def test_tables_from_files_are_cast_and_pruned(spark, tmp_path):
    raw = spark.range(3).select(F.col("id").cast("int").alias("attachmentcontaineroi"), F.lit(1).alias("extra"))
    raw.write.parquet(str(tmp_path / "attcontainter"))
    tables = read_tables(spark, str(tmp_path))
    assert tables["attcontainter"].dtypes == [("attachmentcontaineroi", "bigint")]
    assert len(tables) == len(SCHEMAS) == 22


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="filename"):
        frames({"attachment": spark.range(1).selectExpr("id AS attcontainer_oi", "0 AS embedded")})["attachment"]


def test_site_table(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "site_oi bigint")
    sites = spark.createDataFrame([(1,), (1,), (None,)], "site bigint")
    assert at_listed_sites(df, sites).count() == 2


@pytest.mark.parametrize(
    "conf, folder",
    [
        ({"spark.checkpoint.dir": "hdfs:///shared", "spark.master": "yarn"}, "hdfs:///shared"),
        ({"spark.checkpoint.dir": "/shared", "spark.master": "local[2]"}, "/shared"),
        ({"spark.master": "yarn"}, None),
    ],
)
def test_shared_folder_is_the_one_the_cluster_names(conf, folder):
    assert shared_folder(SimpleNamespace(conf=conf)) == folder


def test_local_spark_without_a_shared_folder_gets_its_own():
    assert "linkcensus-" in shared_folder(SimpleNamespace(conf={"spark.master": "local[2]"}))
