"""Left joins with hot and null keys, and the procedure tree with them."""

from statistics import median

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from linkcensus.operators import keys, skew
from linkcensus.operators.procedures import procedure_tree
from linkcensus.operators.skew import hot_keys, left_join
from tests.logical import random_rows, spark_tables


def test_hot_keys_and_no_others(spark):
    rows = spark.range(0, 90_000, 1, 6).selectExpr("IF(id % 3 = 0, 7, id) AS a", "IF(id % 2 = 0, NULL, id % 5) AS b", "id AS c")
    found = hot_keys(rows, ["a", "b", "c"])
    assert found["a"] == [7] and set(found["b"]) - {None} == {0, 1, 2, 3, 4} and found["c"] == []
    assert hot_keys(rows, []) == {} and hot_keys(rows.filter("false"), ["a"]) == {"a": []}


def test_a_third_of_all_rows_under_one_key_and_a_third_under_none(spark):
    left = spark.range(0, 120_000, 1, 8).selectExpr("CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE id END AS k", "id AS n")
    right = spark.range(0, 60_000, 1, 4).selectExpr("id AS key", "id * 2 AS other").unionAll(spark.sql("SELECT 7L AS key, -1L AS other"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hot = hot_keys(left, ["k"])["k"]
        assert 7 in hot
        joined = left_join(left, right, "k", "key", [h for h in hot if h is not None])
        plain = left.join(right, left.k == right.key, "left")
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))

        def largest(df):
            sizes = [r["count"] for r in df.filter("k IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()]
            return max(sizes), median(sizes)

        most, middle = largest(joined)
        assert most < 3 * middle
        most, middle = largest(plain)
        assert most > 3 * middle
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("few", [True, False])
def test_tree_equals_plain_sql(spark, monkeypatch, few):
    monkeypatch.setattr(skew, "SALTS", 3)
    if not few:
        monkeypatch.setattr(keys, "THIN_BYTES", -1)
    rows = random_rows(8)
    rows["stdprocedures"] += [(1, 1, 1, 1)] * 10
    con = duckdb.connect()
    for table in ("stdprocedures", "site", "asset", "stdprocdoctypes", "stdprocedureversn", "timezone"):
        frame = spark_tables(spark, {table: rows[table]})[table].toArrow()  # noqa: F841
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM frame")
    want = con.sql(
        "SELECT s.stdprocedureanddocumentsoi, i.siteoi, p.assetoi, d.stdproceduresanddocstypesoi, v.stdprocedureversionoi,"
        f" v.docmgmtfile, s2.stdprocedureanddocumentsoi, i2.siteoi, z.omtimezoneoi FROM {oracle.TREE}"
    ).fetchall()
    got = procedure_tree(spark_tables(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 50
