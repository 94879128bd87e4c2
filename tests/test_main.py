"""The command line, from stored tables and a list file to the printed report."""

from linkcensus import SCHEMAS, Scope, census, watchlist_from_rows
from linkcensus.__main__ import main
from tests.logical import random_rows, spark_tables


def test_report_from_files(spark, tmp_path, capsys):
    tables = spark_tables(spark, random_rows(8))
    for name in SCHEMAS:
        tables[name].coalesce(1).write.parquet(str(tmp_path / "tables" / name))
    (tmp_path / "list.txt").write_text("intranet/a\n\ndocs.example.org\n")
    main(["--tables", str(tmp_path / "tables"), "--watchlist", str(tmp_path / "list.txt"), "--sites", "1,3,11"])
    want = census(tables, watchlist_from_rows(spark, ["intranet/a", "docs.example.org"]), "like", Scope(sites=(1, 3, 11)))
    printed = [line.split("\t") for line in capsys.readouterr().out.splitlines() if "\t" in line]
    assert [(e, int(n)) for e, n in printed] == [tuple(r) for r in want.collect()]
    assert sum(int(n) for _, n in printed) > 0
