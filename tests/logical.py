"""Random logical tables, and the census over them in DuckDB."""

import random

import duckdb
import pandas as pd

import oracle
from linkcensus import SCHEMAS, frames

TEXTS = [
    None, "", "nothing here", "see HTTPS://Docs.example.org/A/b for more", "docs.example.org", "http://docs.example.org/a/",
    "intranet/a/b?x=1", "INTRANET/A/B", "intranet/a/b", "both intranet/a and docs.example.org/a", "a_b", "axb", "50% off", "a\\q",
]
KEYS = [None, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12]
ROWS = {"attachment": 60, "closure": 20, "attcontainter": 14, "timezone": 5, "stdprocdoctypes": 8}


def random_rows(seed: int) -> dict[str, list[tuple]]:
    """Small tables full of repeated keys, nulls and one hot key."""
    rng = random.Random(seed)

    def value(column: str, kind: str):
        if kind == "string":
            return rng.choice(TEXTS)
        if column in ("wostatus", "wrstatus"):
            return rng.choice([1, 2, 3, 5, 30, None])
        if column == "embedded":
            return rng.choice([0, 1, 1, 2, None])
        return rng.choice(KEYS)

    tables = {}
    for table, ddl in SCHEMAS.items():
        columns = [c.split() for c in ddl.split(", ")]
        tables[table] = [tuple(value(c, t) for c, t in columns) for _ in range(ROWS.get(table, 25))]
    return tables


def spark_tables(spark, rows):
    return frames({t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in rows.items()})


def duck_branches(rows, sites, watch, like=False) -> dict[str, int]:
    """Every branch by its plain SQL over the same rows."""
    con = duckdb.connect()
    for table, values in rows.items():
        columns = [c.split() for c in SCHEMAS[table].split(", ")]
        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER"}
        con.execute(f"CREATE TABLE {table} ({', '.join(f'{c} {kinds[t]}' for c, t in columns)})")
        frame = pd.DataFrame(values, columns=[c for c, _ in columns], dtype="object")
        if values:
            con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})", frame.values.tolist())
    con.execute(f"CREATE TABLE watch AS {watch}")
    return {b: con.sql(oracle.branch_count_sql(b, sites, like)[0]).fetchall()[0][0] for b in oracle.BRANCHES}
