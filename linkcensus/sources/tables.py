"""Bind physical data to the logical tables of the census."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from linkcensus.model import SCHEMAS


def conform(name: str, df: DataFrame) -> DataFrame:
    """Keep the columns of logical table ``name``, cast to its types."""
    columns = [c.split() for c in SCHEMAS[name].split(", ")]
    missing = [c for c, _ in columns if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks column(s) {', '.join(missing)}")
    return df.selectExpr(*[f"CAST({c} AS {kind}) AS {c}" for c, kind in columns])


class Tables(Mapping[str, DataFrame]):
    """Logical tables by name, each loaded on first use only."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._seen: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self._seen:
            self._seen[name] = conform(name, self._load(name))
        return self._seen[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """Tables stored as ``root/<logical name>`` in any Spark file format."""
    return Tables(lambda name: spark.read.format(fmt).load(f"{root}/{name}"))


def catalog_tables(spark: SparkSession, names: Mapping[str, str]) -> Tables:
    """Tables of the session catalog; ``names`` maps logical to catalog name."""
    return Tables(lambda name: spark.table(names[name]))


def frames(given: Mapping[str, DataFrame]) -> Tables:
    """Tables from DataFrames already at hand."""
    return Tables(given.__getitem__)
