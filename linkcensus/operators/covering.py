"""Terms that hold another term of the list, removed as a table: the other one finds all they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcensus.operators.blocked import anchors_of, contained
from linkcensus.operators.staging import Staging


def _keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit("again")).alias("k2")]


def without_covered_terms(terms: DataFrame, wildcards: bool, staging: Staging) -> DataFrame:
    """The distinct terms (match_term) that hold no other one; patterns with wildcards all stay.

    In three steps, each of which leaves less to the next: terms whose part before the first slash is
    listed (a path of a listed host); terms of which a beginning is listed; and a join of the
    rest with itself for terms that lie anywhere. No step brings the list to the driver.
    """
    terms = terms.select("match_term").filter("match_term IS NOT NULL").distinct()
    patterns = terms.filter("match_term rlike '[%_]'") if wildcards else None
    literal = terms.filter("NOT match_term rlike '[%_]'") if wildcards else terms

    host = F.expr("regexp_substr(match_term, '^[^/]+')")
    listed = literal.filter("NOT contains(match_term, '/')").select(F.col("match_term").alias("_host"))
    paths = literal.filter("contains(match_term, '/')").withColumn("_of", host).join(listed, F.col("_of") == F.col("_host"), "left_anti").drop("_of")
    literal = staging.write(paths.unionByName(listed.withColumnRenamed("_host", "match_term")))

    sizes = [r.n for r in literal.select(F.char_length("match_term").alias("n")).distinct().collect()]
    size = F.explode(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda n: n < F.char_length("match_term"))).alias("n")
    beginnings = literal.select("match_term", size).select("match_term", *_keys(F.expr("substring(match_term, 1, n)"))) if sizes else None
    if beginnings is not None:
        covered = beginnings.join(literal.select(*_keys(F.col("match_term"))), ["k1", "k2"], "left_semi").select("match_term").distinct()
        literal = staging.write(literal.join(covered, "match_term", "left_anti"))

    anchors = staging.write(anchors_of(literal, wildcards=False))
    if not anchors.isEmpty():
        itself = literal.withColumnRenamed("match_term", "_text")
        inside = contained(itself, ["_text"], ["_text"], anchors, proper=True).filter("_text <> match_term").select(F.col("_text").alias("match_term")).distinct()
        empty = literal.filter("match_term = ''").select(F.lit(True).alias("all"))
        literal = literal.join(inside, "match_term", "left_anti")
        if not empty.isEmpty():
            literal = literal.filter("match_term = ''")
    return literal.unionByName(patterns) if patterns is not None else literal
