"""Contains-any against brute force, by each of its ways."""

import random
import re

import pytest
from pyspark.sql import functions as F

import linkcensus.functions.matching as matching
from linkcensus.functions.matching import Terms, WatchList, contains_any, keep_matching, without_covered
from linkcensus.operators.blocked import keep_containing
from linkcensus.operators.staging import Staging

ALPHABET = list("aAbBkKiIsS/.:%_\\?()[]|+*^$ \n") + ["K", "İ", "̇", "é", "É", "ß", "ſ", "Σ", "😀"]


def like(term: str) -> re.Pattern:
    parts = {"%": ".*", "_": "."}
    return re.compile("".join(parts.get(c) or re.escape(c) for c in term), re.DOTALL)


def brute(text, terms, mode):
    if text is None:
        return False
    low = text.lower()
    return any(like(t).search(low) if mode == "like" else t in low for t in terms)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [None, ""] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    # Keep to texts on which Python and Spark agree about lower case.
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string").cache()
    low = {r.id: r.low for r in df.select("id", F.lower("text").alias("low")).collect()}
    keep = [i for i, t in enumerate(rows) if t is None or t.lower() == low[i]]
    assert len(keep) > 1400
    return df.filter(F.col("id").isin(keep)), {i: rows[i] for i in keep}


@pytest.mark.parametrize("way", ["jvm", "regex", "multipattern", "blocked"])
@pytest.mark.parametrize("mode", ["like", "instr"])
def test_against_brute_force(spark, monkeypatch, texts, way, mode):
    monkeypatch.setattr(matching, "JVM_PROBES", 1000 if way == "jvm" else 0)
    monkeypatch.setattr(matching, "REGEX_TERMS", 1000 if way == "regex" else 0)
    df, rows = texts
    rng = random.Random(9)
    lists = [["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 4))).lower() for _ in range(6)] for _ in range(5)]
    lists += [["bk"], ["ai"], ["ib"], ["a_b"], ["a%b"], ["%"], ["_"], ["a\\q", "\\_"], ["bé", "k."], ["si"], ["/.:", "k/.:a"], ["./", "s./:", "a./:"], []]
    if way == "blocked":
        lists = lists[:2] + [sum(lists[2:5], []), ["%"], ["__", "aab"], ["bé", "k.", ""], []]
    for terms in lists:
        if way == "blocked":
            table = spark.createDataFrame([(t,) for t in terms], "match_term string")
            found = keep_containing(df, ["text"], ["id"], table, mode == "like", Staging(spark)).collect()
            assert len({r.id for r in found}) == len(found)
        else:
            found = df.filter(contains_any(Terms(terms, wildcards=mode == "like"), "text")).select("id").collect()
        assert {r.id for r in found} == {i for i, t in rows.items() if brute(t, terms, mode)}, terms


def test_shared_beginnings(spark):
    urls = [f"https://host.example/part/{p}" for p in ("a", "ab", "b/c", "b/d", "x")]
    rows = [(u.upper(),) for u in urls] + [("https://host.example/part/z",), ("host.example/part/a",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    assert df.filter(contains_any(Terms(urls), "text")).count() == 5


def test_shared_piece_without_case():
    piece = matching._caseless_piece
    assert piece(["https://a.b/c", "http://d"]) == "://"
    assert piece(["https://1.2/c", "http://1.2/d"]) == "://1.2/"
    assert piece(["https://a", "b.c"]) is None
    assert piece(["é://é", "x://"]) == "://"


def test_reduction_drops_only_covered_terms():
    assert without_covered(sorted(["ab", "abc", "xab", "b/c", "q"], key=len)) == ["q", "ab", "b/c"]
    assert Terms(["a_b", "a_bc"], wildcards=True).patterns == ["a_b", "a_bc"]


def test_reduction_of_long_lists():
    rng = random.Random(3)
    terms = ["".join(rng.choice("ab/") for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    for some in (terms, [t for t in terms if len(t) > 7], ["", "a"], []):
        kept: list[str] = []
        for term in sorted(set(some), key=lambda t: (len(t), t)):
            if not any(k in term for k in kept):
                kept.append(term)
        assert without_covered(some) == kept


def test_list_beyond_a_task_keeps_every_row_once(spark):
    df = spark.createDataFrame([("aa bb",), ("aa bb",), ("bb",), ("cc",), ("none",), (None,)], "text string")
    terms = spark.createDataFrame([("aa",), ("bb",), ("cc",), ("dd",), ("aab",)], "match_term string")
    for stage in (True, False):
        watch = WatchList(terms, "instr", task_chars=3)
        found = keep_matching(df, watch, "text", staging=Staging(spark, stage))
        assert watch.terms(Staging(spark, stage)) is None
        assert sorted(r.text for r in found.collect()) == ["aa bb", "aa bb", "bb", "cc"]


def test_list_that_fits_once_covered_terms_are_gone(spark):
    terms = spark.range(2000).selectExpr("concat('host', id % 3, '.example/', id) AS match_term")
    terms = terms.union(spark.createDataFrame([(f"host{i}.example",) for i in range(3)], "match_term string"))
    watch = WatchList(terms, "instr", task_chars=100)
    assert sorted(watch.terms(Staging(spark)).literals) == [f"host{i}.example" for i in range(3)]


def test_null_in_one_of_two_columns(spark):
    df = spark.createDataFrame([("aa", None), (None, "aa"), (None, None), ("x", "y")], "a string, b string")
    assert df.filter(contains_any(Terms(["aa"]), "a", "b")).count() == 2


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        WatchList(spark.createDataFrame([("a",)], "match_term string"), "regex")
