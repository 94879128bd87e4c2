"""Lists of thousands of terms, lists beyond one task, and terms that cover others."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from linkcensus import normalized_terms, watchlist_from_rows
from linkcensus.functions import multipattern
from linkcensus.functions.matching import WatchList, keep_matching
from linkcensus.functions.multipattern import Matcher, like_regex
from linkcensus.functions.windows import widest, window_hashes
from linkcensus.operators import blocked
from linkcensus.operators.blocked import anchors_of, contained
from linkcensus.operators.covering import without_covered_terms
from linkcensus.operators.staging import Staging

LETTERS = list("aAbBkKiIsS/.:%_\\?()[]|+*^$ \n") + ["K", "İ", "é", "\U0001f600"]


def like(term):
    return re.compile("".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in term), re.DOTALL)


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_matcher_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(multipattern, "BLOCK", block)
    monkeypatch.setattr(multipattern, "PAIRS", block)
    rng = random.Random(block)
    for _ in range(40):
        terms = ["".join(rng.choice(LETTERS[:29]).lower() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 7, 8, 9, 17]))) for _ in range(rng.choice([1, 6, 40]))]
        texts = [None, ""] + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(30))) for _ in range(60)]
        texts += [rng.choice(terms).upper() + "x" for _ in range(20)]
        low = [t if t is None else t.lower() for t in texts]
        found = Matcher(terms).found(pa.array(texts)[1:])
        assert found.tolist() == [t is not None and any(x in t for x in terms) for t in low[1:]]
        patterns, literals = ([t for t in terms if bool(re.search("[%_]", t)) == wild] for wild in (True, False))
        found = Matcher(literals, patterns).found(pa.array(texts))
        assert found.tolist() == [t is not None and (any(x in t for x in literals) or any(like(p).search(t) for p in patterns)) for t in low]


def test_thousands_cost_about_as_much_as_hundreds():
    rng = np.random.default_rng(2)
    texts = pa.array(["".join(map(chr, row)) for row in rng.integers(97, 123, (200, 20_000))])
    seconds = []
    for n in (300, 30_000):
        matcher = Matcher([f"https://host{i % 50}.example/en/{i}" for i in range(n)])
        matcher.found(texts[:1])
        best = min((lambda t: (matcher.found(texts), time.process_time() - t)[1])(time.process_time()) for _ in range(3))
        seconds.append(best)
    assert seconds[1] < 2 * seconds[0]


def test_many_wildcards_take_no_backtracking():
    text = "ab" * 20_000
    start = time.process_time()
    assert not re.search(like_regex("a%%%b%a%b%a%b%z"), text)
    assert re.search(like_regex("%a%%b_b%"), text)
    assert time.process_time() - start < 2


def test_equal_windows_have_equal_hashes():
    data = np.frombuffer(b"abcdefghabcdefghXabcdefgh", "uint8")
    for width, hashes in window_hashes(data, [1, 2, 8, 32]):
        assert len(hashes) == max(0, len(data) - width + 1)
        same = {}
        for i, h in enumerate(hashes.tolist()):
            assert same.setdefault(h, data[i : i + width].tobytes()) == data[i : i + width].tobytes()
        assert len(same) == len({data[i : i + width].tobytes() for i in range(len(hashes))})
    assert [widest(n) for n in (1, 2, 3, 31, 32)] == [1, 2, 2, 16, 32]


@pytest.mark.parametrize("wildcards", [True, False])
def test_covered_terms_go_and_no_others(spark, wildcards):
    rng = random.Random(6)
    terms = {"".join(rng.choice("ab/%_é") for _ in range(rng.randrange(1, 12))) for _ in range(250)}
    for some in (terms, {t for t in terms if len(t) > 3}, {"", "a"}, set()):
        table = spark.createDataFrame([(t,) for t in [*some, *some, None]], "match_term string")
        wild = {t for t in some if wildcards and re.search("[%_]", t)}
        literal = some - wild
        want = wild | {t for t in literal if not any(o != t and o in t for o in literal)}
        got = [r.match_term for r in without_covered_terms(table, wildcards, Staging(spark)).collect()]
        assert sorted(got) == sorted(want)


def test_paths_of_listed_hosts_are_covered(spark):
    urls = spark.range(20_000).selectExpr("concat('https://host', id % 100, '.example/page/', id) AS url_pref")
    terms = normalized_terms(urls)
    assert sorted(r.match_term for r in without_covered_terms(terms, False, Staging(spark)).collect()) == sorted(f"host{i}.example" for i in range(100))


def test_no_text_leaves_the_scan_and_no_nested_loop(spark):
    terms = spark.range(3000).selectExpr("concat('/page/', id, '/') AS match_term")
    texts = spark.range(500).selectExpr("id", "concat(repeat('lorem ', 200), '/PAGE/', id * 7, '/') AS text")
    watch = WatchList(terms, "instr", task_chars=10)
    found = keep_matching(texts, watch, "text", staging=Staging(spark), keep=["id"])
    assert {r.id for r in found.collect()} == {i for i in range(500) if 7 * i < 3000}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    anchors = anchors_of(terms, wildcards=False)
    around = contained(texts, ["text"], ["id"], anchors).columns
    assert around == ["id", "_row", "match_term"]
    assert not re.search(r"Exchange[^\n]*\n[^\n]*\btext#", plan)


def test_empty_list_beyond_a_task(spark):
    watch = WatchList(watchlist_from_rows(spark, []).withColumnRenamed("url_pref", "match_term"), "like", task_chars=-1)
    texts = spark.createDataFrame([("a",), (None,)], "text string")
    assert keep_matching(texts, watch, "text", staging=Staging(spark)).collect() == []


def test_texts_with_candidates_of_patterns_travel_once(spark):
    terms = [f"common%piece{i}" for i in range(300)] + ["other_part%x", "%only this%"]
    rows = [(i, f"a common Piece{i} and" if i % 2 else f"piece{i} then common", "other-part x" if i == 4 else None) for i in range(0, 1000)]
    rows.append((1000, "nothing", "Only This"))
    df = spark.createDataFrame(rows, "id long, text string, note string")
    table = spark.createDataFrame([(t,) for t in terms], "match_term string")
    found = keep_matching(df, WatchList(table, "like", task_chars=10), "text", "note", staging=Staging(spark), keep=["id"])
    expected = [i for i, *texts in rows if any(like(p).search(t.lower()) for p in terms for t in texts if t)]
    assert sorted(r.id for r in found.collect()) == expected
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()  # a text meets its patterns by its number
    by_term = {r.match_term: (r.width, r.pattern, r.segment) for r in anchors_of(table, wildcards=True).collect()}
    assert by_term["%only this%"] == (8, None, b"only this")  # outer wildcards make no pattern


@pytest.mark.parametrize("proper", [False, True])
def test_windows_of_no_whole_term_stay_in_the_scan(spark, monkeypatch, proper):
    monkeypatch.setattr(blocked, "BLOCK", 37)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    rng = random.Random(3)
    table = spark.createDataFrame([("".join(rng.choice(words) for _ in range(15)),) for _ in range(40)], "match_term string")
    anchors = anchors_of(table, wildcards=False)
    shapes = anchors.selectExpr("width", "pattern IS NULL AS literal", "place", "octet_length(segment) AS size").groupBy("width", "literal", "place", "size").count().collect()
    kinds = blocked._Kind(anchors, shapes), blocked._Kind(anchors.limit(0), [])
    terms = anchors.collect()
    texts = [f"{t.match_term[:-1]}! {t.match_term[1:]}" for t in terms] + [f"--{t.match_term}--" for t in terms] + [t.match_term for t in terms]
    data, offsets = multipattern.lower_bytes(pa.array(texts))
    found = [i for text, *_ in blocked._candidates(data, offsets, [16], *kinds, proper) for i in text.to_pylist()]
    whole = set(range(40, 80 if proper else 120))
    assert whole <= set(found) and len(set(found) - whole) <= 4  # a bit map lets few others pass


def test_the_driver_holds_little_more_than_a_bit_map(spark):
    n = 300_000
    hashes = spark.range(n).selectExpr("xxhash64(id) AS hash")
    blocked.BitMap(hashes.limit(10), 10)
    tracemalloc.start()
    held = blocked.BitMap(hashes, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * (1 << held.bits) / 8  # rows of its words would take twenty times as much
    assert len(cloudpickle.dumps(held)) < 10_000  # nor does it go with each plan
    values = hashes.toArrow()["hash"].to_numpy().view("uint64")
    assert len(held.places(values)) == n
    others = np.random.default_rng(1).integers(0, 1 << 63, 1_000_000, "uint64")
    assert len(held.places(others)) < 100


def test_anchors_are_windows_of_the_longest_segment(spark):
    rng = random.Random(8)
    terms = {"".join(rng.choice("ab%_é/") for _ in range(rng.randrange(1, 40))) for _ in range(300)} | {"%", "_%", "x", "abc" * 200}
    table = spark.createDataFrame([(t,) for t in [*terms, *terms]], "match_term string")
    for wildcards in (True, False):
        anchors = {r.match_term: r for r in anchors_of(table, wildcards).collect()}
        parts = {t: multipattern.segments(t) if wildcards else [t] for t in terms}
        assert set(anchors) == {t for t in terms if parts[t]}
        for term, r in anchors.items():
            assert r.segment == max((p.encode() for p in parts[term]), key=len)
            assert r.pattern == (None if parts[term] == [term.strip("%") if wildcards else term] else like_regex(term))
            assert r.width == widest(len(r.segment)) and 0 <= r.place <= len(r.segment) - r.width
            windows = next(window_hashes(np.frombuffer(r.segment, "uint8"), [r.width]))[1]
            assert r.hash == windows[r.place].view("int64")
            assert r.ends == blocked.both_ends(windows[:1], windows[-1:], len(r.segment)).view("int64")[0]


def test_texts_of_settled_rows_and_without_pairs_stay_in_the_scan(spark):
    terms = [f"common%piece{i}" for i in range(300)] + ["listed literally", "ele_en%x", "%only this%"]
    rows = [(i, "listed LITERALLY, common piece1", None) if i % 4 else (i, f"common piece{i}" if i % 8 else "piece7 then common", "eleven x" if i == 16 else "") for i in range(2000)]
    rows += [(i, "listed literally", "a common piece2") for i in range(2000, 2010)] + [(3, "nothing", None), (None, "common, piece1", None), (None, "only this", "")]
    df = spark.createDataFrame(rows, "id long, text string, note string")
    table = spark.createDataFrame([(t,) for t in terms], "match_term string")
    written = []

    class Recording(Staging):
        def write(self, *args):
            written.append(super().write(*args))
            return written[-1]

    found = keep_matching(df, WatchList(table, "like", task_chars=10), "text", "note", staging=Recording(spark), keep=["id"])
    expected = [i for i, *texts in rows if any(like(p).search(t.lower()) for p in terms for t in texts if t)]
    assert sorted(str(r.id) for r in found.collect()) == sorted(map(str, expected))
    candidates, held, pairs = written[-3:]
    assert candidates.filter("whole IS NOT NULL").count() > 2000
    settled = {r._row for r in held.collect()}
    assert len(settled) == held.count() == 1511
    assert not settled & {r._of for r in pairs.collect()}
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # thins the texts before their shuffle
