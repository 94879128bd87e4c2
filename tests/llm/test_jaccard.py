"""The Jaccard join against all pairs, on small and large buckets, and its edge cases."""

import random
import re

import pytest

from linkcensus.llm import jaccard
from linkcensus.llm.components import components

SCHEMA = "doc_id long, text string"


def words(n, rng):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def near_groups(seed, groups=4, copies=14, size=60):
    rng, texts = random.Random(seed), []
    for _ in range(groups):
        base = words(size, rng)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [" ".join(words(rng.randrange(1, 30), rng)) for _ in range(20)]
    return texts


def brute(rows):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("crowd", [48, 3])
def test_equals_all_pairs(spark, crowd):
    texts = near_groups(crowd)
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[0], None, "", " \t\n", "One two", "one TWO", "one two three"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA), crowd).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("crowd", [48, 1])
def test_rows_without_an_id_link_others(spark, crowd):
    rng = random.Random(11)
    base = words(60, rng)
    near = lambda *at: " ".join("z" if i in at else w for i, w in enumerate(base))
    # the ends share 46 of 66 shingles, each 51 of 61 with the one between
    rows = [(1, near(20)), (None, near()), (2, near(40)), (None, None), (None, ""), (3, " ".join(words(60, rng))), (None, "x y z"), (None, "X y z")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA), crowd).collect()
    assert brute([(i, t) for i, t in rows if i])[2][1] == 2  # not near without the one between
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 3: 3}
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None and r.component_id) == [(56, 1)]
    assert len(got) == len(rows)


def test_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (9, None), (9, None), (7, "q r s t u"), (7, "q r s t u")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", component_id string")
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "A b c d e f g"), (7, "q r s t u"), (9, None), (9, None)]


def test_empty_table(spark):
    assert jaccard.similar_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
