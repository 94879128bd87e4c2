"""Phrase collocations against plain counting in Python, with ids by rank and by hash."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkcensus.llm import collocations, queries

DOCS = "doc_id long, text string, lang string, score string, rank int"
WORDS = ["of", "The", "a", "é x", "\x01", "w" * 80, "Ünï", "b", "c\\d", "'x'", "\U0001f600"]


def texts(seed, n=120):
    rng = random.Random(seed)
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;:!?\n\r\x0b\x0c", "fr"), ("of the a " * 300, "en")]
    for _ in range(n):
        words = [rng.choice(WORDS[: rng.choice([3, 6, len(WORDS)])]) for _ in range(rng.randrange(1, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for w in words)
        rows.append((text, rng.choice(["en", "fr", None])))
    return rows + rows[-3:]


def brute(rows, least, top, inside=50):
    counts = defaultdict(Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * c >= inside * a for q, c in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n, -s))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("head, partitions", [(1 << 17, 2), (4, 3), (0, 1)])
def test_equals_plain_counting(spark, monkeypatch, head, partitions):
    monkeypatch.setattr(collocations, "HEAD", head)
    rows = texts(head)
    docs = spark.createDataFrame([(i, *r, "own", 7) for i, r in enumerate(rows)], DOCS).repartition(partitions)
    got = collocations.collocations(docs, least=3, top=12)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 12)


def test_nothing_gives_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect() == []


def test_tiles_count_pairs_dense_and_sparse(monkeypatch):
    monkeypatch.setattr(collocations, "DENSE_PAIRS", 500)
    monkeypatch.setattr(collocations, "DENSE_TILES", 2)
    rng = np.random.default_rng(1)
    tiles, want = collocations.Tiles(), Counter()
    for _ in range(4):
        left, right = (np.minimum(rng.geometric(p, 3000), 5000) for p in (0.002, 0.001))
        tiles.add(left, right)
        want.update(zip(left.tolist(), right.tolist(), strict=True))
    tiles.merge()
    assert len(tiles.dense) == 2 and tiles.held == len(tiles.keys[0])
    got = Counter()
    for a, b, n in tiles.taken():
        for x, y, z in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
            assert (x, y) not in got
            got[x, y] = z
    assert got == want
    assert [x for part in tiles.taken() for x in part[2].tolist()] == []


def test_words_of_slices():
    whole = pa.array(["no", "a b.c", "", "d", "e\tf  g"])
    code, words, piece, text = collocations.words_in_pieces(whole[1:])
    assert [words[i].as_py() for i in code] == list("abcdefg")
    assert text.tolist() == [0, 0, 0, 2, 3, 3, 3] and [x == piece[0] for x in piece] == [True, True] + [False] * 5
    assert piece[3] != piece[4] == piece[5] == piece[6] and piece[2] != piece[3]


def test_shared_hash_is_counted_with_another_seed(spark, monkeypatch):
    rows = [("a b a b c", "en")] * 4
    docs = spark.createDataFrame([(i, *r, "", 0) for i, r in enumerate(rows)], DOCS)
    words, seed = collocations._word_counts(docs)
    assert seed == 0 and words.count() == 3
    plain = collocations._scan
    monkeypatch.setattr(collocations, "_scan", lambda d, s, *a: plain(d, s, *a).withColumn("h", F.col("h") * s))
    assert collocations._word_counts(docs)[1] == 1


def test_query_equals_sql(spark, tmp_path):
    rows = texts(5, 400)
    docs = spark.createDataFrame([(i, *r, "own", 7) for i, r in enumerate(rows)], DOCS).drop("score", "rank")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.sql(queries.ORACLES["op12_phrase_tiles"])
    assert result.columns == COLUMNS
    got = queries.op12_phrase_tiles(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == sorted(result.fetchall()) == brute(rows, 10, 2000)
