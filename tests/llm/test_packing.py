"""Bounded-space packing against the tokenizers library: every id in one piece, no padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkcensus.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, length int"
TEXTS = [
    None, "", "   ", "a", "a", "lorem ipsum " * 4000 + "x" * 3000, "Ünï cödé 日本語", "two\n\nlines \t x", "  ok x\u0085",
    "don't <|endoftext|> stop", *(f"word{i} and more " * (i % 37) for i in range(120)),
]


def check(rows, texts, window):
    """Pieces cover each document once, windows have no gap, and only powers of two fall short."""
    library, of_doc, of_sequence = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    assert sorted(of_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        upto = 0
        for r in sorted(of_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (upto, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[upto : upto + r.length].tobytes()) and r.length > 0
            upto += r.length
        assert upto == len(ids)
    padding = 0
    for parts in of_sequence.values():
        upto = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == upto
            upto += r.length
        assert upto <= window
        padding += 0 if upto & (upto - 1) == 0 else window - upto
    assert padding == 0
    return of_sequence


@pytest.mark.parametrize("window, open_windows, partitions", [(1024, 32, 3), (64, 2, 5), (1, 1, 2), (16, 4, 40)])
def test_pieces_cover_all_ids(spark, monkeypatch, window, open_windows, partitions):
    monkeypatch.setattr(packing, "MERGED_TASKS", 2)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], DOCS).repartition(partitions)
    pieces = packing.packed(docs, PATH, window, open_windows, with_ids=True)
    assert pieces.columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset ids".split()
    rows = pieces.collect()
    groups = check(rows, TEXTS, window)
    made = {r.sequence_id: r for r in packing.sequences(pieces, window).collect()}
    assert set(made) == set(groups)
    for key, parts in groups.items():
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in sorted(parts, key=lambda r: r.offset)), "<u4")
        assert made[key].length == len(ids) == len(made[key].ids)
        assert made[key].ids == ids.tolist()


def test_documents_are_cut_seldom(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('some words ', int(1 + hash(id) % 40 + 40)) AS text")
    pieces = packing.packed(docs.coalesce(2), PATH)
    sequences = pieces.select("sequence_id").distinct().count()
    assert pieces.count() - 3000 <= sequences + 2 * 32 + 20  # a cut per window, besides the last ones


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "same text"), (None, "same text"), (7, "x"), (7, "x")]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted(str(r.doc_id) for r in got if r.start == 0) == ["7", "7", "None", "None"]
    assert sum(r.length for r in got) == 2 * 3 + 2 * 2
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH, window=1000)


def test_other_tokenizers_go_through_the_library():
    assert packing.TextEncoder(PATH).fast is not None
    assert packing.TextEncoder(public_tokenizers.path("word_bpe_49k.json")).fast is None


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_bounded_packing(spark, str(tmp_path))
    assert "doc_id bigint start bigint length bigint ids_crc32 bigint doc_tokens bigint sequence_id bigint offset bigint".split() == [
        x for c in found.dtypes for x in c
    ]
    check(found.collect(), TEXTS, 1024)
