"""Operators against brute force, reference libraries or exact round trips, with edge cases."""

import base64
import math
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from linkcensus.llm import ann, bpe, decontamination, id_files, kneser_ney, langid, sharding, toxicity, url_filter

DOCS = "doc_id long, text string, source string"
LONG = "lorem ipsum " * 4000 + "x" * 3000
TEXTS = [None, "", "   ", "a", "a", LONG, "Ünï cödé 日本語", "two\n\nlines \t x", "the cat the cat the dog", "the cat sat"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library_and_decodes(docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = bpe.with_tokens(docs, path, public_tokenizers.PATTERN, decoded=True)
    for row in tokens.collect():
        text = TEXTS[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    again = bpe.decode_documents(tokens.select("doc_id", "ids"), path, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in again.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.digests(bpe.with_tokens(nothing, path, public_tokenizers.PATTERN, decoded=True)).collect() == []


def test_bpe_of_long_pieces_equals_the_recursion(monkeypatch):
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    pieces = ["xyzzyabcabc" * 8, "é" * 40, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    by_recursion = codec.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "LONGEST", 4)
    assert codec.encode_pieces(pieces) == by_recursion


def test_bpe_in_many_small_queries(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    texts = pa.array(["", "some unremarkable wordzs, reworded " * 40, "é" * 300, "a  b", "x"])
    ids, counts = codec.encode(texts)
    small = bpe.Codec(path, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "RECURSION_ROWS", 1)
    monkeypatch.setattr(bpe, "DECODED_IDS", 7)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 2)
    for _ in range(3):
        again, numbers = small.encode(texts)
        assert again.tolist() == ids.tolist() and numbers.tolist() == counts.tolist()
    assert [b.decode() for b in small.decode(ids, counts)] == texts.to_pylist()


def test_id_files(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    folder, listing = id_files.write_id_files(docs, path)
    rows = id_files.read_id_files(folder, listing, id_files.documents_in, id_files.DOCUMENTS_IN).collect()
    found = {r.doc_id: (r.file_start + r.before, r.n_tokens, r.ids_crc32) for r in rows}
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, id_files.END_ID]
        assert found[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder, listing = id_files.write_id_files(nothing, path)
    assert id_files.read_id_files(folder, listing, id_files.documents_in, id_files.DOCUMENTS_IN).collect() == []


def test_repair_has_rules_and_keeps_every_document():
    rng = np.random.default_rng(3)
    ids = rng.choice([5, 6, 7, 8], p=[0.6, 0.2, 0.1, 0.1], size=20_000).astype("uint16")
    sizes = np.array([7000, 1, 12_999])
    file = id_files.IdFile(id_files.packed(np.array([3, 4, 9]), ids, sizes, 100))
    assert len(file.symbols) < len(ids) / 2 and len(file.length) > 100
    assert [file.ids(i).tolist() for i in range(3)] == [p.tolist() for p in np.split(ids, [7000, 7001])]
    assert file.sizes().tolist() == sizes.tolist()


def test_repair_ends_when_no_pair_is_frequent_and_stores_lengths_and_starts(monkeypatch):
    rng = np.random.default_rng(4)
    ids = np.tile(rng.integers(5, 9, 1000), 40).astype("uint16")  # repeats that need about ten rounds
    sizes = np.full(40, 1000)
    symbols, rules, per_doc = id_files.repair(ids, sizes, 65_536 - 9000)
    ends = np.cumsum(per_doc) - 1
    pairs = symbols[:-1].astype("uint32") << 16 | symbols[1:]
    inside = np.delete(pairs, ends[:-1])
    assert len(rules) < 9000 and max(Counter(inside.tolist()).values(), default=0) < id_files.LEAST_COUNT
    data = id_files.packed(np.arange(40), ids, sizes, 65_536 - 9000)
    file = id_files.IdFile(data)
    assert file.start.tolist() == [1000 * i for i in range(41)]
    assert np.array(file.start, "<u8").tobytes() in data and np.array(file.length[file.base :], "<u4").tobytes() in data
    assert [file.ids(i).tolist() for i in (0, 39)] == [ids[:1000].tolist()] * 2
    monkeypatch.setattr(id_files, "BLOCK_IDS", 2500)
    assert [x.tolist() for x in file.all_ids()] == [ids[:1000].tolist()] * 40


def test_plain_words_go_at_once_through_the_merges(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = id_files.WordEncoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    latin = [chr(c) for c in (*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x130)) if chr(c).lower() == chr(c)]
    words = ["".join(rng.choice(latin[: 26 if i % 2 else None], n)) for i, n in enumerate([1, 2, 3, 5, 8, 13, 40] * 40)]
    words += [w for w in (t.removesuffix("</w>") for t in library.get_vocab()) if w.isascii() and w.isalpha() and w.islower()]
    words += [*latin, "a" * 3000, "the" * 500, "ünïcödé" * 60]
    words = [*dict.fromkeys(words)]
    size, ids = encoder._letters(pa.array(words))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [
        x.ids for x in library.encode_batch_fast(words, add_special_tokens=False)
    ]
    monkeypatch.setattr(encoder, "fast", None)  # as with ids that do not follow the merges
    assert [x.tolist() for x in encoder._letters(pa.array(words))] == [size.tolist(), ids.tolist()]

    encoder, asked = id_files.WordEncoder(path), []
    monkeypatch.setattr(encoder, "_piece", lambda p: asked.append(p) or [1])
    encoder.encode(pa.array([" ".join(words)]))
    assert sorted(asked) == sorted(id_files._STOPS)  # no word is looked up alone


def test_shards(docs, nothing, spark):
    rows = sharding.assign_shards(docs.union(docs), 4).collect()
    assert len(rows) == 2 * len(TEXTS)
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    for r in rows:
        data = (TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    assert sharding.assign_shards(nothing).collect() == []
    even = sharding.assign_shards(spark.range(4000).selectExpr("id doc_id", "repeat('same', 5) text"), 8)
    sums = Counter()
    for r in even.collect():
        sums[r.shard] += r["size"]
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 42


def test_kneser_ney_equals_the_formula(docs, nothing):
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts, pairs = Counter(), Counter()
    for text in TEXTS:
        own = token(text)
        counts.update(own)
        pairs.update(zip(["<start>", *own], own, strict=False))
    contexts, follow, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), c in pairs.items():
        follow[u] += c
        kinds[u][min(c, 3) - 1] += 1
    times = lambda values: [sum(v == i for v in values) for i in (1, 2, 3, 4)]
    d, low_d = kneser_ney.discounts(times(pairs.values())), kneser_ney.discounts(times(contexts.values()))
    spare = sum(low_d[min(c, 3)] for c in contexts.values()) / len(pairs) / (len(counts) + 1)

    def chance(u, w):
        low = max(contexts[w] - low_d[min(contexts[w], 3)], 0) / len(pairs) + spare
        back = sum(x * n for x, n in zip(d[1:], kinds[u], strict=True)) / follow[u] if follow[u] else 1
        return (max(pairs[u, w] - d[min(pairs[u, w], 3)], 0) / follow[u] if follow[u] else 0) + back * low

    model = kneser_ney.train(docs)
    assert (model.n, model.v) == (sum(counts.values()), len(counts))
    for row in kneser_ney.scored(docs, model).collect():
        own = token(TEXTS[row.doc_id])
        assert (row.n_tokens, row.n_known) == (len(own), len(own))
        assert math.isclose(row.score, sum(math.log10(chance(u, w)) for u, w in zip(["<start>", *own], own, strict=False)))
    assert math.isclose(sum(chance("the", w) for w in counts) + chance("the", "unseen"), 1)
    row = kneser_ney.scored(docs, kneser_ney.train(nothing)).filter("doc_id = 0").first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (1, 0, 0, 0)


def test_kneser_ney_of_order_3_equals_the_formula(spark, docs, nothing):
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    rng = np.random.default_rng(5)
    texts = [*TEXTS, *(" ".join(rng.choice(list("abcdefghij"), 40, p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01])) for _ in range(40))]
    grams = lambda t: list(zip(["<s>", "<s>", *token(t)], ["<s>", *token(t)], token(t), strict=False))
    triples = Counter(g for t in texts for g in grams(t))
    counts = Counter(w for t in texts for w in token(t))
    pairs = Counter(g[1:] for g in triples)
    words = Counter(w for _, w in pairs)
    times = lambda values: [sum(v == i for v in values) for i in (1, 2, 3, 4)]
    d3, d2, d1 = (kneser_ney.discounts(times(c.values())) for c in (triples, pairs, words))
    follow = defaultdict(Counter)
    for level in (triples, pairs):
        for g, c in level.items():
            follow[g[:-1]][g[-1]] = c

    def level(context, w, d, low):
        own = follow.get(context, Counter())
        total = sum(own.values())
        return (max(own[w] - d[min(own[w], 3)], 0) + sum(d[min(c, 3)] for c in own.values()) * low) / total if total else low

    def chance(u, v, w):
        low = (max(words[w] - d1[min(words[w], 3)], 0) + sum(d1[min(c, 3)] for c in words.values()) / (len(counts) + 1)) / len(pairs)
        return level((u, v), w, d3, level((v,), w, d2, low))

    model = kneser_ney.train(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS), order=3)
    assert (model.n, model.v) == (sum(counts.values()), len(counts))
    assert {len(model.pairs), len(model.bigrams) > 1} == {1, True}
    asked = [*texts, "the cat unseen", "unseen unseen a", "j j j j", "a b unseen b"]
    for row in kneser_ney.scored(spark.createDataFrame([(i, t, "s") for i, t in enumerate(asked)], DOCS), model).collect():
        own = token(asked[row.doc_id])
        assert (row.n_tokens, row.n_known) == (len(own), sum(w in counts for w in own))
        assert math.isclose(row.score, sum(math.log10(chance(*g)) for g in grams(asked[row.doc_id])), rel_tol=1e-9)
    assert math.isclose(sum(chance("the", "cat", w) for w in counts) + chance("the", "cat", "unseen"), 1)
    row = kneser_ney.scored(docs, kneser_ney.train(nothing, order=3)).filter("doc_id = 0").first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (1, 0, 0, 0)


def test_kneser_ney_files_are_compact(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 50_000) for _ in range(400)]
    model = kneser_ney.train(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS), order=3)
    grams = {g for t in texts for g in zip(["<s>", "<s>", *t.split()], ["<s>", *t.split()], [*t.split(), None], strict=False)}
    folder = pathlib.Path(model.folder.removeprefix("file://"))
    assert sum(f.stat().st_size for f in folder.iterdir()) < 18 * len(grams)


def test_kneser_ney_blobs_and_keys(monkeypatch):
    rng = np.random.default_rng(4)
    v, w, u = (np.minimum(rng.zipf(1.2, 30_000), 3000) for _ in range(3))
    rows = Counter(zip(v.tolist(), w.tolist(), u.tolist(), strict=True))
    known, rare = 2500, np.sort(rng.integers(-(1 << 62), 1 << 62, 501))
    for bits in (kneser_ney._BITS, 2):  # codes too large to be sorted as one number
        monkeypatch.setattr(kneser_ney, "_BITS", bits)
        *keys, n = kneser_ney._distinct(v, w, u)
        assert dict(zip(zip(*(k.tolist() for k in keys), strict=True), n.tolist(), strict=True)) == rows
        assert [x.tolist() for x in kneser_ney._distinct(*keys, n)] == [*(k.tolist() for k in keys), n.tolist()]
    blob = kneser_ney._packed(keys, [n - 1], known, rare)
    got, (less,), far = kneser_ney._unpacked(blob)
    word = lambda code, hashes: np.where(code < known, code, hashes[np.maximum(code - known, 0)])
    assert all((word(a, far) == word(b, rare)).all() for a, b in zip(got, keys, strict=True)) and (less == n - 1).all()
    assert len(blob) < 5 * len(n) + 8 * len(rare)
    none = np.empty(0, "int64")
    assert [x.tolist() for x in kneser_ney._unpacked(kneser_ney._packed([none, none], [none], 5, none))[0]] == [[], []]

    some = np.unique(rng.integers(0, 1 << 63, 5000).astype("uint64") << np.uint64(1))
    some = np.unique(np.concatenate([some, some[:50] + np.uint64(1 << 24), some[:50] + np.uint64(1 << 25)]))  # as far as the last of 40 bits
    arrays = kneser_ney._keys("k", some)
    at, seen = kneser_ney._find(arrays, "k", np.concatenate([some[::-1], some ^ np.uint64(1 << 40)]))
    assert at.tolist() == list(range(len(some)))[::-1] and seen.tolist() == list(range(len(some)))
    for n in (np.array([0, 14, 15, 70_000, 3]), np.empty(0, "int64")):
        assert kneser_ney._numbers(kneser_ney._small("n", n), "n", np.arange(len(n))).tolist() == n.tolist()


def test_language_filter(spark, docs, nothing):
    de, en = "der hund und die katze schlafen heute", "the dog and the cat are sleeping today"
    labelled = spark.createDataFrame([(de, "de"), (en, "en"), (None, "fr"), (en, None)], "text string, lang string")
    model = langid.train(labelled)
    names, scores = model.predict([de, en, "", "123 !?", "die katze", "the cat"])
    assert names == ["de", "en", "und", "und", "de", "en"] and 0 <= scores.min() and scores.max() <= 1
    out = langid.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score"] and out.count() == len(TEXTS)
    assert {r.lang_pred for r in langid.identify(docs, langid.train(labelled.limit(0))).collect()} == {"und"}
    assert langid.identify(nothing, model).collect() == []


def test_toxicity_tolerates_inserted_characters():
    rng = np.random.default_rng(1)
    plain = lambda: " ".join("".join(rng.choice(list("aeioutnrsl"), 6)) for _ in range(20))
    clean, toxic = [f"{plain()} you {plain()}." for _ in range(150)], [f"{plain()} you {w} {plain()}." for w in ["blockhead", "scumbag", "dimwit"] * 30]
    model = toxicity.fit(toxic, clean)
    text = pa.array(["what a blockhead", "a block-head", "s c u m b a g here", "scummbag", "dim.wit", *[plain() for _ in range(20)], "", None])
    scores = model.scores(text)
    assert (scores[:5] > 0.5).all() and (scores[5:] < 0.5).all() and scores.min() >= 0


def test_toxicity_of_one_class(spark, docs, nothing):
    labels = spark.createDataFrame([(3, 1), (4, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()} == {1.0}
    assert {r.score for r in toxicity.scored(docs, toxicity.train(nothing, labels)).collect()} == {0.0}


def test_decontamination(spark, docs, nothing):
    passage = "It was a bright cold day in April, and the clocks were striking thirteen; nobody in the street looked up."
    edited = passage.replace("bright", "brigt").replace("clocks", "clockss")
    texts = [passage, f"before {edited.upper()} after", passage[:60], "nothing here", None, "", f"{LONG} {passage}", "see ok ok2"]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    benchmark = spark.createDataFrame([(7, passage), (8, None), (9, " "), (10, "ok2"), (7, passage)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontamination.find_leaks(rows, benchmark).collect()}
    assert found == {(0, 7): 0, (1, 7): 2, (6, 7): 0, (7, 10): 0}
    kept = decontamination.without_leaks(rows, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and set(kept.columns) == set(rows.columns)
    assert decontamination.find_leaks(rows, benchmark.limit(0)).collect() == []
    assert decontamination.find_leaks(nothing, benchmark).collect() == []


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).astype("float32")
    x[40:80] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 6), (1040, [float("nan")] * 6), (1060, [None] * 6), (1080, [1.0])]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(vectors, 20, entries=10**6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    exact = x.astype(float) @ x.astype(float).T
    for q in range(0, 300, 20):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-round(exact[q, i], 9), i))[:20]
        assert [i for i, _ in got[q]] == order
    assert set(got) == set(range(0, 300, 20))
    assert ann.nearest(vectors.limit(0)).collect() == []


def test_temporal_lists(spark):
    entries = spark.createDataFrame(
        [("block", "Example.org", "2024-01-10", 1, True), ("block", "example.org", "2024-03-01", 2, False), ("allow", "example.org/ok", "2024-02-01", 3, True),
         ("block", None, "2024-01-01", 4, True), ("block", "x.org", None, 5, True), ("block", "example.org", "2024-01-10", 0, False)],
        "list string, pattern string, day string, seq long, added boolean",
    ).withColumn("day", url_filter.F.col("day").cast("date"))
    spans = url_filter.validity_intervals(entries)
    rows = [(1, "http://www.example.org/a", "2024-01-09"), (2, "http://www.example.org/a", "2024-01-10"), (3, "http://example.org/ok/b", "2024-02-02"),
            (4, "https://u@EXAMPLE.org:80/ok", "2024-03-02"), (5, None, "2024-02-02"), (6, "no url", "2024-02-02"), (7, "http://badexample.org/", "2024-02-02"),
            (8, "http://example.org/okay", "2024-02-29"), (9, "http://example.org/", None)]
    captures = spark.createDataFrame(rows, "capture_id long, url string, day string").selectExpr("capture_id", "url", "cast(day as date) fetched_on")
    got = {r.capture_id: (r.n_active, r.decided_by, r.blocked) for r in url_filter.judged(captures, spans).collect()}
    none = (0, None, False)
    assert got == {1: none, 2: (1, "example.org", True), 3: (2, "example.org/ok", False), 4: (1, "example.org/ok", False), 5: none, 6: none, 7: none,
                   8: (1, "example.org", True), 9: none}
    assert url_filter.judged(captures.limit(0), spans).collect() == []
    assert not any(r.blocked for r in url_filter.judged(captures, spans.limit(0)).collect())


def test_one_letter_has_a_language(spark):
    labelled = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr")], "text string, lang string")
    model = langid.train(labelled)
    texts = ["a", "I", "x 1", "é", "ab", "1", "...", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in range(5)] == [("en", 0.5)] * 5
    assert [got[i] for i in range(5, 9)] == [("und", 0.0)] * 4


def test_days_far_off_cost_no_rows(spark):
    entries = spark.sql("SELECT 'block' list, 'h' || id || '.org' pattern, DATE'2023-01-01' day, id seq, true added FROM range(50)")
    spans = url_filter.validity_intervals(entries)
    days = ["0001-01-01", "2023-01-01", "2023-01-01", "9999-12-31", None]
    captures = spark.createDataFrame([(i, f"http://h{i}.org/x", d) for i, d in enumerate(days)], "capture_id long, url string, day string")
    captures = captures.selectExpr("capture_id", "url", "CAST(day AS DATE) AS fetched_on")
    judged = url_filter.judged(captures.union(captures), spans)
    assert {r.capture_id: (r.n_active, r.blocked) for r in judged.collect()} == {
        0: (0, False), 1: (1, True), 2: (1, True), 3: (1, True), 4: (0, False)
    }
    assert "explode(filter(" in judged._jdf.queryExecution().optimizedPlan().toString()
