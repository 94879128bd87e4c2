"""Collocations: phrases of two and three words that occur far more often than their parts would together.

Words are `[^\\x20\\x09]+` of texts with A-Z in lower case, within pieces that end at
`[.,;:!?\\x0A-\\x0D]`; everything is counted per language. Three passes over the texts count
words, then pairs of words, then pairs of a frequent pair and a word.

A word's id is its rank by frequency if it is among the head, at most HEAD words of bounded
length that every task holds as sorted hashes, and its 62-bit hash otherwise. Pairs of ranks
are counted directly by address: the square of ranks is cut into tiles, and a tile that gets many pairs
in a chunk is a dense array that `numpy.bincount` fills, while the pairs of all other tiles
are kept as sorted coordinates with counts. The pairs found frequent are ranked anew,
and the same counting with their ranks on the left gives phrases of three words. Spark adds
up what the tasks have, by ids. Pairs and phrases beyond the heads are counted by their ids
alone; bit maps of fixed size, without false negatives, rule out most that can't be frequent.

Hashes are exact ids: where two words of the corpus share one, all is counted with another seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkcensus.llm.common import stored, text_chunks

LEAST = 10  # occurrences of a candidate
TOP = 2000  # collocations of each language
INSIDE = 50  # per cent of a phrase's occurrences within a longer one that make it a part of that
HEAD = 1 << 17  # words, and pairs, whose ranks every task holds
HEAD_WORD_BYTES = 64
TILE = 10  # bits of a rank within a tile
DENSE_PAIRS = 1 << 16  # a tile that gets so many pairs from one chunk becomes dense
DENSE_TILES = 8  # that one task holds, of 4 MB each
HELD_PAIRS = 1_500_000  # coordinates that a task merges before it passes them on
BATCH_ROWS = 1 << 16  # that a task passes on at a time
FILTER_BITS = 24
CHUNK_BYTES = 4 << 20
_TAIL = np.int64(1 << 62)
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, "uint8")
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK


@dataclass
class Tokens:
    """Words of some texts: code of each in order, piece of each; per code its language, word and hash."""

    code: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    word: pa.Array
    hash: np.ndarray


def words_in_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Per word its code, its piece and its text; and the distinct words. Texts are strings, none null."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64")
    ends = np.cumsum(size)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], "int32"), texts.cast(pa.binary())), b"")[0].as_buffer()
    data = _LOWER[np.frombuffer(joined, "uint8")] if len(texts) and ends[-1] else np.empty(0, "uint8")
    kind = _KIND[data]
    begins = np.zeros(len(data) + 1, "bool")
    begins[ends - size] = True
    word = kind == _WORD
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:-1]
    at = np.flatnonzero(first)
    upto = np.append(np.cumsum(word)[at] - 1, word.sum()).astype("int32")
    letters = data[word]
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(upto), pa.py_buffer(letters)).dictionary_encode()
    piece = np.cumsum((kind == _BREAK) | begins[:-1])[at]
    return found.indices.to_numpy(), found.dictionary, piece, np.searchsorted(ends - size, at, "right") - 1


def tokens_of(texts: pa.Array, langs: pa.Array, seed: int) -> Tokens:
    code, words, piece, text = words_in_pieces(texts)
    coded = langs.dictionary_encode()
    both = coded.indices.to_numpy()[text].astype("int64") * len(words) + code
    if len(coded.dictionary) * len(words) < 4 * len(both) + 1024:
        distinct = np.flatnonzero(np.bincount(both))
        place = np.zeros(len(coded.dictionary) * len(words) + 1, "int64")
        place[distinct] = np.arange(len(distinct))
        code = place[both]
    else:
        distinct, code = np.unique(both, return_inverse=True)
    lang, word = (distinct // max(len(words), 1)), words.take(pa.array(distinct % max(len(words), 1)))
    key = f"collocations{seed:04}"
    hashes = [pd.util.hash_array(x.to_numpy(zero_copy_only=False), hash_key=key, categorize=False) for x in (word, coded.dictionary)]
    mixed = _mixed(hashes[0] + _mixed(hashes[1])[lang]) >> np.uint64(2)
    return Tokens(code, piece, coded.dictionary.take(pa.array(lang)), word, mixed.astype("int64"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Tiles:
    """Counts of pairs of ranks: dense tiles, and sorted coordinates for the others."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        side = (HEAD >> TILE) + 1
        tile = (left >> TILE) * side + (right >> TILE)
        for t in np.flatnonzero(np.bincount(tile, minlength=1) >= DENSE_PAIRS).tolist():
            if t not in self.dense and len(self.dense) < DENSE_TILES:
                self.dense[t] = np.zeros(1 << 2 * TILE, "int32")
        low = (1 << TILE) - 1
        rest = np.ones(len(tile), "bool")
        for t, cells in self.dense.items():
            here = tile == t
            cells += np.bincount((left[here] & low) << TILE | right[here] & low, minlength=len(cells)).astype("int32")
            rest &= ~here
        keys, counts = np.unique(left[rest] << 32 | right[rest], return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "int64")
            self.keys, self.counts = [keys[start]], [np.add.reduceat(counts[order], start) if len(start) else counts]
            self.held = len(start)

    def taken(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Left ranks, right ranks, counts of all that is held; nothing is held afterwards."""
        self.merge()
        for keys, counts in zip(self.keys, self.counts, strict=True):
            yield keys >> 32, keys & 0xFFFFFFFF, counts
        side = (HEAD >> TILE) + 1
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield (t // side << TILE) + (at >> TILE), (t % side << TILE) + (at & (1 << TILE) - 1), cells[at].astype("int64")
        self.__init__()


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of the columns, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), "bool")
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return [*(c[start] for c in columns), np.diff(np.append(start, len(order)))]


class Lookup:
    """Rank of each key of a head, and a bit map of keys beyond it."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray | None):
        """keys: by rank. bits: FILTER_BITS bits as uint64, or None where no key lies beyond the head."""
        self.order = np.argsort(keys)
        self.sorted, self.bits = keys[self.order], bits

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """-1 where the key is not in the head."""
        if not len(self.sorted):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.order[at], -1)

    def may_be(self, hashes: np.ndarray) -> np.ndarray:
        """Whether a key with this 62-bit hash may lie beyond the head."""
        if self.bits is None:
            return np.zeros(len(hashes), "bool")
        bit = hashes.astype("uint64") >> np.uint64(62 - FILTER_BITS)
        return (self.bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype("bool")


def _bit_map(hashes: DataFrame) -> np.ndarray | None:
    """The bit map of 62-bit hashes in a column `h`: at most 2^FILTER_BITS / 64 rows come to the driver."""
    bit = F.shiftright("h", 62 - FILTER_BITS)
    parts = hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(shiftright(h, {62 - FILTER_BITS}) & 63))")).alias("bits")
    ).toPandas()
    if parts.empty:
        return None
    out = np.zeros(1 << FILTER_BITS - 6, "uint64")
    out[parts["at"].to_numpy()] = parts["bits"].to_numpy().view("uint64")
    return out


def _head_least(counted: DataFrame, eligible: Column) -> Column:
    """Test for the most frequent eligible rows of (f), as many as whole steps of frequency let into HEAD."""
    step = F.floor(F.log2("f") * 16).cast("int")
    sizes = sorted(((r.step, r.n) for r in counted.filter(eligible).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for at, n in sizes:
        taken += n
        if taken > HEAD:
            break
        least = at
    return F.lit(False) if least is None else eligible & (step >= least)


def _scan(docs: DataFrame, seed: int, count: Callable[[Tokens], Iterator[tuple]], rest: Callable[[], Iterator[tuple]], columns: str) -> DataFrame:
    """Rows that `count` gives for each chunk of texts, and `rest` at the end of a task."""
    names = [c.split()[0] for c in columns.split(", ")]

    def parts(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            whole = pa.RecordBatch.from_arrays([pa.array(x) for x in row], names)
            for a in range(0, whole.num_rows, BATCH_ROWS):
                yield whole.slice(a, BATCH_ROWS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch["text"], batch["lang"]
            for a, b in text_chunks(texts, CHUNK_BYTES):
                yield from parts(count(tokens_of(texts[a:b], langs[a:b], seed)))
                pa.default_memory_pool().release_unused()
        yield from parts(rest())

    return docs.mapInArrow(scan, columns)


def _word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(h, lang, word, f) of all words, and the seed with which no two share an h."""
    seed = 0
    while True:
        def count(t: Tokens) -> Iterator[tuple]:
            yield t.hash, t.lang, t.word, np.bincount(t.code, minlength=len(t.hash))

        rows = _scan(docs, seed, count, lambda: iter(()), "h long, lang string, word string, n long")
        words = stored(rows.groupBy("h", "lang", "word").agg(F.sum("n").alias("f")), "collocations-words")
        if words.groupBy("h").count().filter("count > 1").isEmpty():
            return words, seed
        seed += 1


def _pair_counts(docs: DataFrame, seed: int, words: Lookup) -> DataFrame:
    """(a, b, f) of pairs of neighbouring words that may be frequent."""
    tiles = Tiles()

    def count(t: Tokens) -> Iterator[tuple]:
        ids = _ids(t, words)
        left, right = ids[:-1], ids[1:]
        there = (left >= 0) & (right >= 0) & (t.piece[:-1] == t.piece[1:])
        head = there & (left < _TAIL) & (right < _TAIL)
        tiles.add(left[head], right[head])
        yield tuple(_distinct(left[there & ~head], right[there & ~head]))
        yield from _merged(tiles)

    rows = _scan(docs, seed, count, tiles.taken, "a long, b long, n long")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("f"))


def _triple_counts(docs: DataFrame, seed: int, words: Lookup, pairs: Lookup, pair_ids: np.ndarray) -> DataFrame:
    """(a, b, c, f) of phrases both of whose pairs may be frequent. pair_ids: the two ids of each head pair."""
    tiles = Tiles()

    def named(pair: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple:
        return pair_ids[pair, 0], pair_ids[pair, 1], word, n

    def count(t: Tokens) -> Iterator[tuple]:
        ids = _ids(t, words)
        left, right = ids[:-1], ids[1:]
        there = (left >= 0) & (right >= 0) & (t.piece[:-1] == t.piece[1:])
        rank = np.full(len(left), -1)
        head = there & (left < _TAIL) & (right < _TAIL)
        rank[head] = pairs.ranks(left[head] << 32 | right[head])
        rest = np.flatnonzero(there & (rank < 0))
        there[rest] = pairs.may_be(_pair_hash(left[rest], right[rest]))
        three = np.flatnonzero(there[:-1] & there[1:])
        a, b, c, rank = ids[three], ids[three + 1], ids[three + 2], rank[three]
        head = (rank >= 0) & (c < _TAIL)
        tiles.add(rank[head], c[head])
        yield tuple(_distinct(a[~head], b[~head], c[~head]))
        for some in _merged(tiles):
            yield named(*some)

    def rest() -> Iterator[tuple]:
        for some in tiles.taken():
            yield named(*some)

    rows = _scan(docs, seed, count, rest, "a long, b long, c long, n long")
    return rows.groupBy("a", "b", "c").agg(F.sum("n").alias("f"))


def _ids(t: Tokens, words: Lookup) -> np.ndarray:
    """Ids of the words in order; -1 for those that can't be frequent."""
    rank = words.ranks(t.hash)
    return np.where(rank >= 0, rank, np.where(words.may_be(t.hash), t.hash | _TAIL, -1))[t.code]


def _merged(tiles: Tiles) -> Iterator[tuple]:
    if tiles.held > HELD_PAIRS:
        tiles.merge()
        if tiles.held > HELD_PAIRS // 2:
            yield from tiles.taken()


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mixed(_mixed(a.astype("uint64")) + b.astype("uint64")) >> np.uint64(2)).astype("int64")


def _with_pair_hash(pairs: DataFrame) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pair_hash(batch["a"].to_numpy(), batch["b"].to_numpy()))], ["h"])

    return pairs.select("a", "b").mapInArrow(hashed, "h long")


def phrases(docs: DataFrame, least: int = LEAST, inside: int = INSIDE) -> tuple[DataFrame, DataFrame]:
    """Candidates of `docs` (text, lang), and (lang, n): the words of each language.

    Candidates: lang, phrase, a (occurrences), l and r (those of the two parts at the cut that
    scores lowest), score (1000000 a a / (l r), rounded down). Parts of a longer phrase that has
    `inside` per cent of their occurrences are left out.

    Null texts are empty, a null lang is `und`. Repeated rows count each. Other columns are not
    looked at. An empty table gives empty tables.
    """
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted, seed = _word_counts(docs)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))

    # Ranks of the head words; ids of all frequent ones.
    often = counted.filter(F.col("f") >= least)
    in_head = _head_least(often, F.octet_length("word") <= HEAD_WORD_BYTES)
    head = often.filter(in_head).select("h", "f").toPandas().sort_values(["f", "h"], ascending=[False, True])  # at most HEAD
    spark = docs.sparkSession
    ranked = spark.createDataFrame(pa.table({"h": pa.array(head["h"], "int64"), "rank": pa.array(np.arange(len(head)), "int64")}))
    beyond = often.filter(~in_head)
    tail_words = beyond.select(F.col("h").bitwiseOR(F.lit(int(_TAIL))).alias("id"), "lang", "word", "f")
    head_words = often.filter(in_head).join(F.broadcast(ranked), "h").select(F.col("rank").alias("id"), "lang", "word", "f")
    words = Lookup(head["h"].to_numpy("int64"), _bit_map(beyond.select("h")))

    # Pairs, and the ranks of those of two head words.
    pairs = stored(_pair_counts(docs, seed, words).filter(F.col("f") >= least), "collocations-pairs")
    in_head = _head_least(pairs, (F.col("a") < int(_TAIL)) & (F.col("b") < int(_TAIL)))
    head = pairs.filter(in_head).toPandas().sort_values(["f", "a", "b"], ascending=[False, True, True])  # at most HEAD
    pair_ids = head[["a", "b"]].to_numpy("int64")
    lookup = Lookup(pair_ids[:, 0] << 32 | pair_ids[:, 1], _bit_map(_with_pair_hash(pairs.filter(~in_head))))
    triples = stored(_triple_counts(docs, seed, words, lookup, pair_ids).filter(F.col("f") >= least), "collocations-triples")

    def with_word(df: DataFrame, at: str) -> DataFrame:
        """Word and frequency of the id in column `at`; only head words, a bounded table, are broadcast."""
        for table, mark in ((F.broadcast(head_words), "h"), (tail_words, "t")):
            named = table.select(F.col("id").alias(at), *(F.col(c).alias(f"_{mark}_{c}") for c in ("lang", "word", "f")))
            df = df.join(named, at, "left")
        return df.select(
            *[c for c in df.columns if not c.startswith(("_h_", "_t_", "lang"))],
            F.coalesce("_h_lang", "_t_lang").alias("lang"),
            F.coalesce("_h_word", "_t_word").alias(f"word_{at}"),
            F.coalesce("_h_f", "_t_f").alias(f"f_{at}"),
        )

    part = triples.select("a", "b", "f").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f"))
    longer = part.groupBy("a", "b").agg(F.max("f").alias("longer"))
    two = pairs.join(longer, ["a", "b"], "left").filter(F.col("longer").isNull() | ~_at_least("longer", "f", inside)).drop("longer")
    two = with_word(with_word(two, "a"), "b").select(
        "lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("a"),
        F.col("f_a").alias("l"), F.col("f_b").alias("r"), _score("f", "f_a", "f_b").alias("score"),
    )
    three = triples.join(pairs.withColumnRenamed("f", "f_ab"), ["a", "b"])
    three = three.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc")), ["b", "c"])
    three = with_word(with_word(with_word(three, "a"), "b"), "c")
    three = three.withColumn("s1", _score("f", "f_a", "f_bc")).withColumn("s2", _score("f", "f_ab", "f_c"))
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("a"),
        F.when(first, F.col("f_a")).otherwise(F.col("f_ab")).alias("l"), F.when(first, F.col("f_bc")).otherwise(F.col("f_c")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    return two.unionByName(three), totals


def _score(a: str, left: str, right: str) -> Column:
    """1000000 a a / (left right) rounded down, in 38 decimal digits."""
    return F.expr(f"(1000000BD * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) div (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))")


def _at_least(part: str, whole: str, per_cent: int) -> Column:
    return F.expr(f"CAST({part} AS DECIMAL(19,0)) * 100 >= CAST({whole} AS DECIMAL(19,0)) * {per_cent}")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The `top` candidates of each language: lang, rank (from 1), phrase, a, l, r, n (words of the language), score.

    By score, then occurrences, both from the highest, then phrase in byte order. See `phrases` for what the columns mean.
    """
    found, totals = phrases(docs, least, inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
