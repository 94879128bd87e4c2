"""Benchmark decontamination by the q-gram lemma.

Texts are compared as UTF-8 bytes, lower-cased, with every run of ASCII characters other
than letters and digits as one space. A passage of n bytes that lies in a document
with at most k edits shares at least n + 1 - q (k + 1) of its q-grams with it, all on
diagonals (position in the document minus position in the passage) at most 2 k + 1
apart. So, per document:

1. Q-grams of the document are looked up in the benchmark's (a bitmap, then a sorted
   array); each hit votes for (passage, diagonal).
2. Votes of one passage are counted in bands of width 2 (k + 1), each overlapping the
   next by half, so that any 2 k + 1 neighbouring diagonals lie in one band. Each passage
   position counts once in a band. Bands that reach the bound are kept.
3. In kept bands, a banded alignment gives the least edit distance of the whole passage
   to any stretch of the document; at most k edits is a leak.

k is EDIT_SHARE of the passage's length, less where the bound would not be positive; a
passage shorter than q bytes is looked for as it is, between spaces. The benchmark is
broadcast in blocks of at most BLOCK_BYTES, each of which passes over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Q = 10
EDIT_SHARE = 0.06
BLOCK_BYTES = 16 << 20
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LEAKS = "doc_id long, item_id long, start long, length long, edits int"


def normal(text: str | None) -> bytes:
    """Lower-case words with one space around each; nothing if there is no word."""
    words = (text or "").lower().encode().translate(_SPACED).split()
    return b" %b " % b" ".join(words) if words else b""


@dataclass
class Passages:
    """A block of the benchmark: its passages, and their q-grams as a sorted array with (passage, position)."""

    ids: np.ndarray
    texts: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    where: np.ndarray
    position: np.ndarray
    bitmap: np.ndarray
    short: dict[bytes, int]
    span: int
    stretch: int
    crowd: int

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]]) -> Passages:
        size = np.array([len(t) for _, t in rows], dtype="int64")
        most = (size + 1) // Q - 2  # the most edits that leave a bound of at least Q
        budget = np.clip(np.minimum((EDIT_SHARE * size).astype("int64"), most), 0, None)
        grams = [_windows(t) for _, t in rows]
        where = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        position = np.concatenate([np.arange(len(g)) for g in grams])
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        bitmap = np.zeros(1 << _BITS, "bool")
        bitmap[every * _MIX >> np.uint64(64 - _BITS)] = True
        short = {t: i for i, (_, t) in enumerate(rows) if len(t) < Q}
        bound = np.maximum(size + 1 - Q * (budget + 1), 1)
        spans = size + 2 * budget + 2
        crowd = int(np.min(-(-bound // -(-spans // spans.min()))))
        return cls(
            np.array([i for i, _ in rows]), [t for _, t in rows], budget, bound, every[order], where[order],
            position[order], bitmap, short, int(spans.max()), int(spans.min()), crowd,
        )

    def leaks(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, start, length, edits) in the normalized text: the best stretch of each passage found."""
        best: dict[int, tuple[int, int, int]] = {}
        for passage, low, high in self._regions(text):
            if best.get(passage, (1,))[0] == 0:
                continue
            if (at := text.find(self.texts[passage])) >= 0:
                best[passage] = (0, at, len(self.texts[passage]))
                continue
            edits, start, end = banded(self.texts[passage], text, low, high)
            if edits <= self.budget[passage]:
                best[passage] = min(best.get(passage, (edits, start, end - start)), (edits, start, end - start))
        for word, passage in self.short.items():
            if (at := text.find(word)) >= 0:
                best[passage] = (0, at, len(word))
        return [(int(self.ids[p]), s, n, e) for p, (e, s, n) in best.items()]

    def _regions(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(passage, first and last diagonal) of neighbouring bands that reach the bound."""
        grams = _windows(text)
        at = np.flatnonzero(self.bitmap[grams * _MIX >> np.uint64(64 - _BITS)])
        at = self._dense(at)
        if len(at) < self.bound.min():
            return
        first = np.searchsorted(self.grams, grams[at], "left")
        n = np.searchsorted(self.grams, grams[at], "right") - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        if len(at) < self.bound.min():
            return
        votes = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        passage, position = self.where[votes], self.position[votes]
        diagonal = np.repeat(at, n) - position
        half = self.budget[passage] + 1
        least = self.span  # makes diagonals positive
        band = (diagonal + least) // half
        width = np.int64(len(text) + least + 2)
        key = np.concatenate([passage * width + band, passage * width + band + 1])
        order = np.lexsort((np.concatenate([position, position]), key))
        key, position = key[order], np.concatenate([position, position])[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (position[1:] != position[:-1])])
        bands, count = np.unique(key[new], return_counts=True)
        kept = bands[count >= self.bound[bands // width]]
        open_: tuple[int, int, int] | None = None
        for k in kept.tolist():  # band b counts the diagonals of pieces b - 1 and b
            p, b = divmod(k, int(width))
            step = int(self.budget[p]) + 1
            low, high = (b - 1) * step - least, (b + 1) * step - least - 1
            if open_ and open_[0] == p and low <= open_[2] + 1:
                open_ = (p, open_[1], high)
            else:
                if open_:
                    yield open_
                open_ = (p, low, high)
        if open_:
            yield open_

    def _dense(self, at: np.ndarray) -> np.ndarray:
        """Hits no further than a passage's span from a crowd; others can't be in a region that reaches the bound.

        If a span of S bytes has B hits, one of its ceil(S / w) stretches of w bytes has B / ceil(S / w).
        """
        if len(at) < self.crowd:
            return at[:0]
        crowds = np.flatnonzero(at[self.crowd - 1 :] - at[: len(at) - self.crowd + 1] < self.stretch)
        if not len(crowds):
            return at[:0]
        steps = np.zeros(len(at) + 1, "int64")
        np.add.at(steps, np.searchsorted(at, at[crowds] - self.span, "left"), 1)
        np.add.at(steps, np.searchsorted(at, at[crowds + self.crowd - 1] + self.span, "right"), -1)
        return at[np.cumsum(steps[:-1]) > 0]


def _windows(data: bytes) -> np.ndarray:
    """Hashes of the q-grams, by position; a clash only costs an alignment."""
    eight = np.empty(max(0, len(data) - 7), "uint64")
    for r in range(min(8, len(eight))):
        eight[r::8] = np.frombuffer(data, "<u8", (len(data) - r) // 8, r)
    return eight[: 8 - Q] * _MIX ^ eight[Q - 8 :]


def banded(passage: bytes, text: bytes, low: int, high: int) -> tuple[int, int, int]:
    """Least edits, start and end over stretches of `text` that begin on diagonals low to high.

    Rows are passage positions, columns are diagonals, with a margin for edits on both sides.
    Of equally good stretches the leftmost start counts.
    """
    a, b = np.frombuffer(passage, "uint8"), np.frombuffer(text, "uint8")
    margin = int(EDIT_SHARE * len(a)) + 1
    diagonals = np.arange(low - margin, high + margin + 1)
    far = len(a) + len(b) + 1
    inside = (diagonals >= 0) & (diagonals <= len(b))
    cost, start = np.where(inside, 0, far), diagonals.copy()
    for i in range(len(a)):
        column = diagonals + i  # the text byte that byte i would be set against
        there = (column >= 0) & (column < len(b))
        letter = b[np.clip(column, 0, max(len(b) - 1, 0))]
        new = np.where(there, cost + (letter != a[i]), far)
        new_start = start.copy()
        dropped = np.concatenate([cost[1:], [far]]) + 1  # byte i of the passage is missing in the text
        better = (dropped < new) & (column + 1 >= 0)
        new[better], new_start[better] = dropped[better], np.concatenate([start[1:], [0]])[better]
        # bytes of the text that are not in the passage: a running minimum along the row
        offset = np.arange(len(new))
        slack = new - offset
        source = np.maximum.accumulate(np.where(slack <= np.minimum.accumulate(slack), offset, 0))
        inserted = new[source] + offset - source
        legal = (column + 1 <= len(b)) & (inserted < new)
        new[legal], new_start[legal] = inserted[legal], new_start[source][legal]
        cost, start = np.minimum(new, far), new_start
    end = diagonals + len(a)
    cost = np.where((end >= 0) & (end <= len(b)), cost, far)
    best = int(np.lexsort((start, cost))[0])
    return int(cost[best]), int(start[best]), int(end[best])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, length, edits): every passage of the benchmark in every document, at its best place.

    docs: doc_id, text. benchmark: item_id, text. start and length are bytes of the normalized
    text. Null and empty texts, and passages without a word, match nothing. Of rows of one
    doc_id and passage, the best counts; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    found = [_searched(texts, block) for block in _blocks(benchmark)]
    if not found:
        return spark.createDataFrame([], LEAKS)
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    best = F.min(F.struct("edits", "start", "length"))
    return every.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", "b.length", "b.edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a passage of the benchmark; a null doc_id stays."""
    leaks = find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")


def _blocks(benchmark: DataFrame) -> Iterator[Passages]:
    rows, size = [], 0
    for item, text in benchmark.select("item_id", "text").filter("text is not null").distinct().toLocalIterator():
        if passage := normal(text):
            rows.append((item, passage))
            size += len(passage)
        if size > BLOCK_BYTES:
            yield Passages.of(rows)
            rows, size = [], 0
    if rows:
        yield Passages.of(rows)


def _searched(texts: DataFrame, block: Passages) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, *leak) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for leak in held.value.leaks(normal(t))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "length", "edits"])

    return texts.mapInPandas(search, LEAKS)
